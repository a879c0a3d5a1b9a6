"""Collocations against plain Python; tries that burst and spill."""

import random
import re
from collections import Counter

import pytest

from fieldstate.llm import phrases


def plain(rows, least, covered=80, longest=4, limit=2000):
    counts, totals = {}, Counter()
    for _, lang, text in rows:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            w = re.findall("[^\x20\x09]+", piece)
            totals[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    counts.setdefault(lang, Counter())[tuple(w[i : i + k])] += 1
    out = []
    for lang, c in counts.items():
        found = []
        frequent = [p for p in c if len(p) > 1 and c[p] >= least]
        for p in frequent:
            a = c[p]
            score, k = min((2000000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
            inside = any(
                len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) and 100 * c[q] >= covered * a for q in frequent
            )
            if not inside:
                found.append((score, a, " ".join(p), c[p[:k]], c[p[k:]]))
        found.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        out += [(lang, r, p, a, x, y, totals[lang], s) for r, (s, a, p, x, y) in enumerate(found[:limit], 1)]
    return sorted(out)


def texts(seed=4, n=120):
    rng = random.Random(seed)
    words = ["the", "The", "of", "É", "é", "x|y", "10%", "new", "york", "city", "a b", "ǅ"] + [f"w{k}" for k in range(20)]
    rows = [(k, rng.choice(["en", "fr", None, "und"]), "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ". ", "\n", "\x0b"]) for _ in range(rng.randrange(120)))) for k in range(n)]
    rows += [(900 + k, "en", "new york city hall " * rng.randrange(1, 5)) for k in range(30)]
    rows += [(5, "en", None), (5, None, ""), (None, "de", "no no no no no, no no"), (6, "fr", " . ,"), (7, "long", "lo ng " * 30_000)]
    return rows


SCHEMA = "doc_id long, lang string, text string"


def frame(spark, rows):
    from pyspark.sql import functions as F

    extra = {c: F.lit("q") for c in ("phrase", "n", "words", "split", "salt", "prefix", "a", "score")}
    return spark.createDataFrame(rows, SCHEMA).withColumns(extra).repartition(3)


@pytest.mark.parametrize("least, limit", [(30, 2000), (3, 40)])
def test_equals_plain_version(spark, least, limit):
    rows = texts()
    got = phrases.top(phrases.collocations(frame(spark, rows), least=least), limit)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = plain(rows, least, limit=limit)
    assert want and sorted(tuple(r) for r in got.collect()) == want


def test_bursting_and_spilling_change_nothing(spark, monkeypatch):
    rows = texts(9)
    emitted = phrases.runs(frame(spark, rows).selectExpr("coalesce(lang, 'und') AS lang", "coalesce(text, '') AS text").coalesce(1), 1, None, None)
    monkeypatch.setattr(phrases, "ENTRIES", 25)
    monkeypatch.setattr(phrases, "WORDS", 30)
    monkeypatch.setattr(phrases, "TEXTS", 500)
    again = phrases.runs(frame(spark, rows).selectExpr("coalesce(lang, 'und') AS lang", "coalesce(text, '') AS text").coalesce(1), 1, None, None)
    total = lambda df: sorted(tuple(r) for r in phrases.merged(df, 1).collect())
    assert total(emitted) == total(again)


def test_trie_counts_subtrees_by_size():
    rng = random.Random(2)
    trie, want = phrases.HatTrie(4, burst=8), Counter()
    for _ in range(60):
        first = rng.randrange(1, 5)
        keys = sorted({tuple(rng.randrange(1, 6) for _ in range(3)) for _ in range(rng.randrange(1, 30))})
        counts = [rng.randrange(1, 9) for _ in keys]
        trie.add(first, [a << 40 | b << 20 | c for a, b, c in keys], counts)
        want.update({(first, *k): n for k, n in zip(keys, counts)})
    assert trie.inner and trie.entries == len(want)
    got, sizes = Counter(), []
    for keep in (len(want) // 2, 0):
        first, keys, counts = trie.spill(keep)
        got.update({(f, k >> 40, k >> 20 & (1 << 20) - 1, k & (1 << 20) - 1): n for f, k, n in zip(first.tolist(), keys.tolist(), counts.tolist())})
        sizes += [sum(first == f) for f in dict.fromkeys(first.tolist())]
        assert trie.entries <= keep
    assert got == want and sizes == sorted(sizes, reverse=True)


def test_large_counts_score_exactly(spark):
    """Products beyond 64 bits."""
    a, l, r = 3 * 10**18 + 1, 4 * 10**18 + 7, 3 * 10**18 + 5
    row = spark.createDataFrame([(a, l, r)], "a long, l long, r long")
    assert row.select(phrases.score()).first()[0] == 2_000_000 * a // (l + r)


def test_empty_table(spark):
    assert phrases.top(phrases.collocations(frame(spark, texts()).limit(0))).collect() == []
