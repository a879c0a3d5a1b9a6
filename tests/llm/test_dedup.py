"""Exact substring deduplication and near duplicates against plain Python."""

import random

import numpy as np
import pytest

from fieldstate.llm import anchors, substring, suffixarray, superminhash

from . import plain
from .data import documents, frame


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("hot", [2000, 2])
def test_words_match_plain_version(spark, hot):
    docs = documents() + [(1000, None), (0, dict(documents())[0]), (None, "null " * 30), (None, None)]
    got = substring.substring_dedup(frame(spark, docs), hot=hot)
    assert got.columns == [*frame(spark, docs).columns, "substring"]
    from pyspark.sql import functions as F

    got = got.select("doc_id", "substring.n_words", "substring.n_removed", F.sha2("substring.kept", 256))
    assert rows(got) == sorted(plain.words_digest(docs), key=repr)


@pytest.mark.parametrize("hot", [2000, 2])
def test_bytes_match_plain_version(spark, hot):
    docs = documents(2) + [(0, dict(documents(2))[0]), (None, "null " * 30)]
    got = suffixarray.suffix_array_dedup(frame(spark, docs), hot=hot)
    got = got.select("doc_id", "suffixes.n_bytes", "suffixes.n_removed", "suffixes.n_spans", "suffixes.sha256")
    assert rows(got) == sorted(plain.bytes_digest(docs), key=repr)


def test_rows_of_one_id_with_different_texts(spark):
    same, other = " ".join(f"s{k}" for k in range(40)), " ".join(f"t{k}" for k in range(40))
    docs = [(5, same), (5, other), (5, other), (9, other + " end")]
    got = sorted((r.text, r.n_removed) for r in substring.substring_dedup(frame(spark, docs)).select("text", "substring.n_removed").collect())
    assert got == sorted([(same, 0), (other, 0), (other, 0), (other + " end", 40)])


def test_empty_tables(spark):
    empty = frame(spark, [])
    assert substring.digest(empty).count() == suffixarray.digest(empty).count() == superminhash.digest(empty).count() == 0
    assert suffixarray.without_repeats(empty).columns == empty.columns


def test_kept_text_and_length(spark):
    text = "é" * 200
    out = suffixarray.without_repeats(frame(spark, [(1, text), (2, "a" + text), (3, None)])).orderBy("doc_id").collect()
    assert [(r.text, r.n_chars) for r in out] == [("é", 1), ("a", 1), (None, None)]


def test_automaton():
    rng = random.Random(3)
    for _ in range(100):
        automaton = substring.SuffixAutomaton()
        passages = ["".join(rng.choice("abc") for _ in range(rng.randrange(25))) for _ in range(4)]
        for p in passages:
            automaton.add(list(p))
        query = "".join(rng.choice("abc") for _ in range(30))
        want = [max(k for k in range(i + 2) if any(query[i + 1 - k : i + 1] in p for p in passages)) for i in range(30)]
        assert automaton.matching(list(query)) == want


def test_suffix_order_by_buckets():
    rng = random.Random(4)
    for _ in range(50):
        text = bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 200)))
        order = suffixarray.suffix_order(np.frombuffer(text, np.uint8).astype(np.int64), len(text))
        assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:])


def test_equal_windows_have_equal_anchors():
    w = anchors.Windows("byte", 20, 5)
    rng = random.Random(5)
    text = bytes(rng.choice(b"abcd") for _ in range(3000)) * 2
    data = np.frombuffer(text, np.uint8)
    anchor, _, run = anchors.runs(data, np.array([0, len(data)]), w)
    by_start = {}
    for a, r in zip(anchor.tolist(), run.tolist()):
        by_start.update((s, a) for s in range(r >> anchors.START, (r >> anchors.START) + (r & anchors.COUNT)))
    assert sorted(by_start) == list(range(len(text) - 19))
    assert all(by_start[s] == by_start[s + 3000] for s in range(2981))


@pytest.mark.parametrize("hot", [2, 20])
def test_windows_of_hot_anchors_stay_together(spark, hot):
    """A common string in many surroundings: its windows are neither dealt one by one nor kept from the suffix array."""
    rng = random.Random(8)
    common = "a string of some forty bytes, very common"
    some = ["".join(rng.choice("abcdefgh ") for _ in range(150)) for _ in range(20)]
    docs = [(i, rng.choice(some) + common + rng.choice(some)) for i in range(60)]
    got = suffixarray.suffix_array_dedup(frame(spark, docs), hot=hot)
    got = got.select("doc_id", "suffixes.n_bytes", "suffixes.n_removed", "suffixes.n_spans", "suffixes.sha256")
    assert rows(got) == sorted(plain.bytes_digest(docs), key=repr)
    w = anchors.Windows("byte", 100, 24, 20)
    texts = frame(spark, docs).selectExpr("doc_id AS id", "text")
    dealt = anchors.cold_runs(texts.join(anchors.repeated_runs(texts, w, "test"), "id"), w)
    windows = dealt.selectExpr("sum(run & 255)").first()[0]
    assert dealt.count() * 4 < windows


def test_equal_windows_meet_at_longer_anchors():
    w = anchors.Windows("byte", 20, 5)
    rng = random.Random(9)
    texts = [bytes(rng.choice(b"ab") for _ in range(30)) for _ in range(300)]
    for hot in (1, 2):
        found = {}
        passages = {(7, hot, t): (i, i << anchors.START | 11) for i, t in enumerate(texts)}
        for batch in anchors.anchored_again(passages, w):
            for anchor, own, run, content in zip(*(c.to_pylist() for c in batch.columns)):
                start = (run >> anchors.START) - own
                assert texts[own][start : start + (run & anchors.COUNT) + 19] == content
                for s in range(run & anchors.COUNT):
                    found.setdefault(content[s : s + 20], set()).add(anchor)
        assert set(found) == {t[s : s + 20] for t in texts for s in range(11)}
        assert all(len(x) == 1 for x in found.values())


def test_near_duplicates_match_plain_version(spark):
    docs = documents(6)
    got = superminhash.near_duplicates(frame(spark, docs), width=3, percent=85)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got.select("doc_id", "near.*").collect()}
    assert got == {i: (n, c, i == c) for i, (n, c) in plain.groups(docs, 3, 85).items()}


def test_links_that_miss_the_centre(spark):
    """B and C are linked, A (smallest id) shares their buckets and is linked with neither, or with one."""
    words = [f"w{k}" for k in range(120)]
    a = words[:100]
    b = words[12:100] + [f"x{k}" for k in range(12)]
    c = words[12:100] + [f"x{k}" for k in range(11)]
    d = words[6:100] + [f"x{k}" for k in range(6)]
    docs = [(1, " ".join(a)), (2, " ".join(b)), (3, " ".join(c)), (4, " ".join(d)), (5, "Other words here")]
    got = {r.doc_id: r.component_id for r in superminhash.near_duplicates(frame(spark, docs), width=3, percent=85).select("doc_id", "near.component_id").collect()}
    assert got == {i: g[1] for i, g in plain.groups(docs, 3, 85).items()}


def test_repeated_and_null_ids_of_near_duplicates(spark):
    text = " ".join(f"w{k}" for k in range(50))
    docs = [(None, text), (7, text), (7, text), (8, text + " more"), (9, ""), (10, None)]
    got = superminhash.near_duplicates(frame(spark, docs)).select("doc_id", "near.*").collect()
    assert sorted((repr(r.doc_id), r.n_shingles, r.component_id, r.kept) for r in got) == sorted(
        [("None", 46, None, True), ("7", 46, None, False), ("7", 46, None, False), ("8", 47, None, False), ("9", 0, 9, True), ("10", 0, 10, True)])


def test_sketch_estimates_similarity_with_less_variance_than_independent_draws():
    rng = np.random.default_rng(0)
    estimates = []
    for _ in range(60):
        a = rng.integers(0, 2**63, size=200).astype(np.uint64)
        b = np.concatenate([a[:180], rng.integers(0, 2**63, size=20).astype(np.uint64)])
        s = superminhash.sketches(np.concatenate([a, b]), np.array([0, 200, 400]))
        estimates.append((s[0] == s[1]).mean())
    j = 180 / 220
    assert abs(np.mean(estimates) - j) < 0.02
    assert np.std(estimates) < (j * (1 - j) / superminhash.SLOTS) ** 0.5
    small = superminhash.sketches(np.array([5], np.uint64), np.array([0, 1, 1]))
    assert np.isfinite(small[0]).all() and np.isinf(small[1]).all()


def test_families_around_the_threshold(spark):
    """Copies of two originals with independent edits: many pairs just above and below the threshold, and chains of links."""
    rng = random.Random(31)
    docs = []
    for family in range(2):
        original = [f"f{family}w{k}" for k in range(140)]
        for _ in range(45):
            copy = list(original)
            for k in rng.sample(range(140), rng.randrange(1, 8)):
                copy[k] = f"e{rng.randrange(10**9)}"
            docs.append(" ".join(copy))
    rng.shuffle(docs)
    docs = list(enumerate(docs))
    got = {r.doc_id: r.component_id for r in superminhash.near_duplicates(frame(spark, docs), width=3, percent=85).select("doc_id", "near.component_id").collect()}
    assert got == {i: c for i, (_, c) in plain.groups(docs, 3, 85).items()}


def test_row_of_unknown_distance_stays_in_its_bucket(spark):
    words = lambda c, a, y, z: " ".join([f"{k}{i}" for k, n in zip("cayz", (c, a, y, z)) for i in range(n)])
    chain = [words(60, a, y, 0) for a, y in ((40, 0), (30, 0), (20, 0), (12, 7), (6, 13), (0, 19))]  # neighbours are similar
    texts = [*enumerate(chain), (6, words(60, 0, 19, 17))]  # 5 lies in 6; its size is too far from that of 0 to be compared
    bands = {i: [10 + k for k in range(5) if i in (k, k + 1)] + [1] * (i in (0, 5, 6)) for i, _ in texts}
    reps = spark.createDataFrame([(i, len(t.split()), bands[i]) for i, t in texts], "id long, n long, bands array<long>")
    got = superminhash.groups(reps, spark.createDataFrame(texts, "id long, text string"), 1, 80).collect()
    assert {(r.id, r.component) for r in got} - {(0, 0)} == {(k, 0) for k in range(1, 7)}


def test_bit_maps_never_rule_out_a_link(spark):
    rng = np.random.default_rng(3)
    rows = []
    for size in (1, 5, 40, 300, 4000):
        for share in (0.0, 0.03, 0.08, 0.12, 0.3):
            a = rng.integers(0, 2**63, size=size).astype(np.uint64)
            cut = int(size * share)
            b = np.concatenate([a[: size - cut], rng.integers(0, 2**63, size=cut).astype(np.uint64)])
            x, y = superminhash.bit_maps(np.concatenate([a, b]), np.array([0, size, 2 * size])).tolist()
            rows.append((size, size, x, y, (size - cut) / (size + cut)))
    table = spark.createDataFrame(rows, "n long, cn long, bits array<long>, cbits array<long>, j double")
    got = table.select("n", "j", superminhash.may_link(85).alias("may")).collect()
    assert all(r.may for r in got if r.j >= 0.85)
    assert not any(r.may for r in got if r.j < 0.6 and r.n in (40, 300))


def test_near_duplicates_keep_columns_of_any_name(spark):
    text = " ".join(f"w{k}" for k in range(50))
    rows = [(1, text, "a", "b", "c", "d", "e"), (2, text + " more", "f", "g", "h", "i", "j")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _key string, n string, _size string, _component string, near string")
    got = superminhash.near_duplicates(docs).orderBy("doc_id").collect()
    assert [tuple(r)[:6] for r in got] == [r[:6] for r in rows]
    assert [(r.near.component_id, r.near.kept) for r in got] == [(1, True), (1, False)]
