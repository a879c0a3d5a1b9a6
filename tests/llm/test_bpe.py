"""Encoding and decoding against the tokenizers library."""

import random
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from fieldstate.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
PARTS = [
    "a", "b", "the", "ing", "1", "2", "'s", "'", "<|endoftext|>", "<|startoftext|>", "<|", "é", "é", "Σ", "ΑΣ", "İ", "ß", "Ᲊ", "՘",
    "\U00010d50", "\U000105d2̇", "中", "文", "　", "\x85", "​", "!!", "aaaa", "aaa", "\t", "\n", " ", "  ", "🙂", "👍🏽", "ﬁ", "Ⅷ", "½",
    "한", "ᄒ", "ᅡ", "ᆫ", "\0", "tion", "hahaha",
]


def expected(texts):
    library = Tokenizer.from_file(PATH)
    out = []
    for t in texts:
        ids = library.encode(t or "", add_special_tokens=False).ids
        out.append((ids, library.decode(ids, skip_special_tokens=False)))
    return out


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    mixed = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(40))) for _ in range(1500)]
    words = ["".join(rng.choice("abcdehinorst") for _ in range(rng.randrange(1, 200))) for _ in range(800)]
    runs = ["a" * k for k in range(120)] + ["ha" * k + "h" for k in range(60)]
    return [None, "", " \n", *mixed, *words, *runs, "x" * 50_000, "".join(rng.choice("abcdehinorst") for _ in range(100_000)), "word " * 60_000]


def test_ids_and_texts_equal_the_library(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    coded = docs.select("doc_id", bpe.encode("text", PATH).alias("ids"))
    rows = coded.select("doc_id", "ids", bpe.decode("ids", PATH).alias("back")).collect()
    want = expected(texts)
    for r in rows:
        if texts[r.doc_id] is None:
            assert r.ids is None and r.back is None
        else:
            assert (r.ids, r.back) == want[r.doc_id], texts[r.doc_id][:80]


def test_digest_rows_ties_and_clashing_columns(spark):
    rows = [(1, "Hello, world", "x", 1), (1, "Hello, world", "y", 2), (None, None, None, 3), (7, "", "z", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, id long")
    got = sorted([tuple(r) for r in bpe.digest(docs, PATH).collect()], key=str)
    want = []
    for i, t, *_ in rows:
        ((ids, back),) = expected([t])
        want.append((i, len(ids), sha256(np.array(ids, "<u4").tobytes()).hexdigest(), sha256(back.encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert bpe.digest(docs.limit(0), PATH).collect() == []


def test_unknown_ids_are_left_out(spark):
    rows = spark.createDataFrame([([320, None, -5, 10**6, 321],), ([],), (None,), ([49407],)], "ids array<int>")
    library = Tokenizer.from_file(PATH)
    assert [r[0] for r in rows.select(bpe.decode("ids", PATH)).collect()] == [library.decode([320, 321]), "", None, "<|endoftext|>"]


def test_check_finds_exactly_the_words_that_merging_changes():
    """Greedy proposals that pass the check equal exact merging; those that fail differ from it."""
    v = bpe.Vocabulary(PATH)
    rng = random.Random(1)
    words = ["".join(rng.choice("aehinorst") for _ in range(rng.randrange(2, 14))) for _ in range(3000)]
    symbols = [np.frombuffer(w.encode(), np.uint8).astype(np.int64) for w in words]
    failed = 0
    for s in symbols:
        s[-1] += 256
        tokens, _ = v.proposed(s, np.array([0]), np.array([len(s)]))
        ok = bool(v.compatible(tokens[:-1], tokens[1:]).all())
        failed += not ok
        (exact,) = v.merged([s])
        assert ok == (tokens.tolist() == exact.tolist()) and exact.tolist() == v.merged_by_heap(v.single[s].tolist())
    assert 0 < failed < len(words)


def test_words_are_forgotten_and_learned_again(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 50)
    v = bpe.Vocabulary(PATH)
    library = Tokenizer.from_file(PATH)
    for k in range(20):
        text = " ".join(f"word{k}x{j}" for j in range(30))
        assert v.encoded([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        bpe.Vocabulary(public_tokenizers.path("byte_bpe_50k.json"))
