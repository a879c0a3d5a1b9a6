"""The pipeline stage by stage, each against plain Python on its own input."""

import random

import public_tokenizers
import pytest

import __spark_entry__
import corpus_pipeline
from fieldstate.llm import queries
from fieldstate.llm.common import written

from . import plain
from .data import prose
from .test_formats import check_packed

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A table folder with clean, bad, copied, overlapping and contaminated documents."""
    rng = random.Random(21)
    path = tmp_path_factory.mktemp("tables")
    clean = lambda n: " ".join(w + (" of the" if k % 6 == 0 else "") for k, w in enumerate(prose(rng, n, 50_000)))
    items = [(k, " ".join(prose(rng, 30, 50_000))) for k in range(3)]
    passage = clean(40)
    texts = [clean(80 + 10 * k) for k in range(12)]
    texts += [texts[0], texts[1].replace(texts[1].split()[40], "edited", 1), texts[2] + "\n" + passage, clean(60) + " " + passage, passage + " " + clean(70)]
    texts += [clean(60) + " " + items[0][1] + " " + clean(20), "too short", "LOUD!! " * 80, None, "", " | ".join(prose(rng, 90, 50_000))]
    rows = [(10 * k, t, "en", "s", len(t) if t is not None else None) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_stages_match_plain_version(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_duplicates", "suffix_dedup", "decontamination", "packing"]

    kept = written(stages["quality"](spark, docs, folder), "t1")
    assert kept.columns == columns and sorted(r.doc_id for r in kept.collect()) == [10 * k for k in range(18)]

    texts = [(r.doc_id, r.text) for r in kept.collect()]
    groups = plain.groups(texts, 5, 80)
    single = written(stages["near_duplicates"](spark, kept, folder), "t2")
    assert single.columns == columns and sorted(r.doc_id for r in single.collect()) == sorted(i for i, (_, c) in groups.items() if c == i)
    assert not {120, 130} & {r.doc_id for r in single.collect()}

    before = {r.doc_id: r for r in single.collect()}
    cut = written(stages["suffix_dedup"](spark, single, folder), "t3")
    want = {i: bytes(x for x, g in zip(s, gone) if not g).decode("utf-8", "ignore") for i, s, gone in plain.repeated(lambda t: (t or "").encode(), [(i, r.text) for i, r in before.items()], 100)}
    got = {r.doc_id: r for r in cut.collect()}
    assert cut.columns == columns and {i: r.text for i, r in got.items()} == want and all(r.n_chars == len(r.text) for r in got.values())
    assert sum(map(len, want.values())) < sum(len(r.text) for r in before.values())

    clean = written(stages["decontamination"](spark, cut, folder), "t4")
    assert clean.columns == columns and {r.doc_id for r in clean.collect()} == set(got) - {170}

    pieces = stages["packing"](spark, clean, folder).collect()
    padding, _ = check_packed(pieces, {r.doc_id: r.text for r in clean.collect()}, 2048)
    assert padding < 2048

    whole = corpus_pipeline.run(spark, folder).collect()
    key = lambda rows: sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in rows)
    assert key(whole) == key(pieces)


def test_empty_documents(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, folder), f"empty-{name}")
    assert docs.count() == 0


def test_registry():
    assert set(queries.QUERIES) <= set(__spark_entry__.queries()) and set(queries.ORACLES) <= set(__spark_entry__.oracle_sql())
    assert [n for n in range(1, 11) if not any(q.startswith(f"op{n}_") for q in queries.QUERIES)] == []
    assert public_tokenizers.path("byte_bpe_50k.json") == queries.TOKENIZER
