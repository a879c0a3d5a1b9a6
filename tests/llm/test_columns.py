"""Columns of the caller keep their values, whatever names the operators use themselves."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from fieldstate.llm import decontaminate, quality, substring, suffixarray, superminhash

NAMES = ("_key", "_RUNS", "_firsts", "_t", "_n", "_w", "_m", "_b", "_f", "_size", "_component", "n", "id", "rep", "hash", "text_", "anchor")
WORDS = " ".join(f"w{k}" for k in range(80))
TEXTS = [(1, WORDS), (2, WORDS + " more"), (3, "the end"), (4, None), (5, "")]


def table(spark, *further):
    names = (*NAMES, *further)
    rows = [(i, t, *(f"{n}-{i}" for n in names)) for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))


@pytest.mark.parametrize(("operator", "result"), [
    (substring.substring_dedup, "substring"), (suffixarray.suffix_array_dedup, "suffixes"),
    (superminhash.near_duplicates, "near"), (quality.quality_rules, "quality"),
])
def test_values_of_clashing_columns(spark, operator, result):
    docs = table(spark, result)
    got = operator(docs)
    assert got.columns == ["doc_id", "text", *NAMES, result]
    brief = operator(docs.select("doc_id", "text"))
    rows = got.orderBy("doc_id").collect()
    assert [tuple(r)[:-1] for r in rows] == [(i, t, *(f"{n}-{i}" for n in NAMES)) for i, t in TEXTS]
    assert [r[result] for r in rows] == [r[result] for r in brief.orderBy("doc_id").collect()]


def test_decontaminated_keeps_values(spark):
    items = spark.createDataFrame([(9, WORDS)], "item_id long, text string")
    got = decontaminate.decontaminated(table(spark), items).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == [(i, t, *(f"{n}-{i}" for n in NAMES)) for i, t in TEXTS if i > 2]


def test_text_and_id_under_reserved_names(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string").select(F.col("doc_id").alias("_runs"), F.col("text").alias("_key"))
    got = substring.substring_dedup(docs, id_col="_runs", text_col="_key").orderBy("_runs").collect()
    assert [(r._runs, r._key, r.substring.n_removed) for r in got] == [(i, t, 80 if i == 2 else 0) for i, t in TEXTS]
