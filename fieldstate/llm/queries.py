"""The registered queries of this subpackage and their SQL; each query runs one operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from fieldstate.llm import (
    bpe, decontaminate, html, licences, packing, phrases, quality, substring, suffixarray, superminhash, urls, warc, whitening,
)

Query = Callable[[SparkSession, str], DataFrame]
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


QUERIES: dict[str, Query] = {
    "op1_substring_dedup": lambda s, d: substring.digest(table(s, d, "documents")),
    "op2_packing": lambda s, d: packing.packed(table(s, d, "documents"), TOKENIZER),
    "op3_suffix_array_dedup": lambda s, d: suffixarray.digest(table(s, d, "documents")),
    "op4_decontamination": lambda s, d: decontaminate.contaminations(table(s, d, "documents"), table(s, d, "benchmark")),
    "op5_quality_rules": lambda s, d: quality.digest(table(s, d, "documents")),
    "op6_licence_scan": lambda s, d: licences.licence_matches(table(s, d, "documents")),
    "op7_near_duplicates": lambda s, d: superminhash.digest(table(s, d, "documents")),
    "op8_url_filter": lambda s, d: urls.digest(table(s, d, "pages"), table(s, d, "labels")),
    "op9_warc": lambda s, d: warc.digest(table(s, d, "pages")),
    "op10_html_text": lambda s, d: html.main_text(table(s, d, "pages")),
    "op11_bpe": lambda s, d: bpe.digest(table(s, d, "documents"), WORD_TOKENIZER),
    "op12_collocations": lambda s, d: phrases.top(phrases.collocations(table(s, d, "documents"))),
    "op13_whitening": lambda s, d: whitening.digest(table(s, d, "embeddings")),
    "pipeline": corpus_pipeline.run,
}

ORACLES: dict[str, str] = {
    "op5_quality_rules": quality.sql(),
    "op6_licence_scan": licences.sql(),
    "op12_collocations": phrases.sql(),
}
