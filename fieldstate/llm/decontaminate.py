"""Benchmark decontamination with spaced-seed hashing.

A mask over a few token positions keeps some and ignores the others; texts that differ only at ignored positions still
share the hash. Hashes of training texts are joined with those of the benchmark. Around every hit the two texts are laid
upon each other, and the overlap counts if enough aligned words agree, whichever were substituted.

Before the join, a bitmap of fixed size tells which training hashes cannot be in the benchmark, whatever its size: a fuller
bitmap passes more rows to the join and changes no result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldstate.llm import common as C

#: Fixed masks: token positions that count (1) and that are ignored (0). Enumerated: of any 12 to 20 words with up to 20 %
#: substituted, wherever they are, at least one mask has a clean place.
MASKS = ("1110111", "11010000111", "10110010011")
SPAN = min(map(len, MASKS))
#: Bits of the bitmap (8 MB).
BITMAP_BITS = 26
#: Words are runs of letters, digits and bytes of other scripts; the rest of ASCII separates.
SEPARATOR = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of lower-cased words, bounds by row)."""
    data, offsets = C.buffers(pc.utf8_lower(texts.cast(pa.large_string())))
    starts, stops, bounds = C.word_spans(data, offsets, SEPARATOR)
    return C.word_hashes(data, starts, stops), bounds


def seeds(words: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each mask (hash, place) of all its spans that lie within a row."""
    every = np.arange(len(words))
    ends = bounds[np.searchsorted(bounds, every, side="right")] if len(words) else every
    for k, mask in enumerate(MASKS):
        places = every[every + len(mask) <= ends]
        sums = np.full(len(places), k + 1, C.U)
        for at, bit in enumerate(mask):
            if bit == "1":
                sums = sums * C.U(0xD6E8FEB86659FD93) + words[places + at]
        yield C.mix(sums), places


def benchmark_seeds(items: DataFrame) -> DataFrame:
    """(hash, item, at) of (item, text)."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, bounds = tokens(batch.column(1))
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for hashes, places in seeds(words, bounds):
                row = np.searchsorted(bounds, places, side="right") - 1
                columns = [pa.array(hashes.view(np.int64)), pa.array(ids[row]), pa.array(places - bounds[row])]
                yield pa.record_batch(columns, ["hash", "item", "at"])

    return items.mapInArrow(emit, "hash long, item long, at long")


def bitmap(hashes: DataFrame) -> np.ndarray:
    """The benchmark's hashes as bits; at most 2 ** (BITMAP_BITS - 6) words reach the driver, however many items there are."""
    bit = F.col("hash").bitwiseAND((1 << BITMAP_BITS) - 1)
    words = hashes.select(F.shiftright(bit, 6).alias("w"), F.expr(f"shiftleft(1L, cast(hash & 63 as int))").alias("b"))
    rows = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(1 << (BITMAP_BITS - 6), np.int64)
    out[rows["w"].to_numpy()] = rows["b"].to_numpy()
    return out.view(C.U)


def hit_documents(docs: DataFrame, bits) -> DataFrame:
    """(id, text, hits) of the documents that the bitmap cannot rule out; ``bits`` is a broadcast."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = bits.value
        for batch in batches:
            texts = batch.column(1)
            lengths = C.buffers(texts)[1]
            for a, b in C.slices(lengths):
                words, bounds = tokens(texts.slice(a, b - a))
                found = []
                for hashes, places in seeds(words, bounds):
                    at = hashes & C.U((1 << BITMAP_BITS) - 1)
                    may = (known[(at >> C.U(6)).astype(np.int64)] >> (at & C.U(63))) & C.U(1) > 0
                    found.append((places[may], hashes[may]))
                place = np.concatenate([x[0] for x in found])
                if not len(place):
                    continue
                hashes = np.concatenate([x[1] for x in found])
                order = np.argsort(place, kind="stable")
                place, hashes = place[order], hashes[order]
                row = np.searchsorted(bounds, place, side="right") - 1
                own, first = np.unique(row, return_index=True)
                hits = pa.StructArray.from_arrays([pa.array(hashes.view(np.int64)), pa.array(place - bounds[row])], ["hash", "at"])
                lists = pa.ListArray.from_arrays(np.append(first, len(row)).astype(np.int32), hits)
                take = pa.array(own + a)
                yield pa.record_batch([batch.column(0).take(take), texts.take(take), lists], ["id", "text", "hits"])

    return docs.mapInArrow(emit, "id long, text string, hits array<struct<hash: long, at: long>>")


VERDICT = "doc_start long, n_matched long, n_item_words long"


def overlap(stretch: int, percent: int):
    """Arrow function: the best overlap of a document and an item over the given alignments, null if none suffices."""

    @F.arrow_udf(VERDICT)
    def best(texts: pa.Array, items: pa.Array, shifts: pa.Array) -> pa.Array:
        rows = []
        for i in range(len(texts)):
            doc, _ = tokens(texts.slice(i, 1))
            item, _ = tokens(items.slice(i, 1))
            need = min(stretch, len(item))
            result = None
            for shift in sorted(shifts[i].as_py()):
                at = np.arange(len(item)) + shift
                inside = (at >= 0) & (at < len(doc))
                equal = np.zeros(len(item) + 1, np.int64)
                equal[1:][inside] = doc[at[inside]] == item[inside]
                sums = np.cumsum(equal)
                agree = sums[need:] - sums[:-need]
                if 100 * agree.max() >= percent * need and (result is None or sums[-1] > result["n_matched"]):
                    result = {"doc_start": max(shift, 0), "n_matched": int(sums[-1]), "n_item_words": len(item)}
            rows.append(result)
        return pa.array(rows, pa.struct([("doc_start", pa.int64()), ("n_matched", pa.int64()), ("n_item_words", pa.int64())]))

    return best


def contaminations(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text: str = "text", stretch: int = 20, percent: int = 80,
) -> DataFrame:
    """(doc id, item id, doc_start, n_matched, n_item_words) of every document that holds a passage of an item.

    A passage counts if, in one alignment, ``percent`` of ``stretch`` neighbouring words of the item (of all, if it is
    shorter) agree. Alignments come from seeds. At the default limits every such passage of an item of 12 words or more has
    one; shorter items are found where a seed stays clean, always if nothing is substituted. Items of fewer than SPAN words
    match nothing, nor do empty and null texts. A lower ``percent`` or ``stretch`` has no such guarantee. ``doc_start`` is the word where the item's first word falls, ``n_matched`` counts all agreeing words of the best
    alignment (the earliest among equals). Rows that share an id are one document or item: the pair appears once, with its
    best overlap. A null id stays null in the result. Empty tables give no rows.
    """
    spark = docs.sparkSession
    items = items.select(C.key(item_col).alias("item"), F.col(item_text).alias("item_text"))
    known = C.written(benchmark_seeds(items), "seeds")
    bits = spark.sparkContext.broadcast(bitmap(known))
    brief = docs.select(C.key(id_col).alias("id"), F.col(text_col).alias("text"))
    hit = C.written(hit_documents(brief, bits), "hits")
    spots = hit.select("id", F.xxhash64("text").alias("version"), F.explode("hits").alias("h")).select("id", "version", "h.hash", F.col("h.at").alias("doc_at"))
    pairs = spots.join(known, "hash").groupBy("id", "version", "item").agg(F.collect_set(F.col("doc_at") - F.col("at")).alias("shifts"))
    texts = hit.select("id", F.xxhash64("text").alias("version"), "text").dropDuplicates(["id", "version"])
    both = pairs.join(texts, ["id", "version"]).join(items, "item")
    found = both.withColumn("o", overlap(stretch, percent)("text", "item_text", "shifts")).filter("o IS NOT NULL")
    one = found.groupBy("id", "item").agg(F.max_by("o", F.struct("o.n_matched", -F.col("o.doc_start"), "o.n_item_words")).alias("o"))
    null_back = lambda c: F.when(F.col(c) != C.NO_ID, F.col(c))
    return one.select(null_back("id").alias(id_col), null_back("item").alias(item_col), "o.doc_start", "o.n_matched", "o.n_item_words")


def decontaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` without the rows whose id ``contaminations`` finds."""
    (own,) = C.fresh(docs, "_key")
    bad = contaminations(docs, items, id_col, **options).select(C.key(id_col).alias(own)).distinct()
    return docs.withColumn(own, C.key(id_col)).join(bad, own, "left_anti").select(*docs.columns)
