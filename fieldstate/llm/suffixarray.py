"""Suffix-array deduplication by bytes, with bucket-pointer refinement.

The bytes that can hold a repeat come together by anchor (see ``anchors``). Their distinct passages form one text with
ends marked; its suffixes start in q-gram buckets, and buckets are refined by sorting on the bucket pointers of the
suffixes a known depth further on. Refined pointers are in place at once, so later buckets of the same round already sort
on them. Refinement ends where buckets are single or known to the depth of a window. Neighbours in the order that agree
in a whole window are the repeats; the earliest of each stays.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldstate.llm import anchors as A
from fieldstate.llm import common as C

#: Length of the grams of the first buckets; parts of a refinement round, each seeing the pointers set by those before.
GRAM, PARTS = 4, 8


def suffix_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """All suffixes of ``symbols`` (values 0..256), ordered by their first ``depth`` symbols at least."""
    n = len(symbols)
    padded = np.concatenate([symbols.astype(np.int64), np.zeros(GRAM, np.int64)])
    keys = np.zeros(n, np.int64)
    for k in range(GRAM):
        keys = keys * 257 + padded[k : k + n]
    order = np.argsort(keys, kind="stable")
    pointer = np.full(n + depth, -1, np.int64)  # past the end: smaller than all
    open_ = place_buckets(order, keys[order], np.arange(n), pointer)
    known = GRAM
    while len(open_) and known < depth:
        # whole buckets, in PARTS of about equal size
        starts = np.flatnonzero(np.append(True, np.diff(pointer[order[open_]]) != 0))
        cuts = np.unique(starts[np.searchsorted(starts, np.linspace(0, len(open_), PARTS + 1)[1:-1].astype(int)).clip(0, len(starts) - 1)])
        left = []
        for part in np.split(open_, cuts):
            if not len(part):
                continue
            suffix = order[part]
            pairs = pointer[suffix] * (n + 2) + pointer[suffix + known] + 1
            inner = np.argsort(pairs, kind="stable")
            order[part] = suffix[inner]
            left.append(place_buckets(order[part], pairs[inner], part, pointer))
        open_ = np.concatenate(left)
        known *= 2
    return order


def place_buckets(suffix: np.ndarray, keys: np.ndarray, at: np.ndarray, pointer: np.ndarray) -> np.ndarray:
    """Point each suffix to the first place of its bucket; return the places in buckets of more than one."""
    if not len(suffix):
        return at
    first = np.append(True, keys[1:] != keys[:-1])
    begin = np.flatnonzero(first)
    sizes = np.diff(np.append(begin, len(keys)))
    pointer[suffix] = np.repeat(at[begin], sizes)
    return at[np.repeat(sizes > 1, sizes)]


def first_windows(passages: list[bytes], window: int) -> np.ndarray:
    """For every place of the joined passages (each followed by an end mark): a window starts there that no earlier place has."""
    joined = np.zeros(sum(map(len, passages)) + len(passages), np.int16)
    starts = np.zeros(len(joined), bool)
    at = 0
    for p in passages:
        joined[at : at + len(p)] = np.frombuffer(p, np.uint8).astype(np.int16) + 1
        starts[at : at + max(len(p) - window + 1, 0)] = True
        at += len(p) + 1
    order = suffix_order(joined, window)
    order = order[starts[order]]
    same = np.zeros(len(order), bool)
    if len(order):
        views = np.lib.stride_tricks.sliding_window_view(joined, window)
        for a in range(1, len(order), 1 << 15):
            b = min(a + (1 << 15), len(order))
            same[a:b] = (views[order[a:b]] == views[order[a - 1 : b - 1]]).all(axis=1)
    first = np.zeros(len(joined), bool)
    if len(order):
        first[np.minimum.reduceat(order, np.flatnonzero(~same))] = True
    return first


def judge(window: int) -> A.Judge:
    def firsts(groups: list[list[bytes]]) -> Iterator[tuple[int, int, int, int]]:
        passages = [p for group in groups for p in group]
        if not passages:
            return
        first, at = first_windows(passages, window), 0
        for g, group in enumerate(groups):
            for k, p in enumerate(group):
                for s, n in A.stretches(first[at : at + len(p)]):
                    yield g, k, s, n
                at += len(p) + 1

    return firsts


RESULT = "n_bytes long, n_removed long, n_spans long, sha256 string, kept string"


def suffix_array_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 100, gram: int = 24, hot: int = 1000
) -> DataFrame:
    """All rows and columns of ``docs`` and a struct ``suffixes`` (n_bytes, n_removed, n_spans, sha256, kept).

    Texts count as UTF-8 bytes. A byte goes if a string of ``window`` bytes that covers it also starts earlier (smaller
    id, or same id and earlier start), judged on the input; matches never cross documents. ``n_spans``: maximal removed
    runs; ``sha256``: of the other bytes; ``kept``: these as text, without characters of which the cut left only a part.
    Empty and null texts give (0, 0, 0, sha256 of nothing, ""). Rows that repeat an id and text are one place and keep
    alike; a null id is the smallest. An empty table gives an empty table. Other columns pass through unread, whatever
    their names; one named ``suffixes`` gives way to the result.
    """
    docs, names = C.aside(docs, "_key", "_runs", "_firsts", "suffixes")
    id_col, text_col = names.get(id_col, id_col), names.get(text_col, text_col)
    plain = set(docs.columns) == {id_col, text_col}
    keyed = docs.select(C.key(id_col).alias("_key"), text_col) if plain else docs.withColumn("_key", C.key(id_col))
    w = A.Windows("byte", window, gram, hot, A.repeats_ids(keyed))

    @F.arrow_udf(RESULT)
    def cut(texts: pa.Array, runs_: pa.Array, firsts: pa.Array) -> pa.Array:
        texts = texts.cast(pa.large_binary())
        out: tuple[list, list, list, list, list] = ([], [], [], [], [])
        for i in range(len(texts)):
            text = texts[i].as_py() or b""
            gone = A.covered_row(len(text), text, runs_[i], firsts[i], w)
            spans = A.stretches(gone)
            kept = np.frombuffer(text, np.uint8)[~gone].tobytes() if spans else text
            out[0].append(len(text)), out[1].append(len(text) - len(kept)), out[2].append(len(spans))
            out[3].append(sha256(kept).hexdigest()), out[4].append(kept.decode("utf-8", "ignore"))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        return pa.StructArray.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], [x.split()[0] for x in RESULT.split(", ")])

    marked = A.marked_documents(keyed, w, judge(window), "suffixes", text_col)
    out = marked.withColumn("suffixes", cut(text_col, "_runs", "_firsts"))
    if plain:
        out = out.withColumn(id_col, F.when(F.col("_key") != C.NO_ID, F.col("_key")).cast(docs.schema[id_col].dataType))
    return out.select(*C.given(names, "suffixes"), "suffixes")


def digest(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    s = suffix_array_dedup(docs.select("doc_id", "text"))
    return s.select("doc_id", "suffixes.n_bytes", "suffixes.n_removed", "suffixes.n_spans", F.col("suffixes.sha256").alias("kept_sha256"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with each text cut to what is kept and n_chars following it; a null text stays null."""
    out = suffix_array_dedup(docs)
    text = F.when(F.col("text").isNotNull(), F.col("suffixes.kept"))
    out = out.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
