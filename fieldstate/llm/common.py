"""Helpers shared by the operators: word hashes over Arrow buffers, written intermediate tables, document keys."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

U = np.uint64
#: The six separators of the word rule [^\x20\x09-\x0D]+, as a lookup table over bytes. bytes.split() has the same six.
SEPARATOR = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
#: Bytes of text handled at once inside a task; bounds the temporary arrays whatever a batch or a text holds.
SLICE = 1 << 20
NO_ID = -(1 << 63)


def folder(spark) -> str:
    """The shared folder of the session; a folder of this machine only where the session names none, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        named = tempfile.mkdtemp(prefix="fieldstate-")
        spark.sparkContext.setCheckpointDir(named)
    return str(named).rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write the rows to the shared folder and read them back. Survives the loss of executors."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def key(id_col: str = "doc_id") -> Column:
    """The id for joins and order; a null id counts as the smallest."""
    return F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores appended until no column of ``df`` has it, whatever its case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def aside(df: DataFrame, *reserved: str) -> tuple[DataFrame, dict[str, str]]:
    """``df`` without columns of a reserved name, whatever its case: such columns get a fresh one. And what each is called now."""
    names = {c: c for c in df.columns}
    clashing = [c for c in df.columns if c.lower() in reserved]
    taken = {c.lower() for c in df.columns} | set(reserved)
    for c in clashing:
        while names[c].lower() in taken:
            names[c] += "_"
        taken.add(names[c].lower())
    return (df.toDF(*names.values()) if clashing else df), names


def given(names: dict[str, str], result: str) -> list[Column]:
    """The columns that were set aside, under their first names; one with the name of the result gives way to it."""
    return [F.col(f"`{now}`").alias(c) for c, now in names.items() if c.lower() != result]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit values; a bijection."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array; nulls count as empty."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, size: int = SLICE) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes each; a longer text stands alone."""
    at, rows = 0, len(offsets) - 1
    while at < rows:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1)
        yield at, end
        at = end


def word_spans(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SEPARATOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the number of words before each row (rows + 1 entries)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~separator[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    edge = offsets[:-1][offsets[:-1] < len(data)]
    begins[edge] |= inside[edge]  # a word never crosses into the next text
    last = offsets[1:-1][offsets[1:-1] > 0] - 1
    ends[last] |= inside[last]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return starts, stops, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word's bytes."""
    if not len(starts):
        return np.zeros(0, U)
    lengths = stops - starts
    where = np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
    inner = where - np.repeat(starts, lengths)
    powers = np.cumprod(np.full(int(lengths.max()), 0x9E3779B97F4A7C15 | 1, U))
    values = (data[where].astype(U) + U(1)) * powers[inner]
    sums = np.add.reduceat(values, np.concatenate([[0], np.cumsum(lengths)[:-1]]))
    return mix(sums + lengths.astype(U))


def gram_hashes(symbols: np.ndarray, length: int) -> np.ndarray:
    """A hash of the ``length`` symbols from each place on, composed by doubling; the last length - 1 places are cut."""
    places = max(len(symbols) - length + 1, 0)
    block, size, power = symbols.astype(U), 1, 0xD6E8FEB86659FD93
    out, covered = np.zeros(places, U), 0
    while covered < length:
        if length & size:
            out = out * U(power) + block[covered : covered + places]
            covered += size
        rest = max(len(block) - size, 0)
        block = block[:rest] * U(power) + block[size : size + rest]
        size, power = size * 2, power * power % (1 << 64)
    return mix(out)


def sliding_min(values: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Least value of each ``width`` neighbours and the leftmost place where it stands."""
    place = np.arange(len(values), dtype=np.int64)
    best, have = values, 1
    while have < width and len(best):
        step = min(have, width - have)
        left, right = best[:-step], best[step:]
        take = right < left
        place = np.where(take, place[step:], place[:-step])
        best = np.where(take, right, left)
        have += step
    return best, place
