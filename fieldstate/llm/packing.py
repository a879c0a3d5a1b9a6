"""Packing of tokenised documents into sequences of a fixed window.

Documents are cut into full windows, a half window where the rest reaches one, a part on a grid of ``window / UNITS``
tokens, and a tail shorter than the grid. Shallow combinations of grid parts that fill a window exactly are enumerated;
non-negative least squares finds how often to repeat each so that together they use up the histogram of parts. Rounded
down and held to what is there, that packs nearly everything without padding. What is left, tails first of all, goes
greedily, largest first. All of this looks at the histogram alone, whose size does not depend on the data; Spark then
numbers the parts of each length and reads their places from the plan.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from struct import pack
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldstate.llm import common as C

#: Grid steps in a window, parts of a combination, end-of-text id, groups per length in which parts are numbered.
UNITS, DEPTH, END, SALTS = 64, 5, 1, 256
#: Chunks whose ids a worker remembers (and words of chunks), and their greatest length.
REMEMBERED, SHORT = 800_000, 64
#: A space between two other separators, where a cut could change how the pre-tokeniser reads the run.
BETWEEN = re.compile(r"\s \s")

#: A word of Latin letters and marks after it, and the same on the next line; the apostrophe is not among them, as some letters after it join it.
LETTERS, MARKS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", r"!-&(-/:-@\[-`{-~"
WORD, WORD_PART = re.compile(f"([{LETTERS}]+)([{MARKS}]*)(?:(\n[{LETTERS}]+)([{MARKS}]*))?"), re.compile(f"[{LETTERS}]*[{MARKS}]*|\\s*")
#: Byte-level characters of the bytes that do not stand for themselves among those of letters.
BYTES = {b: 0x100 + 33 + b - 127 for b in range(127, 161)} | {0xAD: 0x143}

_memory: dict[str, tuple[dict[str, bytes], dict[str, bytes]]] = {}
_words: dict[str, dict[str, bytes]] = {}
_loaded: dict = {}


def tokenizer(path: str):
    """The tokenizer of a worker, loaded once."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _loaded[path], _memory[path], _words[path] = Tokenizer.from_file(path), ({}, {}), {}
    return _loaded[path]


def encoded(texts: list[str], path: str) -> list[bytes]:
    """Ids of each text, as little-endian unsigned 32-bit values.

    Byte-level pre-tokens hold a space only as their first character, so a text may be cut before a space that follows a
    non-space or precedes one, and ids of the chunks joined are the ids of the text. Chunks recur and are remembered,
    without the space before them. Texts with a space between two other separators, or at either end, go to the tokenizer whole.
    """
    tok = tokenizer(path)
    heads: list[str] = []
    rests: list[list[str]] = []
    for text in texts:
        if text[:1] == " " or text[-1:] == " " or "  " in text or BETWEEN.search(text):
            heads.append(text), rests.append([])
        else:
            head, *rest = text.split(" ")
            heads.append(head), rests.append(rest)
    found = set().union(*rests)
    memory, older = _memory[path]
    new = found.difference(memory)
    if len(memory) + len(new) > REMEMBERED // 2:
        # chunks used since the last turn are taken over as they come up again, the others are forgotten
        memory, older = _memory[path] = {}, memory
        new = found
    again = {x: older[x] for x in new if x in older}
    memory.update(again)
    new = new.difference(again)
    memory.update(chunk_ids(new, path))
    ids = memory.__getitem__
    out = [e + b"".join(map(ids, rest)) for e, rest in zip(single_ids(heads, tok), rests)]
    for x in new:
        if len(x) > SHORT:
            del memory[x]
    return out


def single_ids(texts: list[str], tok) -> Iterator[bytes]:
    """Ids of each text, one by one."""
    for at in range(0, len(texts), 4096):
        for e in tok.encode_batch_fast(texts[at : at + 4096], add_special_tokens=False):
            yield np.array(e.ids, dtype="<u4").tobytes()


def chunk_ids(chunks: set[str], path: str) -> Iterator[tuple[str, bytes]]:
    """(chunk, ids of the chunk with a space before it).

    Of a word and marks after it, and of the same on a next line, each and the line end is a pre-token that the model takes as
    it is; words recur with other marks and are remembered. All other chunks go through the whole tokenizer.
    """
    tok, words = tokenizer(path), _words[path]
    if len(words) + 2 * len(chunks) > REMEMBERED:
        words.clear()
    model, plain, others = tok.model, takes_words(tok), []

    def word_ids(word: str, before: str) -> bytes:
        letters = word if word.isascii() else word.encode().decode("latin-1").translate(BYTES)
        some = [t.id for t in model.tokenize(before + letters)]
        return pack(f"<{len(some)}I", *some)

    for x in chunks:
        m = WORD.fullmatch(x) if plain and len(x) <= SHORT else None
        if not m:
            others.append(x)
            continue
        word, marks, line, marks_of_line = m.groups()
        ids = words.get(word)
        if ids is None:
            ids = words[word] = word_ids(word, "\u0120")
        if marks:
            if marks not in words:
                words[marks] = next(single_ids([marks], tok))
            ids += words[marks]
        if line:
            if line not in words:
                words[line] = next(single_ids(["\n"], tok)) + word_ids(line[1:], "")
            ids += words[line]
            if marks_of_line:
                if marks_of_line not in words:
                    words[marks_of_line] = next(single_ids([marks_of_line], tok))
                ids += words[marks_of_line]
        yield x, ids
    yield from zip(others, single_ids([" " + x for x in others], tok))


def takes_words(tok) -> bool:
    """Whether letters and marks are pre-tokens of byte-level characters, which nothing changes or cuts before."""
    if tok.normalizer is not None or tok.pre_tokenizer is None:
        return False
    if any(WORD_PART.fullmatch(a.content) for a in tok.get_added_tokens_decoder().values()):
        return False
    return [t for t, _ in tok.pre_tokenizer.pre_tokenize_str(" a\u00e9\u00c0.,\nb")] == ["\u0120a\u00c3\u00a9\u00c3\u0122", ".,", "\u010a", "b"]


def cuts(n: int, window: int) -> list[tuple[int, int]]:
    """(start, length) of the parts of a document of ``n`` tokens."""
    out = [(s, window) for s in range(0, n - window + 1, window)]
    at, rest = n - n % window, n % window
    for size in (window // 2 if rest >= window // 2 else 0, rest % (window // 2) // (window // UNITS) * (window // UNITS), rest % (window // UNITS)):
        if size:
            out.append((at, size))
            at += size
    return out


PARTS = "id long, start long, length long, ids_crc32 long, doc_tokens long, salt int"


def parts(docs: DataFrame, path: str, window: int) -> DataFrame:
    """The parts of every document (id, text)."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = 0
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).fill_null("")
            lengths = np.append(0, np.cumsum([len(x.as_buffer()) if x.is_valid else 0 for x in texts.cast(pa.large_binary())]))
            for a, b in C.slices(lengths):
                rows = []
                for own, tokens in zip(ids[a:b], encoded(texts[a:b].to_pylist(), path)):
                    tokens += END.to_bytes(4, "little")
                    n = len(tokens) // 4
                    for s, size in cuts(n, window):
                        rows.append((own, s, size, crc32(tokens[4 * s : 4 * (s + size)]), n, count % SALTS))
                        count += 1
                arrays = [pa.array(x, pa.int64()) for x in list(zip(*rows))[:5]] + [pa.array([r[5] for r in rows], pa.int32())]
                yield pa.record_batch(arrays, [x.split()[0] for x in PARTS.split(", ")])

    return docs.mapInArrow(emit, PARTS)


def combinations(units: int = UNITS, largest: int = UNITS // 2, depth: int = DEPTH) -> list[tuple[int, ...]]:
    """All ways to fill ``units`` with at most ``depth`` parts of at most ``largest``, largest part first."""
    out: list[tuple[int, ...]] = []

    def extend(chosen: tuple[int, ...], room: int) -> None:
        if room == 0:
            out.append(chosen)
        elif len(chosen) < depth:
            for x in range(min(room, chosen[-1] if chosen else largest), 0, -1):
                if x * (depth - len(chosen)) < room:
                    break
                extend((*chosen, x), room - x)

    extend((), units)
    return out


def nonnegative_least_squares(a: np.ndarray, b: np.ndarray, limit: int = 1000) -> np.ndarray:
    """x >= 0 that minimises |a x - b|, by an active set: columns enter by gradient and leave when they would turn negative."""
    x, active = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    for _ in range(limit):
        gradient = a.T @ (b - a @ x)
        gradient[active] = -np.inf
        best = int(np.argmax(gradient))
        if gradient[best] <= 1e-9 * max(1.0, float(np.abs(b).max())):
            break
        active[best] = True
        while True:
            inner = np.zeros_like(x)
            inner[active] = np.linalg.lstsq(a[:, active], b, rcond=None)[0]
            falling = active & (inner <= 0)
            if not falling.any():
                x = inner
                break
            step = np.min(x[falling] / np.maximum(x[falling] - inner[falling], 1e-300))
            x = x + step * (inner - x)
            active &= x > 1e-12
            x[~active] = 0
    return x


def plan(histogram: dict[int, int], window: int) -> list[tuple[int, int, int, int, int]]:
    """Places of all parts: (length, first rank, first sequence, parts of that length in a sequence, offset), by length and rank."""
    grid = window // UNITS
    left = dict(histogram)
    used = dict.fromkeys(histogram, 0)
    out: list[tuple[int, int, int, int, int]] = []
    sequences = 0

    def take(pattern: dict[int, int], times: int) -> None:
        nonlocal sequences
        offset = 0
        for length, n in pattern.items():
            out.append((length, used[length], sequences, n, offset))
            used[length] += n * times
            left[length] -= n * times
            offset += n * length
        sequences += times

    if left.get(window):
        take({window: 1}, left[window])
    ways = combinations()
    usable = [w for w in ways if all(left.get(x * grid) for x in w)]
    if usable:
        a = np.zeros((UNITS // 2, len(usable)))
        for k, w in enumerate(usable):
            for x in w:
                a[x - 1, k] += 1
        b = np.array([left.get((x + 1) * grid, 0) for x in range(UNITS // 2)], float)
        repeats = nonnegative_least_squares(a, b)
        for k in np.argsort(-repeats, kind="stable"):
            pattern: dict[int, int] = {}
            for x in usable[k]:
                pattern[x * grid] = pattern.get(x * grid, 0) + 1
            times = min(int(repeats[k] + 1e-6), *(left[s] // n for s, n in pattern.items()))
            if times > 0:
                take(pattern, times)
    while any(left.values()):
        pattern, room = {}, window
        for length in sorted((s for s, n in left.items() if n), reverse=True):
            n = min(room // length, left[length])
            if n:
                pattern[length], room = n, room - n * length
        take(pattern, min(left[s] // n for s, n in pattern.items()))
    return sorted(out)


def packed(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", window: int = 2048) -> DataFrame:
    """Pieces of all documents and their places: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every document ends with the id 1; null and empty texts consist of it alone, and all their rows take part. Each id lies
    in one piece; sequences hold at most ``window`` ids, gapless from offset 0, and are padded to the window unless their
    length is a power of two. Rows that repeat an id are documents of their own; a null id stays null. An empty table gives
    no pieces. Other columns are left out.
    """
    brief = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    pieces = C.written(parts(brief, path, window), "pieces")
    counts = pieces.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most UNITS + 32 lengths
    places = np.array(plan(histogram, window), dtype=np.int64).reshape(-1, 5)
    key = places[:, 0] << 48 | places[:, 1]

    @F.arrow_udf("sequence_id long, offset long")
    def placed(length: pa.Array, rank: pa.Array) -> pa.Array:
        size, r = length.to_numpy(zero_copy_only=False), rank.to_numpy(zero_copy_only=False)
        p = places[np.searchsorted(key, size << 48 | r, side="right") - 1] if len(size) else places[:0]
        local = r - p[:, 1]
        arrays = [pa.array(p[:, 2] + local // p[:, 3]), pa.array(p[:, 4] + local % p[:, 3] * size)]
        return pa.StructArray.from_arrays(arrays, ["sequence_id", "offset"])

    within = Window.partitionBy("length", "salt").orderBy("id", "start", "ids_crc32")
    ranked = pieces.withColumn("rank", F.row_number().over(within) - 1).join(bases, ["length", "salt"])
    out = ranked.withColumn("p", placed("length", F.col("rank").cast("long") + F.col("base")))
    return out.select(F.col("id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", "p.sequence_id", "p.offset")
