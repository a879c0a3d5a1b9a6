"""Find every window of symbols that also starts earlier, without comparing documents in pairs.

Both exact substring operators (words, bytes) stand on this routing; each brings its own structure for the comparison.

1. Every window of ``window`` symbols names one of its grams, the one of least hash: its anchor. Equal windows name equal
   anchors. Neighbouring windows mostly share theirs, so a document yields a few anchors, not one key for each window.
2. Anchor hashes are counted (partial sums before the shuffle). An anchor that stands once belongs to no repeated window.
3. The windows of the other anchors go, with their symbols, to the task that owns the anchor hash. There the operator's
   structure decides which windows stand there for the first time. Windows of an anchor that occurs more than ``hot`` times
   are anchored once more, by a gram halfway to a whole window, and those of one that occurs more than ``STEP * hot`` times by
   the whole window. Equal windows still meet, and all keys go through the same structure. Equal passages are reduced to their
   first place in the task that reads them and again as they arrive: no group of different passages is without a bound.
4. Only first places travel back to the documents. All other windows of repeated anchors are repeats.

Places are ordered by (document id, start). Rows that agree in id and text are the same place: a repeated row takes
nothing from its twin. Rows that share an id and differ in text are told apart by a checksum, which orders equal starts.
A null id is the smallest. Null and empty texts have no windows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldstate.llm import common as C

#: The windows of one anchor: start << 28 | checksum of the text << 8 | number of windows. A place: start << 20 | checksum.
START, COUNT, CHECK = 28, (1 << 8) - 1, (1 << 20) - 1
#: Occurrences, as a multiple of ``hot``, from which on an anchor's windows are anchored by all their symbols.
STEP = 16


@dataclass(frozen=True)
class Windows:
    """``unit``: "word" or "byte". Anchor grams have ``gram`` symbols. ``hot``: occurrences of an anchor kept together."""

    unit: str
    window: int
    gram: int
    hot: int = 2000
    #: False where ids are known to be unique; then texts need no checksum and the places are shorter.
    checked: bool = True

    def checksum(self, text: bytes) -> int:
        return crc32(text) & CHECK if self.checked else 0

    @property
    def choices(self) -> int:
        return self.window - self.gram + 1


def runs(data: np.ndarray, offsets: np.ndarray, w: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, row, run) for the windows of the given texts."""
    if w.unit == "word":
        starts, stops, bounds = C.word_spans(data, offsets)
        symbols = C.word_hashes(data, starts, stops)
    else:
        symbols, bounds = data.astype(C.U) + C.U(1), offsets
    grams = C.gram_hashes(symbols, w.gram)
    _, place = C.sliding_min(grams, w.choices)
    sizes = np.diff(bounds) - w.window + 1
    sizes = np.where(sizes > 0, sizes, 0)
    total = int(sizes.sum())
    if not total:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    start = np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    at = place[start + bounds[row]]
    new = np.ones(total, bool)
    new[1:] = (at[1:] != at[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, total))
    checks = np.fromiter((w.checksum(data[a:b]) for a, b in zip(offsets, offsets[1:])), np.int64, len(offsets) - 1)
    return grams[at[first]].view(np.int64), row[first], start[first] << START | checks[row[first]] << 8 | count


def all_runs(docs: DataFrame, w: Windows) -> DataFrame:
    """(anchor long, id long, run long) of every document; ``docs`` has (id, text), and a hash (scope) to keep scopes apart."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            data, offsets = C.buffers(batch.column(1))
            for a, b in C.slices(offsets):
                anchor, row, run = runs(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], w)
                if batch.num_columns > 2:
                    scope = batch.column(2).to_numpy(zero_copy_only=False)[a:b]
                    anchor = C.mix(anchor.view(C.U) ^ scope[row].view(C.U)).view(np.int64)
                yield pa.record_batch([pa.array(anchor), pa.array(ids[a:b][row]), pa.array(run)], ["anchor", "id", "run"])

    return docs.mapInArrow(emit, "anchor long, id long, run long")


def repeated_runs(docs: DataFrame, w: Windows, label: str, apart: bool = False) -> DataFrame:
    """Per document its runs whose anchor stands more than once (in two documents, if ``apart``): (id, runs array of
    (anchor, run, hot)). ``hot``: 0, or how often the windows are to be anchored by longer grams."""
    places = all_runs(docs, w)
    if apart:
        counted = places.groupBy("anchor").agg(F.count("*").alias("n"), F.min("id").alias("a"), F.max("id").alias("b")).filter("a < b").select("anchor", "n")
    else:
        counted = places.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1")
    # written, so that both sides of the join are plain shuffles and a hot anchor's places can be split among tasks
    counted = C.written(counted, f"{label}-anchors")
    hot = F.when(F.col("n") > STEP * w.hot, 2).when(F.col("n") > w.hot, 1).otherwise(0)
    kept = places.join(counted, "anchor").select("id", F.struct("anchor", "run", hot.alias("hot")).alias("r"))
    return C.written(kept.groupBy("id").agg(F.collect_list("r").alias("runs")), label)


def pieces(data: bytes, w: Windows) -> Callable[[int, int], bytes]:
    """symbols from..to of one text, as bytes."""
    if w.unit == "byte":
        return lambda a, b: data[a:b]
    words = data.split()
    return lambda a, b: b" ".join(words[a:b])


COLD = "anchor long, id long, run long, content binary"


def anchored_again(passages: dict[tuple[int, int, bytes], tuple[int, int]], w: Windows) -> Iterator[pa.RecordBatch]:
    """The windows of (anchor, hot, passage) -> first place, keyed by the anchor and a longer gram."""
    for hot, gram in ((1, (w.gram + w.window) // 2), (2, w.window)):
        held = [(anchor, passage, place) for (anchor, h, passage), place in passages.items() if h == hot]
        if not held:
            continue
        data, offsets = C.buffers(pa.array([passage for _, passage, _ in held], pa.binary()))
        for a, b in C.slices(offsets):
            anchors, row, run = runs(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], replace(w, gram=gram, checked=False))
            before = np.array([anchor for anchor, _, _ in held[a:b]], np.int64)
            anchors = C.mix(anchors.view(C.U) ^ before.view(C.U)[row]).view(np.int64)
            cuts = [pieces(passage, w) for _, passage, _ in held[a:b]]
            out: tuple[list, ...] = ([], [], [])
            for i, start, n in zip(row.tolist(), (run >> START).tolist(), (run & COUNT).tolist()):
                own, r = held[a + i][2]
                out[0].append(own), out[1].append((r >> 8) + (start << 20) << 8 | n)
                out[2].append(cuts[i](start, start + n + w.window - 1))
            for at in range(0, len(row), 10_000):
                yield cold_batch(anchors[at : at + 10_000], *(x[at : at + 10_000] for x in out))


def listed(runs_: pa.ListScalar) -> Iterator[tuple[int, int, int]]:
    """(anchor, run, hot) of one document."""
    values = runs_.values
    return zip(*(values.field(k).to_pylist() for k in range(3))) if values is not None else iter(())


def cold_runs(marked: DataFrame, w: Windows) -> DataFrame:
    """The symbols of every run: (anchor, id, run, content). A task keeps one place for each passage of a hot anchor that it
    meets, and only these are anchored again. With a fourth column of ``marked`` (need), which goes along, hot anchors are left out."""
    further = len(marked.columns) > 3

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passages: dict[tuple[int, int, bytes], tuple[int, int]] = {}
        held = 0
        for batch in batches:
            ids, texts, lists = batch.column(0), batch.column(1).cast(pa.large_binary()), batch.column(2)
            needs = batch.column(3).to_pylist() if further else None
            out: tuple[list, ...] = ([], [], [], [], [])[: 4 + further]
            size = 0
            for i in range(len(batch)):
                own, text = ids[i].as_py(), texts[i].as_py() or b""
                cut, check = pieces(text, w), w.checksum(text)
                for a, r, hot in listed(lists[i]):
                    if r >> 8 & CHECK != check or hot and further:
                        continue
                    content = cut(r >> START, (r >> START) + (r & COUNT) + w.window - 1)
                    if hot:
                        place = passages.get((a, hot, content))
                        if place is None:
                            held += len(content)
                        if place is None or (own, r) < place:
                            passages[a, hot, content] = (own, r)
                        continue
                    out[0].append(a), out[1].append(own), out[2].append(r), out[3].append(content)
                    size += len(content)
                    if further:
                        out[4].append(needs[i])
                if size > 4 * C.SLICE:
                    yield cold_batch(*out)
                    out, size = ([], [], [], [], [])[: 4 + further], 0
            if out[0]:
                yield cold_batch(*out)
            if held > 16 * C.SLICE:
                yield from anchored_again(passages, w)
                passages, held = {}, 0
        yield from anchored_again(passages, w)

    return marked.mapInArrow(emit, COLD + ", need long" * further)


def cold_batch(anchor: list, ids: list, run: list, content: list, *need: list) -> pa.RecordBatch:
    arrays = [pa.array(anchor, pa.int64()), pa.array(ids, pa.int64()), pa.array(run, pa.int64()), pa.array(content, pa.binary())]
    arrays += [pa.array(n, pa.int64()) for n in need]
    return pa.record_batch(arrays, ["anchor", "id", "run", "content", "need"][: len(arrays)])


#: The operator's structure: from the distinct (first place, content) of some anchors, in order, to the windows that
#: stand there for the first time, as (anchor's index, content's index, first window, number of windows).
Judge = Callable[[list[list[bytes]]], Iterator[tuple[int, int, int, int]]]


def whole_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, list[int]]]:
    """Tables of whole anchors from batches sorted by anchor, and where each anchor begins (and the last one ends)."""
    rest = None
    for batch in chain(batches, [None]):
        if batch is not None and not len(batch):
            continue
        table = rest if batch is None else pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
        if table is None or not len(table):
            continue
        anchors = table.column(0).combine_chunks().to_numpy()
        cut = len(anchors) if batch is None else int(np.searchsorted(anchors, anchors[-1]))  # the last anchor may go on
        rest = table.slice(cut)
        if cut:
            edges = np.flatnonzero(np.append(True, anchors[1:cut] != anchors[: cut - 1])).tolist()
            yield table.slice(0, cut), [*edges, cut]


def by_anchor(cold: DataFrame) -> DataFrame:
    return cold.repartition("anchor").sortWithinPartitions("anchor")


def first_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of batches sorted by (anchor, content, id, run), the first row of each anchor's each content."""
    last = None
    for batch in batches:
        if not len(batch):
            continue
        anchors, content = batch.column(0), batch.column(3)
        new = np.ones(len(batch), bool)
        new[0] = (anchors[0].as_py(), content[0].as_py()) != last
        new[1:] = pc.or_(pc.not_equal(anchors[1:], anchors[:-1]), pc.not_equal(content[1:], content[:-1])).to_numpy(zero_copy_only=False)
        last = (anchors[-1].as_py(), content[-1].as_py())
        yield batch.filter(pa.array(new))


def first_runs(cold: DataFrame, w: Windows, judge: Judge) -> DataFrame:
    """(id, start, n): windows that stand for the first time, for all anchors."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, edges in whole_anchors(first_places(batches)):
            yield judged(table, edges, judge)

    dealt = cold.repartition("anchor").sortWithinPartitions("anchor", "content", "id", "run")
    return dealt.mapInArrow(emit, "id long, start long, n long")


def judged(table: pa.Table, edges: list[int], judge: Judge) -> pa.RecordBatch:
    ids, run = table.column(1).to_pylist(), table.column(2).to_pylist()
    content = table.column(3).to_pylist()
    out: tuple[list, list, list] = ([], [], [])
    groups, owners = [], []
    for a, b in zip(edges, edges[1:]):
        first: dict[bytes, tuple[int, int]] = {}
        for i in range(a, b):
            place = (ids[i], run[i])
            if content[i] not in first or place < first[content[i]]:
                first[content[i]] = place
        ordered = sorted(first.items(), key=lambda x: x[1])
        if len(ordered) == 1:  # the same symbols everywhere: the first place keeps all its windows
            own, r = ordered[0][1]
            out[0].append(own), out[1].append(r >> 8), out[2].append(r & COUNT)
        else:
            groups.append([c for c, _ in ordered])
            owners.append([p for _, p in ordered])
    for g, k, s, n in judge(groups):
        own, r = owners[g][k]
        out[0].append(own), out[1].append((r >> 8) + (s << 20)), out[2].append(n)
    return pa.record_batch([pa.array(x, pa.int64()) for x in out], ["id", "start", "n"])


def stretches(flags: np.ndarray) -> list[tuple[int, int]]:
    """(start, length) of the runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [(int(a), int(b - a)) for a, b in zip(edge[::2], edge[1::2])]


def repeats_ids(keyed: DataFrame) -> bool:
    """Whether any ``_key`` stands twice; reads nothing but the ids."""
    return not keyed.groupBy("_key").count().filter("count > 1").isEmpty()


def marked_documents(docs: DataFrame, w: Windows, judge: Judge, label: str, text_col: str = "text") -> DataFrame:
    """``docs`` with two more columns for ``covered``: ``_runs`` (repeated anchors' windows) and ``_firsts`` (windows first there).

    ``docs`` needs a column ``_key`` from ``common.key``. If it holds nothing else but the text, one shuffle of the texts
    serves both joins.
    """
    found = repeated_runs(docs.select(F.col("_key").alias("id"), F.col(text_col).alias("text")), w, label).withColumnRenamed("id", "_key")
    marked = docs.select("_key", text_col).join(found, "_key")
    first = first_runs(cold_runs(marked, w), w, judge)
    firsts = first.groupBy(F.col("id").alias("_key")).agg(F.collect_list(F.struct("start", "n")).alias("_firsts"))
    compact = found.select("_key", F.transform("runs", lambda r: r["run"]).alias("_runs"))
    return docs.join(compact.join(firsts, "_key", "left"), "_key", "left")


def covered(length: int, check: int, runs_: np.ndarray | None, starts: np.ndarray | None, counts: np.ndarray | None, window: int) -> np.ndarray:
    """Which of ``length`` symbols lie in a repeated window."""
    if runs_ is not None:
        runs_ = runs_[runs_ >> 8 & CHECK == check]
    if runs_ is None or not len(runs_):
        return np.zeros(length, bool)
    repeated = spread(length, runs_ >> START, runs_ & COUNT)
    if starts is not None and len(starts):
        own = starts & CHECK == check
        repeated &= ~spread(length, starts[own] >> 20, counts[own])
    return spread(length, np.flatnonzero(repeated), window)


def spread(length: int, starts: np.ndarray, counts: np.ndarray | int) -> np.ndarray:
    """Which of ``length`` places lie in start .. start + count."""
    step = np.zeros(length + 1, np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + counts, -1)
    return np.cumsum(step)[:length] > 0


def covered_row(length: int, text: bytes, runs_: pa.ListScalar, firsts: pa.ListScalar, w: Windows) -> np.ndarray:
    """``covered`` for one row of Arrow values as ``marked_documents`` gives them."""
    if runs_.values is None:
        return np.zeros(length, bool)
    starts = counts = None
    if firsts.values is not None:
        starts, counts = (firsts.values.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
    return covered(length, w.checksum(text), runs_.values.to_numpy(zero_copy_only=False), starts, counts, w.window)
