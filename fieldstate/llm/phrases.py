"""Phrase collocations, counted in hash-array tries.

Counting goes by phrase length. A phrase can occur often only if both phrases that it extends by a word do, so each length
looks only at places where these two are in the table of the length before; a bitmap of fixed size, sent to all tasks, rules
out the other places (it errs on the side of counting). A task numbers the words it meets and counts in a trie over these
numbers: the first word leads to a hash container of the remaining words, and a container that grows too large bursts into
one per second word. A trie that grows too large spills whole subtrees as sorted runs, largest first. The runs of all tasks
are merged per prefix partition: by language, first two words, and a salt that splits the partitions of common prefixes.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldstate.llm import common as C

#: Bits of a word number in a container's keys; three numbers fit one key. A task never numbers more words than that.
BITS = 20
#: Entries of a container before it bursts, entries and numbered words of a task's tries before they spill, rows of a batch,
#: bytes of text that are counted at once.
BURST, ENTRIES, WORDS, OUT, TEXTS = 4096, 400_000, 250_000, 20_000, 1 << 22
#: Bits of the table of frequent phrases that is sent to the tasks (8 MB), partitions that share one prefix.
TABLE_BITS, SALTS = 26, 16
#: How a text falls into pieces and words, on bytes: piece separators become line ends, tabs become spaces.
PIECES = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t", b"\n" * 10 + b" ")
RUN = "lang string, phrase string, n long"


class HatTrie:
    """Counts of sequences of word numbers, all of one length; keys of containers pack the words after the prefix.

    Single words are sequences of two that begin with 0, so they share one container.
    """

    def __init__(self, length: int, burst: int = BURST):
        self.length, self.burst, self.entries = length, burst, 0
        self.boxes: dict[tuple[int, ...], dict[int, int]] = {}
        self.under: dict[int, list[tuple[int, ...]]] = {}
        self.inner: set[int] = set()
        self.sizes: dict[int, int] = {}

    def add(self, first: int, keys: list[int], counts: list[int]) -> None:
        """Count keys, given in order, below a first word."""
        if first not in self.inner:
            box = self._box((first,))
            self._count(first, box, keys, counts)
            if len(box) <= self.burst or self.length < 3:
                return
            self.inner.add(first)
            self.under[first].remove((first,))
            del self.boxes[(first,)]
            self.entries -= len(box)
            self.sizes[first] -= len(box)
            keys = sorted(box)
            counts = [box[k] for k in keys]
        shift = BITS * (self.length - 2)
        mask, at = (1 << shift) - 1, 0
        while at < len(keys):
            second, end = keys[at] >> shift, at + 1
            while end < len(keys) and keys[end] >> shift == second:
                end += 1
            self._count(first, self._box((first, second)), [k & mask for k in keys[at:end]], counts[at:end])
            at = end

    def _box(self, prefix: tuple[int, ...]) -> dict[int, int]:
        if prefix not in self.boxes:
            self.boxes[prefix] = {}
            self.under.setdefault(prefix[0], []).append(prefix)
        return self.boxes[prefix]

    def _count(self, first: int, box: dict[int, int], keys: list[int], counts: list[int]) -> None:
        before = len(box)
        for k, n in zip(keys, counts):
            box[k] = box.get(k, 0) + n
        self.entries += len(box) - before
        self.sizes[first] = self.sizes.get(first, 0) + len(box) - before

    def spill(self, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Remove whole subtrees, largest first, until at most ``keep`` entries are left: first words, keys, counts."""
        prefixes, boxes = [], []
        for first in sorted(self.sizes, key=self.sizes.get, reverse=True):
            if self.entries <= keep:
                break
            for prefix in self.under.pop(first):
                prefixes.append(prefix)
                boxes.append(self.boxes.pop(prefix))
            self.entries -= self.sizes.pop(first)
            self.inner.discard(first)
        lengths = np.array([len(b) for b in boxes], np.int64)
        total = int(lengths.sum())
        keys = np.fromiter(chain.from_iterable(boxes), np.int64, total)
        counts = np.fromiter(chain.from_iterable(b.values() for b in boxes), np.int64, total)
        second = np.array([p[1] if len(p) > 1 else 0 for p in prefixes], np.int64) << BITS * (self.length - 2)
        first = np.array([p[0] for p in prefixes], np.int64)
        return np.repeat(first, lengths), keys | np.repeat(second, lengths), counts


class Numbers(dict):
    """Numbers of the words of one language in a task; 0 is the end of a piece, or a word that is in no frequent phrase."""

    def __init__(self, lang: str):
        super().__init__()
        self.seed = seed(lang)
        self.words, self.hashes = [b""], np.zeros(1, C.U)

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.words)
        self.words.append(word)
        return n

    def of(self, texts: list[str], table: np.ndarray | None) -> np.ndarray:
        """Word numbers of texts, with a 0 after each piece. Only A-Z are lower-cased.

        Words that are not in the table are no part of a frequent phrase and count as the end of a piece.
        """
        joined = "\n".join(["", *texts, ""]).encode().lower().translate(PIECES).replace(b"\n", b" \n ")
        coded = pa.compute.split_pattern(pa.array([joined], pa.large_binary()), b" ").flatten().dictionary_encode()
        data, offsets = C.buffers(coded.dictionary)
        hashes = C.word_hashes(data, offsets[:-1], offsets[1:]) + self.seed
        empty = np.diff(offsets) == 0
        good = ~empty & (data[np.minimum(offsets[:-1], len(data) - 1)] != 0x0A)  # a line end stands for itself alone
        if table is not None:
            good &= present(table, C.gram_hashes(hashes, 1))
        where, number = np.flatnonzero(good), np.zeros(len(good), np.int64)
        known = len(self.words)
        number[where] = np.fromiter(map(self.__getitem__, coded.dictionary.take(pa.array(where)).to_pylist()), np.int64, len(where))
        new = np.sort(where[number[where] >= known])
        self.hashes = np.append(self.hashes, hashes[new[np.argsort(number[new])]])
        codes = coded.indices.to_numpy()
        return number[codes[~empty[codes]]]


def seed(lang: str) -> np.uint64:
    data = np.frombuffer(lang.encode() + b"|", np.uint8)
    return C.word_hashes(data, np.zeros(1, np.int64), np.array([len(data)]))[0]


def present(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes & C.U((1 << TABLE_BITS) - 1)
    return (table[(at >> C.U(6)).astype(np.int64)] >> (at & C.U(63))) & C.U(1) > 0


def places(ids: np.ndarray, hashes: np.ndarray, length: int, table: np.ndarray | None) -> np.ndarray:
    """Where a phrase of ``length`` words stands in one piece, with both its shorter phrases in the table if there is one."""
    n = len(ids) - length + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    word = ids > 0
    whole = word[:n].copy()
    for k in range(1, length):
        whole &= word[k : k + n]
    if table is not None:
        known = present(table, C.gram_hashes(hashes[ids], length - 1))
        whole &= known[:-1] & known[1:]
    return np.flatnonzero(whole)


def distinct(first: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (first, key), in order, and how often each occurs."""
    order = np.lexsort((key, first))
    first, key = first[order], key[order]
    start = np.flatnonzero(np.append(True, (first[1:] != first[:-1]) | (key[1:] != key[:-1]))[: len(first)])
    return first[start], key[start], np.diff(np.append(start, len(first)))


def run_of(lang: str, words: list[bytes], length: int, spilled: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.RecordBatch:
    """Spilled subtrees as a run that is sorted by words."""
    first, key, count = spilled
    ids = [key >> BITS * k & (1 << BITS) - 1 for k in range(length - 2, -1, -1)]
    ids = [first, *ids] if length > 1 else [key]
    names = pa.array(words, pa.binary())
    rank = np.empty(len(words), np.int64)
    rank[pa.compute.sort_indices(names).to_numpy()] = np.arange(len(words))
    order = np.lexsort([rank[x] for x in ids[::-1]])
    phrases = pa.compute.binary_join_element_wise(*[names.take(pa.array(x[order])) for x in ids], b" ")
    return pa.record_batch([pa.array([lang] * len(order)), phrases.cast(pa.string()), pa.array(count[order])], ["lang", "phrase", "n"])


def runs(docs: DataFrame, length: int, words, shorter) -> DataFrame:
    """Sorted runs (lang, phrase, n) of phrases of one length.

    ``words`` and ``shorter`` are broadcasts of the bitmaps of frequent words and of frequent phrases of one word less, None
    where there is none to look at.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, known = (b.value if b else None for b in (words, shorter))
        state: dict[str, tuple[Numbers, HatTrie]] = {}

        def spilled(keep: int) -> Iterator[pa.RecordBatch]:
            for lang, (numbers, trie) in state.items():
                run = trie.spill(keep // len(state))
                if len(run[0]):
                    whole = run_of(lang, numbers.words, length, run)
                    yield from (whole.slice(at, OUT) for at in range(0, whole.num_rows, OUT))

        for batch in batches:
            for a, b in C.slices(C.buffers(batch.column(1))[1], TEXTS):
                langs, texts = batch.column(0)[a:b].to_pylist(), batch.column(1)[a:b].to_pylist()
                by_lang: dict[str, list[str]] = {}
                for lang, text in zip(langs, texts):
                    by_lang.setdefault(lang, []).append(text)
                for lang, own in by_lang.items():
                    numbers, trie = state.setdefault(lang, (Numbers(lang), HatTrie(max(length, 2))))
                    ids = numbers.of(own, frequent)
                    at = places(ids, numbers.hashes, length, known)
                    first, key = (ids[at] if length > 1 else np.zeros(len(at), np.int64)), np.zeros(len(at), np.int64)
                    for k in range(min(length - 1, 1), length):
                        key = key << BITS | ids[at + k]
                    first, key, count = distinct(first, key)
                    head = np.flatnonzero(np.append(True, first[1:] != first[:-1])[: len(first)])
                    key, count = key.tolist(), count.tolist()
                    for x, i, j in zip(first[head].tolist(), head.tolist(), [*head[1:].tolist(), len(key)]):
                        trie.add(x, key[i:j], count[i:j])
                    if sum(t.entries for _, t in state.values()) > ENTRIES:
                        yield from spilled(ENTRIES // 2)
                    if sum(len(n.words) for n, _ in state.values()) > WORDS:
                        yield from spilled(0)
                        state.clear()
        yield from spilled(0)

    return docs.mapInArrow(emit, RUN)


def prefix(length: int) -> list[Column]:
    """Columns that partition the runs: language, first two words, and a salt from the whole phrase."""
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS)) if length > 2 else F.lit(0)
    return [F.col("lang"), F.substring_index("phrase", " ", 2).alias("prefix"), salt.alias("salt")]


def merged(rows: DataFrame, length: int) -> DataFrame:
    """Total counts (lang, phrase, n) of all runs; the partitioning by prefix serves the aggregation."""
    keyed = rows.select(*prefix(length), "phrase", "n").repartition("lang", "prefix", "salt")
    return keyed.groupBy("lang", "prefix", "salt", "phrase").agg(F.sum("n").alias("n")).select("lang", "phrase", "n")


def bits_of(frequent: DataFrame, length: int) -> np.ndarray:
    """The hashes of frequent phrases as bits; at most 2 ** (TABLE_BITS - 6) words reach the driver, however many there are."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            for lang in dict.fromkeys(langs):
                own = batch.column(1).filter(pa.array(langs == lang)).cast(pa.large_binary())
                data, offsets = C.buffers(pa.compute.split_pattern(own, b" ").flatten())
                hashes = C.word_hashes(data, offsets[:-1], offsets[1:]) + seed(lang)
                at = (C.gram_hashes(hashes, length)[::length] & C.U((1 << TABLE_BITS) - 1)).view(np.int64)
                yield pa.record_batch([pa.array(at >> 6), pa.array(np.int64(1) << (at & 63))], ["w", "b"])

    rows = frequent.select("lang", "phrase").mapInArrow(emit, "w long, b long").groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(1 << (TABLE_BITS - 6), np.int64)
    out[rows["w"].to_numpy()] = rows["b"].to_numpy()
    return out.view(C.U)


def counted(docs: DataFrame, longest: int, least: int, lang_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """((lang, n): all word occurrences; (lang, words, phrase, n): every phrase of at most ``longest`` words with n >= least)."""
    brief = docs.select(
        F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    )
    every_word = C.written(merged(runs(brief, 1, None, None), 1), "words")
    totals = every_word.groupBy("lang").agg(F.sum("n").alias("n"))
    levels, tables = [C.written(every_word.filter(F.col("n") >= least), "phrases1")], []
    for length in range(2, longest + 1):
        tables.append(docs.sparkSession.sparkContext.broadcast(bits_of(levels[-1], length - 1)))
        found = merged(runs(brief, length, tables[0], tables[-1] if length > 2 else None), length)
        levels.append(C.written(found.filter(F.col("n") >= least), f"phrases{length}"))
    rows = [level.select("lang", F.lit(k).alias("words"), "phrase", "n") for k, level in enumerate(levels, 1)]
    every = rows[0]
    for more in rows[1:]:
        every = every.unionByName(more)
    return totals, every


def words_between(split: Column, first: Column | int, n: Column | int) -> Column:
    return F.array_join(F.slice(split, first, n), " ")


def score() -> Column:
    """floor(2000000 a / (l + r)) in decimals, as the product may pass 64 bits."""
    return F.expr("cast((cast(a as decimal(19, 0)) * 2000000BD) div (cast(l as decimal(19, 0)) + cast(r as decimal(19, 0))) as bigint)").alias("score")


def collocations(
    docs: DataFrame, longest: int = 4, least: int = 30, covered: int = 80, lang_col: str = "lang", text_col: str = "text"
) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of all phrases of 2 to ``longest`` words that hold together.

    Texts fall into pieces at ``[.,;:!?\\x0A-\\x0D]`` and these into words ``[^\\x20\\x09]+``; only A-Z are lower-cased. All
    counts are per language, NULL counting as ``und``: ``n`` of word occurrences, ``a`` of the phrase (at least ``least``),
    ``l`` and ``r`` of its two parts at the cut that scores lowest, ties to the first. ``score`` is
    ``floor(2000000 * a / (l + r))`` in exact arithmetic. A phrase inside a longer frequent one (``longest`` words at most)
    that occurs in at least ``covered`` percent of its places is dropped. A null text counts as empty; empty texts and tables
    give no rows; every row counts, also where ids repeat; other columns are not read. At most 4 words.
    """
    if not 2 <= longest <= 4:
        raise ValueError("longest must be 2, 3 or 4")
    totals, every = counted(docs, longest, least, lang_col, text_col)
    candidates = every.filter("words > 1").withColumn("split", F.split("phrase", " "))
    cut = F.explode(F.sequence(F.lit(1), F.col("words") - 1))
    cuts = candidates.select("lang", "phrase", F.col("n").alias("a"), "words", "split", cut.alias("k"))
    cuts = cuts.withColumns({
        "first": words_between(F.col("split"), F.lit(1), F.col("k")), "rest": words_between(F.col("split"), F.col("k") + 1, F.col("words") - F.col("k"))
    }).drop("split", "words")
    part = lambda name, n: every.select("lang", F.col("phrase").alias(name), F.col("n").alias(n))
    scored = cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"]).select("*", score())
    best = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    size = F.explode(F.expr("sequence(2, words - 1)"))
    sizes = candidates.filter("words > 2").select("lang", "split", "words", F.col("n").alias("outer"), size.alias("size"))
    starts = sizes.select("lang", "split", "size", "outer", F.explode(F.expr("sequence(1, words - size + 1)")).alias("start"))
    inside = starts.select("lang", words_between(F.col("split"), F.col("start"), F.col("size")).alias("phrase"), "outer")
    inside = inside.groupBy("lang", "phrase").agg(F.max("outer").alias("outer"))
    is_covered = F.coalesce(F.col("outer").cast("decimal(19, 0)") * 100 >= F.col("a").cast("decimal(19, 0)") * covered, F.lit(False))
    kept = best.join(inside, ["lang", "phrase"], "left").filter(~is_covered)
    return kept.join(totals, "lang").select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def top(found: DataFrame, limit: int = 2000) -> DataFrame:
    """Each language's first ``limit`` phrases by score, count, and phrase in byte order, with ``rank`` from 1.

    The rank filter holds back all but ``limit`` rows per language and task before the shuffle.
    """
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def sql(longest: int = 4, least: int = 30, covered: int = 80, limit: int = 2000) -> str:
    """The same over whole texts, counting every phrase of every piece at once."""
    grams = "\nUNION ALL\n".join(
        f"SELECT lang, {k} AS words, list_aggregate(w[i:i + {k - 1}], 'string_agg', ' ') AS phrase FROM spots WHERE i + {k - 1} <= len(w)" for k in range(1, longest + 1)
    )
    return f"""
WITH texts AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), pieces AS (
  SELECT lang, unnest(string_split_regex(text, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM texts
), worded AS (
  SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM pieces
), spots AS (
  SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM worded
), grams AS (
{grams}
), counts AS (
  SELECT lang, words, phrase, count(*) AS n FROM grams GROUP BY ALL
), totals AS (
  SELECT lang, sum(n) AS n FROM counts WHERE words = 1 GROUP BY lang
), frequent AS (
  SELECT *, string_split(phrase, ' ') AS w FROM counts WHERE n >= {least}
), cuts AS (
  SELECT lang, phrase, n AS a, w, words, unnest(range(1, words)) AS k FROM frequent WHERE words > 1
), scored AS (
  SELECT c.lang, c.phrase, c.a, c.k, x.n AS l, y.n AS r, (2000000::HUGEINT * c.a) // (x.n::HUGEINT + y.n) AS score
  FROM cuts c
  JOIN frequent x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.k], ' ')
  JOIN frequent y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.k + 1:], ' ')
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), longer AS (
  SELECT lang, words, phrase, n FROM frequent WHERE words > 2
), kept AS (
  SELECT b.* FROM best b
  WHERE NOT EXISTS (
    SELECT 1 FROM longer g
    WHERE g.lang = b.lang AND contains(' ' || g.phrase || ' ', ' ' || b.phrase || ' ') AND g.phrase <> b.phrase AND 100 * g.n >= {covered} * b.a
  )
), ranked AS (
  SELECT k.lang, row_number() OVER (PARTITION BY k.lang ORDER BY k.score DESC, k.a DESC, k.phrase) AS rank, k.phrase, k.a, k.l, k.r, t.n, k.score
  FROM kept k JOIN totals t USING (lang)
)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= {limit}
"""
