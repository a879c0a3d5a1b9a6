"""Substring deduplication by words: matching statistics against suffix automata of reference shards.

A reference shard holds the distinct passages of one anchor (see ``anchors``), so a shard stays small at any corpus size
and every document passage meets exactly the shard that can match it; automata of the whole corpus would have to be sent
to every task. Passages pass in the order of their places: the automaton of the earlier ones gives, for every word, the
longest match that ends there. Windows whose match reaches the threshold are repeats; then the passage joins the shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldstate.llm import anchors as A
from fieldstate.llm import common as C


class SuffixAutomaton:
    """Online automaton of all factors of the passages added; symbols are any hashable values."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]

    def add(self, symbols: list) -> None:
        """Add one passage; no factor crosses from one passage into another."""
        nxt, link, length = self.next, self.link, self.length
        last = 0
        for x in symbols:
            known = nxt[last].get(x)
            if known is not None:
                last = known if length[known] == length[last] + 1 else self._clone(last, x, known)
                continue
            new = len(nxt)
            nxt.append({}), length.append(length[last] + 1), link.append(0)
            p = last
            while p >= 0 and x not in nxt[p]:
                nxt[p][x] = new
                p = link[p]
            if p >= 0:
                q = nxt[p][x]
                link[new] = q if length[q] == length[p] + 1 else self._clone(p, x, q)
            last = new

    def _clone(self, p: int, x, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        new = len(nxt)
        nxt.append(dict(nxt[q])), length.append(length[p] + 1), link.append(link[q])
        link[q] = new
        while p >= 0 and nxt[p].get(x) == q:
            nxt[p][x] = new
            p = link[p]
        return new

    def matching(self, symbols: list) -> list[int]:
        """For every symbol the length of the longest factor that ends there."""
        nxt, link, length = self.next, self.link, self.length
        state = size = 0
        out = []
        for x in symbols:
            while state and x not in nxt[state]:
                state = link[state]
                size = length[state]
            if x in nxt[state]:
                state, size = nxt[state][x], size + 1
            out.append(size)
        return out


def judge(window: int) -> A.Judge:
    def firsts(shards: list[list[bytes]]) -> Iterator[tuple[int, int, int, int]]:
        for g, passages in enumerate(shards):
            reference = SuffixAutomaton()
            for k, passage in enumerate(passages):
                words = passage.split(b" ")
                size = np.array(reference.matching(words)[window - 1 :])
                for s, n in A.stretches(size < window):
                    yield g, k, s, n
                if k + 1 < len(passages):
                    reference.add(words)

    return firsts


RESULT = "n_words long, n_removed long, kept string"


def substring_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, gram: int = 5, hot: int = 2000
) -> DataFrame:
    """All rows and columns of ``docs`` and a struct ``substring`` (n_words, n_removed, kept).

    Words are the runs of characters other than the six ASCII separators. A word goes if a window of ``window`` words that
    covers it also starts earlier (smaller id, or same id and earlier start), judged on the input. ``kept`` is the text of
    the other words, joined by single spaces. Texts without words, empty and null texts give (0, 0, ""). Rows that repeat
    an id and text are one place, so they keep alike; a null id is the smallest. An empty table gives an empty table.
    Other columns pass through unread, whatever their names; one named ``substring`` gives way to the result.
    """
    docs, names = C.aside(docs, "_key", "_runs", "_firsts", "substring")
    id_col, text_col = names.get(id_col, id_col), names.get(text_col, text_col)
    plain = set(docs.columns) == {id_col, text_col}
    keyed = docs.select(C.key(id_col).alias("_key"), text_col) if plain else docs.withColumn("_key", C.key(id_col))
    w = A.Windows("word", window, gram, hot, A.repeats_ids(keyed))

    @F.arrow_udf(RESULT)
    def cut(texts: pa.Array, runs_: pa.Array, firsts: pa.Array) -> pa.Array:
        texts = texts.cast(pa.large_binary())
        out: tuple[list, list, list] = ([], [], [])
        for i in range(len(texts)):
            text = texts[i].as_py() or b""
            words = text.split()
            gone = A.covered_row(len(words), text, runs_[i], firsts[i], w)
            kept = [x for x, g in zip(words, gone.tolist()) if not g] if gone.any() else words
            out[0].append(len(words)), out[1].append(len(words) - len(kept)), out[2].append(b" ".join(kept))
        kept = pa.array(out[2], pa.binary()).cast(pa.string())
        return pa.StructArray.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), kept], ["n_words", "n_removed", "kept"])

    marked = A.marked_documents(keyed, w, judge(window), "substring", text_col)
    out = marked.withColumn("substring", cut(text_col, "_runs", "_firsts"))
    if plain:
        out = out.withColumn(id_col, F.when(F.col("_key") != C.NO_ID, F.col("_key")).cast(docs.schema[id_col].dataType))
    return out.select(*C.given(names, "substring"), "substring")


def digest(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256."""
    brief = substring_dedup(docs.select("doc_id", "text"))
    return brief.select("doc_id", "substring.n_words", "substring.n_removed", F.sha2("substring.kept", 256).alias("kept_sha256"))
