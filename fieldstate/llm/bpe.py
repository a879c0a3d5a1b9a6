"""Byte-pair encoding and decoding: propose, check, and merge only what fails.

A word's tokens are proposed by greedy longest match: a trie over the vocabulary is walked from every place of all new
words at once. A sequence of tokens is the one that merging by rank gives exactly if every two neighbours are compatible,
that is if their joined symbols would merge to the same two tokens. That check runs over all distinct neighbours in one go:
the pair is taken apart along the boundary, latest merge first, and fails where the boundary itself would have merged
before. Words with a failing pair, and they alone, are merged rank by rank. Words recur, so a worker remembers them.
"""

from __future__ import annotations

import heapq
import json
import os
import unicodedata
from hashlib import sha256

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldstate.llm import common as C

#: Words and chunks (what stands between two spaces) that a worker remembers before it starts anew, the places of new words
#: that are walked at once, and the bytes of text that are looked up at once.
REMEMBERED, PLACES, TEXTS = 800_000, 1 << 20, 1 << 23
#: Symbols of a word up to which it is merged together with others, and how many of them.
SHORT, ROWS = 48, 8192
NEVER = 1 << 60
#: Below so many unfinished words their proposals are followed one by one.
FEW = 32

_loaded: dict[str, Vocabulary] = {}


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in the vocabulary file."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]  # fixed values: bytes that stand for themselves
    others = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


def grown(array: np.ndarray, size: int) -> np.ndarray:
    """The array with room for ``size`` entries, at least doubled where there is none."""
    return array if size <= len(array) else np.concatenate([array, np.zeros(max(size - len(array), len(array)), array.dtype)])


class Vocabulary:
    """Tables of one vocabulary file: byte-level pair merges with a word-end suffix, lower case, words by a pattern."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Regex, normalizers, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, suffix = spec["model"], spec["model"]["end_of_word_suffix"]
        steps = [[x["type"] for x in (spec[k] or {}).get(name, [])] for k, name in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers"))]
        if model["type"] != "BPE" or not suffix or steps != [["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]]:
            raise ValueError(f"not a byte-level pair vocabulary with word ends: {path}")
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words_in = regex.compile(pattern).findall
        self.by_library = (
            normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()]),
            pre_tokenizers.Split(Regex(pattern), behavior="removed", invert=True),
        )
        self.plain = {chr(c) for c in range(128)}
        vocab = model["vocab"]
        marks = byte_symbols()
        #: Token of a byte inside a word, then of a byte that ends it.
        self.single = np.array([vocab[c] for c in marks] + [vocab[c + suffix] for c in marks], np.int64)
        self.specials = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special = regex.compile("(" + "|".join(map(regex.escape, self.specials)) + ")") if self.specials else None
        self.size = max([*vocab.values(), *self.specials.values()]) + 1
        names = dict.fromkeys(range(self.size), b"") | {i: t.encode() for t, i in [*vocab.items(), *self.specials.items()]}
        self.known = np.zeros(self.size, bool)
        self.known[[*vocab.values(), *self.specials.values()]] = True
        self.names = pa.array([names[i].decode() for i in range(self.size)], pa.large_string())

        merges = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in model["merges"]], np.int64).reshape(-1, 3)
        left, right, made = merges.T
        self.rank = np.full(self.size, -1)
        self.rank[made] = np.arange(len(merges))
        if len(np.unique(made)) < len(made) or (self.rank[left] >= self.rank[made]).any() or (self.rank[right] >= self.rank[made]).any():
            raise ValueError(f"a token of two merges, or a merge before its parts: {path}")
        self.parts = np.zeros((2, self.size), np.int64)
        self.parts[:, made] = left, right
        order = np.argsort(left * self.size + right)
        self.pairs, self.pair_rank = (left * self.size + right)[order], order
        self.made, self.made_list = made, made.tolist()
        first, second = np.meshgrid(self.single, self.single, indexing="ij")
        self.symbol_rank = self.ranked(first, second)
        self.rank_of = dict(zip((left * self.size + right).tolist(), range(len(merges))))

        # a token can be proposed if merging its own symbols gives it
        sound = np.zeros(self.size, bool)
        sound[self.single] = True
        whole = self.compatible(left, right, 2 * np.arange(len(merges)))
        for a, b, t, w in zip(left.tolist(), right.tolist(), made.tolist(), whole.tolist()):
            sound[t] = w and sound[a] and sound[b]
        self._build_trie(vocab, suffix, marks, sound)
        self.forget()

    def _build_trie(self, vocab: dict[str, int], suffix: str, marks: list[str], sound: np.ndarray) -> None:
        """Edges as one sorted table (node, symbol) -> node; a symbol is a byte, plus 256 where it ends the word."""
        byte_of = {c: b for b, c in enumerate(marks)}
        edges: dict[int, int] = {}
        accepts = [-1]
        for token, i in vocab.items():
            if not sound[i]:
                continue
            ends = token.endswith(suffix)
            symbols = [byte_of[c] for c in (token[: -len(suffix)] if ends else token)]
            symbols[-1] += 256 * ends
            node = 0
            for s in symbols:
                node = edges.setdefault(node << 9 | s, len(accepts))
                if node == len(accepts):
                    accepts.append(-1)
            accepts[node] = i
        self.edge = np.array(sorted(edges), np.int64)
        self.child = np.array([edges[k] for k in sorted(edges)], np.int64)
        self.accepts = np.array(accepts)

    def forget(self) -> None:
        #: Number of a word, or of a chunk; tokens of number n are flat[bounds[n] : bounds[n + 1]].
        self.words_known: dict[str, int] = {}
        self.chunks_known: dict[str, int] = {}
        self.flat, self.bounds, self.numbers = np.zeros(1 << 16, np.int32), np.zeros(1 << 12, np.int64), 0
        ids = np.array(list(self.specials.values()), np.int32)
        self.add(self.words_known, list(self.specials), ids, np.ones(len(ids), np.int64))

    def add(self, known: dict[str, int], names: list[str], tokens: np.ndarray, counts: np.ndarray) -> None:
        """Remember the tokens of words or chunks, given one after another."""
        used, n = int(self.bounds[self.numbers]), self.numbers
        ends = used + np.cumsum(counts, dtype=np.int64)
        self.flat, self.bounds = grown(self.flat, used + len(tokens)), grown(self.bounds, n + len(names) + 1)
        self.flat[used : used + len(tokens)] = tokens
        self.bounds[n + 1 : n + len(names) + 1] = ends
        known.update(zip(names, range(n, n + len(names))))
        self.numbers += len(names)

    # ---- check ---------------------------------------------------------------------------------------------
    def compatible(self, a: np.ndarray, b: np.ndarray, bound: np.ndarray | None = None) -> np.ndarray:
        """Whether the boundary between tokens ``a`` and ``b`` outlasts the merging of their joined symbols.

        The pair on both sides of the boundary lasts until the next merge beside it; it fails if its own rank comes first.
        Of equal ranks the left place merges first, which the odd bounds of the right side express.
        """
        ok = np.ones(len(a), bool)
        live, a, b = np.arange(len(a)), a.copy(), b.copy()
        bound = np.full(len(a), NEVER) if bound is None else bound.copy()
        while len(live):
            fails = 2 * self.ranked(a, b) < bound
            ok[live[fails]] = False
            rank_a, rank_b = self.rank[a], self.rank[b]
            on = ~fails & ((rank_a >= 0) | (rank_b >= 0))
            live, a, b, rank_a, rank_b = live[on], a[on], b[on], rank_a[on], rank_b[on]
            from_right = rank_b >= rank_a
            bound = np.where(from_right, 2 * rank_b + 1, 2 * rank_a)
            a, b = np.where(from_right, a, self.parts[1, a]), np.where(from_right, self.parts[0, b], b)
        return ok

    # ---- proposal ------------------------------------------------------------------------------------------
    def longest(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The longest token from every place on, and its length in symbols."""
        token, length = self.single[symbols].copy(), np.ones(len(symbols), np.int64)
        live, node, depth = np.arange(len(symbols)), np.zeros(len(symbols), np.int64), 0
        while len(live):
            key = node << 9 | symbols[live + depth]
            where = np.minimum(np.searchsorted(self.edge, key), len(self.edge) - 1)
            hit = self.edge[where] == key
            live, node = live[hit], self.child[where[hit]]
            depth += 1
            accepted = self.accepts[node]
            good = accepted >= 0
            token[live[good]], length[live[good]] = accepted[good], depth
            inside = live + depth < len(symbols)
            live, node = live[inside], node[inside]
        return token, length

    def proposed(self, symbols: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greedy tokens of all words, and the word of each; words one after another."""
        token, length = self.longest(symbols)
        word, at = np.arange(len(starts)), starts.copy()
        words, tokens = [], []
        while len(word) >= FEW:
            words.append(word)
            tokens.append(token[at])
            at = at + length[at]
            on = at < stops[word]
            word, at = word[on], at[on]
        for w, p in zip(word.tolist(), at.tolist()):
            jump, last, places = length[p : stops[w]].tolist(), int(stops[w]) - p, []
            k = 0
            while k < last:
                places.append(k)
                k += jump[k]
            words.append(np.full(len(places), w))
            tokens.append(token[p + np.array(places, np.int64)])
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        word, tokens = np.concatenate(words), np.concatenate(tokens)
        order = np.argsort(word, kind="stable")
        return tokens[order], word[order]

    # ---- exact merging -------------------------------------------------------------------------------------
    def merged(self, words: list[np.ndarray]) -> list[np.ndarray]:
        """Tokens of words, given as symbols, by merging the lowest rank first, of equal ranks the leftmost.

        Short words of similar length are merged together, each step by one pair; long ones one by one.
        """
        out = [w if len(w) <= SHORT else np.array(self.merged_by_heap(self.single[w].tolist())) for w in words]
        lengths = np.array([len(w) if len(w) <= SHORT else 0 for w in words])
        order = np.argsort(lengths, kind="stable")
        order = order[lengths[order] > 0]
        for at in range(0, len(order), ROWS):
            rows = order[at : at + ROWS]
            tokens, counts = self.merged_together([words[r] for r in rows.tolist()])
            for r, t, n in zip(rows.tolist(), tokens, counts.tolist()):
                out[r] = t[:n]
        return out

    def merged_together(self, words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of words as padded rows, and how many each has."""
        counts = np.array([len(w) for w in words])
        width = int(counts.max())
        there = np.arange(width) < counts[:, None]
        symbols = np.zeros(there.shape, np.int64)
        symbols[there] = np.concatenate(words)
        ids = self.single[symbols]
        ranks = np.full(there.shape, NEVER)
        ranks[:, :-1] = np.where(there[:, 1:], self.symbol_rank[symbols[:, :-1], symbols[:, 1:]], NEVER)
        live = np.arange(len(words))
        places = np.arange(width)
        while len(live):
            own = ranks[live]
            at = own.argmin(axis=1)
            least = own[np.arange(len(live)), at]
            going = least < NEVER
            live, at, own, least = live[going], at[going], own[going], least[going]
            if not len(live):
                break
            source = np.minimum(places + (places > at[:, None]), width - 1)
            row = np.arange(len(live))
            moved = np.take_along_axis(ids[live], source, axis=1)
            own = np.take_along_axis(own, np.minimum(places + (places >= at[:, None]), width - 1), axis=1)
            moved[row, at], own[:, -1] = self.made[least], NEVER
            counts[live] -= 1
            left, right = np.maximum(at - 1, 0), np.minimum(at + 1, width - 1)
            own[row, left] = np.where(at > 0, self.ranked(moved[row, left], moved[row, at]), own[row, left])
            own[row, at] = np.where(at + 1 < counts[live], self.ranked(moved[row, at], moved[row, right]), NEVER)
            ids[live], ranks[live] = moved, own
        return ids, counts

    def ranked(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair, NEVER where there is none."""
        key = a * self.size + b
        where = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[where] == key, self.pair_rank[where], NEVER)

    def merged_by_heap(self, ids: list[int]) -> list[int]:
        """The same for long words: places in a heap by rank, neighbours linked."""
        n, size, rank_of = len(ids), self.size, self.rank_of
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(rank_of[k], i, k) for i in range(n - 1) if (k := ids[i] * size + ids[i + 1]) in rank_of]
        heapq.heapify(heap)
        while heap:
            rank, i, k = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or ids[i] * size + ids[j] != k:
                continue  # one of the two has merged since
            ids[i], ids[j] = self.made_list[rank], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (k := ids[x] * size + ids[y]) in rank_of:
                    heapq.heappush(heap, (rank_of[k], x, k))
        return [x for x in ids if x >= 0]

    def learn(self, words: list[str]) -> None:
        """Tokens of words not seen before."""
        raw = [w.encode() for w in words]
        bounds = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
        for first, last in C.slices(bounds, PLACES):
            starts, stops = bounds[first:last] - bounds[first], bounds[first + 1 : last + 1] - bounds[first]
            symbols = np.frombuffer(b"".join(raw[first:last]), np.uint8).astype(np.int64)
            symbols[stops - 1] += 256
            tokens, word = self.proposed(symbols, starts, stops)
            inner = np.flatnonzero(word[1:] == word[:-1])
            distinct, which = np.unique(tokens[inner] * self.size + tokens[inner + 1], return_inverse=True)
            ok = self.compatible(distinct // self.size, distinct % self.size)
            failing = np.unique(word[inner[~ok[which]]])
            exact = self.merged([symbols[a:b] for a, b in zip(starts[failing].tolist(), stops[failing].tolist())])
            passing = np.ones(last - first, bool)
            passing[failing] = False
            passing = passing[word]
            tokens = np.concatenate([tokens[passing], *exact])
            word = np.concatenate([word[passing], np.repeat(failing, np.array([len(e) for e in exact], np.int64))])
            order = np.argsort(word, kind="stable")
            self.add(self.words_known, words[first:last], tokens[order], np.bincount(word, minlength=last - first))

    # ---- texts ---------------------------------------------------------------------------------------------
    def as_library(self, char: str) -> bool:
        """Whether this Python reads a character as the tokenizers library does: lower case and class."""
        if unicodedata.category(char) == "Cn" or char == "Σ":  # unknown here, or lower case by context
            return False
        normal, split = self.by_library
        probe = f"a{char}a!{char}!"
        return normal.normalize_str(char) == unicodedata.normalize("NFC", char).lower() and [
            x for x, _ in split.pre_tokenize_str(probe)
        ] == self.words_in(probe)

    def words(self, text: str) -> list[str]:
        """The words of a text, in order; special tokens count as words."""
        if self.special and (pieces := self.special.split(text))[1:]:
            return [w for p in pieces if p for w in ([p] if p in self.specials else self.words(p))]
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            new = set(text) - self.plain
            self.plain.update(c for c in new if self.as_library(c))
            if not new <= self.plain:
                normal, split = self.by_library
                return [x for x, _ in split.pre_tokenize_str(normal.normalize_str(text))]
        return self.words_in(text.lower())

    def numbered(self, words: list[str]) -> np.ndarray:
        """Numbers of words; new ones are learned."""
        new = set(words).difference(self.words_known)
        if new:
            self.learn(list(new))
        return np.fromiter(map(self.words_known.__getitem__, words), np.int64, len(words))

    def tokens_of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of numbers one after another, and where each number's end."""
        lengths = self.bounds[numbers + 1] - self.bounds[numbers]
        ends = np.cumsum(lengths)
        return self.flat[np.repeat(self.bounds[numbers] - (ends - lengths), lengths) + np.arange(int(lengths.sum()))], ends

    def learn_chunks(self, chunks: list[str]) -> None:
        """Tokens of chunks: those of their words. A chunk of plain letters is a word."""
        single = [c for c in chunks if c.isascii() and c.isalpha()]
        self.chunks_known.update(zip(single, self.numbered(single).tolist()))
        chunks = [c for c in chunks if not (c.isascii() and c.isalpha())]
        words, counts = [], []
        for chunk in chunks:
            own = self.words_in(chunk)
            counts.append(len(own))
            words += own
        tokens, ends = self.tokens_of(self.numbered(words))
        upto = np.append(0, ends)[np.append(0, np.cumsum(counts)).astype(np.int64)]
        self.add(self.chunks_known, chunks, tokens, np.diff(upto))

    def plainly(self, text: str) -> str | None:
        """The text composed and in lower case if it can be cut at spaces, None if it holds a special token or odd character."""
        if self.special and self.special.search(text):
            return None
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            new = set(text) - self.plain
            self.plain.update(c for c in new if self.as_library(c))
            if not new <= self.plain:
                return None
        return text.lower().replace("\n", " ").replace("\t", " ")

    def encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts one after another, and how many each has."""
        if len(self.words_known) + len(self.chunks_known) > REMEMBERED:
            self.forget()
        ready = [self.plainly(t) for t in texts]
        chunks = pa.compute.split_pattern(pa.array([t for t in ready if t is not None], pa.large_string()), " ")
        coded = chunks.flatten().dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if new := set(distinct).difference(self.chunks_known):
            self.learn_chunks(list(new))
        number = np.fromiter(map(self.chunks_known.__getitem__, distinct), np.int64, len(distinct))
        odd = [self.words(t) for t, r in zip(texts, ready) if r is None]
        plain = np.array([r is not None for r in ready], bool)
        counts = np.zeros(len(texts), np.int64)
        counts[plain], counts[~plain] = chunks.value_lengths().to_numpy(), [len(w) for w in odd]
        numbers, from_plain = np.zeros(int(counts.sum()), np.int64), np.repeat(plain, counts)
        numbers[from_plain] = number[coded.indices.to_numpy()]
        numbers[~from_plain] = self.numbered([w for words in odd for w in words])
        ids, ends = self.tokens_of(numbers)
        return ids, np.diff(np.append(0, ends)[np.append(0, np.cumsum(counts))])

    def decoded(self, ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
        """Names of the tokens of each row joined by spaces; unknown ids are left out."""
        known = (ids >= 0) & (ids < self.size)
        known[known] = self.known[ids[known]]
        bounds = np.concatenate([[0], np.cumsum(known)])[bounds]
        return pa.compute.binary_join(pa.LargeListArray.from_arrays(pa.array(bounds), self.names.take(pa.array(ids[known]))), pa.scalar(" ", pa.large_string()))


def vocabulary(path: str) -> Vocabulary:
    """The tables of a worker, loaded once."""
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


def encode(text: Column | str, path: str) -> Column:
    """Token ids of a text, ``array<int>``, as the tokenizers library gives them without special tokens of its own.

    Special tokens written in a text become their ids, as there. NULL gives NULL, an empty text or one without words an
    empty array. Whole texts of any length; a batch is worked off in slices of bounded size.
    """

    @F.arrow_udf("array<int>")
    def run(texts: pa.Array) -> pa.Array:
        vocab, ids, counts = vocabulary(path), [], []
        _, offsets = C.buffers(texts)
        for a, b in C.slices(offsets, TEXTS):
            own, n = vocab.encoded(["" if t is None else t for t in texts[a:b].to_pylist()])
            ids.append(own)
            counts.append(n)
        values = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        bounds = np.concatenate([[0], *counts]).cumsum() if counts else np.zeros(1, np.int64)
        missing = np.asarray(texts.is_null())
        return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, pa.int32()), mask=pa.array(missing))

    return run(text)


def decode(ids: Column | str, path: str) -> Column:
    """Text of token ids as the tokenizers library decodes them, special tokens kept: names joined by one space.

    NULL gives NULL; NULL and unknown ids in an array are left out, as there.
    """

    @F.arrow_udf("string")
    def run(lists: pa.Array) -> pa.Array:
        vocab, out = vocabulary(path), []
        missing = np.asarray(lists.is_null())
        bounds = np.concatenate([[0], np.cumsum(np.where(missing, 0, lists.value_lengths().fill_null(0).to_numpy()))]).astype(np.int64)
        values = lists.flatten().cast(pa.int64()).fill_null(-1).to_numpy()
        for a, b in C.slices(bounds, C.SLICE // 8):
            out.append(vocab.decoded(values[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a]))
        if not out:
            return pa.array([], pa.large_string())
        texts = pa.concat_arrays(out)
        return pa.compute.if_else(pa.array(missing), None, texts)

    return run(ids)


def ids_sha256(ids: Column | str) -> Column:
    """SHA-256 of an array's values as little-endian unsigned 32-bit integers, lower-case hex."""

    @F.arrow_udf("string")
    def run(lists: pa.Array) -> pa.Array:
        values = np.ascontiguousarray(lists.flatten().to_numpy(zero_copy_only=False).astype("<u4"))
        bounds = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy())]).astype(np.int64)
        return pa.array([sha256(values[a:b]).hexdigest() for a, b in zip(bounds[:-1], bounds[1:])], pa.string())

    return run(ids)


def digest(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, n_tokens, ids_sha256, decoded_sha256; a null text counts as empty.

    One row per input row, so repeated ids stay repeated; an empty table gives no rows; other columns are not read.
    No shuffle: every text is encoded where it is read.
    """
    coded = docs.select(
        F.col(id_col).cast("long").alias("id"), encode(F.coalesce(F.col(text_col).cast("string"), F.lit("")), path).alias("ids")
    )
    return coded.select(
        F.col("id").alias(id_col), F.size("ids").cast("long").alias("n_tokens"), ids_sha256("ids").alias("ids_sha256"),
        F.sha2(decode("ids", path), 256).alias("decoded_sha256"),
    )
