"""Hidden-Markov smoothing: most likely state path per sequence.

A sequence is packed into one row (its days are bounded by the calendar) and decoded by an Arrow function over many
sequences at once; Spark partitions and shuffles the sequences. Scores are 64-bit fixed-point logarithms (2**-40), so
sums are exact: a tie is a real tie, it goes to the lowest state, and decoding in chunks gives the same path.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldstate import schema as S
from fieldstate.functions import vectors as V
from fieldstate.operators import series

# functions of this module travel to the workers with the job
cloudpickle.register_pickle_by_value(sys.modules[__name__])

KEYS = ["phenocam_name", "category", "site_sequence_id"]
SCALE = float(1 << 40)
IMPOSSIBLE = -(1 << 61)
CELLS = 4_000_000  # steps x sequences x states decoded at once


# ---- model ---------------------------------------------------------------------------------------------
def hmm_spec(category: str) -> tuple[tuple[str, ...], list[float], list[list[float]]]:
    """(states, start probabilities, transition probabilities); start is uniform, rows sum to 1."""
    states, weights = S.HMM_MODELS[category]
    transition = [[w / sum(row) for w in row] for row in weights]
    return states, [1 / len(states)] * len(states), transition


def emission_logprob(p: Column | str) -> Column:
    """Natural logarithm of a class probability, minus infinity for 0."""
    p = F.col(p) if isinstance(p, str) else p
    return F.when(p > 0, F.ln(p)).when(p.isNotNull(), F.lit(float("-inf")))


def _fixed(p: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        logs = np.log(p) * SCALE
    return np.where(np.isfinite(logs), np.rint(np.where(np.isfinite(logs), logs, 0.0)), float(IMPOSSIBLE)).astype(np.int64)


def _models(categories: list[str]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    out = {}
    for category in categories:
        _, start, transition = hmm_spec(category)
        out[category] = (_fixed(np.array(start)), _fixed(np.array(transition)))
    return out


# ---- Arrow helpers -------------------------------------------------------------------------------------
def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and flat values of a list column."""
    offsets = np.asarray(column.offsets)
    values = column.values.slice(offsets[0], offsets[-1] - offsets[0])
    return offsets - offsets[0], values.to_numpy(zero_copy_only=False)


def _pack(offsets: np.ndarray, values: np.ndarray, valid: np.ndarray | None = None) -> pa.Array:
    mask = None if valid is None else pa.array(~valid)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values), mask=mask)


def _batches(lengths: np.ndarray, states: int):
    """Row numbers, longest first, cut so that one batch stays within CELLS."""
    order = np.argsort(-lengths, kind="stable")
    at = 0
    while at < len(order):
        size = max(1, CELLS // max(1, int(lengths[order[at]]) * states))
        yield order[at : at + size]
        at += size


# ---- direct decoding -----------------------------------------------------------------------------------
def _forward(scores: np.ndarray, lengths: np.ndarray, entry: np.ndarray, transition: np.ndarray, first_is_entry: bool):
    """Best scores at each sequence's last step, and back pointers. ``scores`` is (step, sequence, state), longest first."""
    steps, rows, states = scores.shape
    pointers = np.zeros((steps, rows, states), dtype=np.int8)
    best = entry.copy()
    for t in range(steps):
        live = int(np.searchsorted(-lengths, -t, side="left"))  # sequences longer than t
        if t == 0 and first_is_entry:
            best[:live] = np.maximum(best[:live] + scores[0, :live], IMPOSSIBLE)
            continue
        reach = best[:live, :, None] + transition[None, :, :]
        pick = reach.argmax(axis=1)
        pointers[t, :live] = pick
        top = np.take_along_axis(reach, pick[:, None, :], axis=1)[:, 0, :]
        best[:live] = np.maximum(np.maximum(top, IMPOSSIBLE) + scores[t, :live], IMPOSSIBLE)
    return best, pointers


def _trace(pointers: np.ndarray, lengths: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Follow back pointers from the last state of each sequence: (step, sequence) states."""
    steps, rows, _ = pointers.shape
    path = np.zeros((steps, rows), dtype=np.int32)
    state = last.astype(np.int64).copy()
    for t in range(steps - 1, -1, -1):
        live = int(np.searchsorted(-lengths, -t, side="left"))
        path[t, :live] = state[:live]
        if t:
            state[:live] = pointers[t, np.arange(live), state[:live]]
    return path


def _grid(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, states: int) -> np.ndarray:
    """Pad sequences to (step, sequence, state)."""
    grid = np.full((int(lengths[0]), len(lengths), states), IMPOSSIBLE, dtype=np.int64)
    for i, (start, n) in enumerate(zip(starts, lengths)):
        grid[:n, i] = flat[start : start + n * states].reshape(n, states)
    return grid


def _decode_rows(flat: np.ndarray, offsets: np.ndarray, start: np.ndarray, transition: np.ndarray):
    """Paths of many sequences of one model; a sequence without any possible path is marked invalid."""
    states = len(start)
    steps = np.diff(offsets) // states
    out = np.zeros(int(steps.sum()), dtype=np.int32)
    out_at = np.concatenate([[0], np.cumsum(steps)])
    valid = np.zeros(len(steps), dtype=bool)
    scores = _fixed(flat)
    for rows in _batches(steps, states):
        lengths = steps[rows]
        grid = _grid(scores, offsets[rows], lengths, states)
        best, pointers = _forward(grid, lengths, np.tile(start, (len(rows), 1)), transition, True)
        path = _trace(pointers, lengths, best.argmax(axis=1))
        valid[rows] = best.max(axis=1) > IMPOSSIBLE // 2
        for i, row in enumerate(rows):
            out[out_at[row] : out_at[row + 1]] = path[: lengths[i], i]
    return out, out_at, valid


def sequence_decoder(categories: list[str] | None = None):
    """Arrow function (category, flat probabilities of a sequence) -> state per day; NULL without a possible path."""
    models = _models(categories or list(S.HMM_MODELS))

    @F.arrow_udf("array<int>")
    def decode(category: pa.Array, probabilities: pa.Array) -> pa.Array:
        offsets, flat = _lists(probabilities)
        names = np.asarray(category.to_pylist(), dtype=object)
        lengths = np.zeros(len(names), dtype=np.int64)
        valid = np.zeros(len(names), dtype=bool)
        parts = []
        for name, (start, transition) in models.items():
            rows = np.flatnonzero(names == name)
            if len(rows):
                picked = [flat[offsets[r] : offsets[r + 1]] for r in rows]
                own = np.concatenate([[0], np.cumsum([len(p) for p in picked])])
                path, at, ok = _decode_rows(np.concatenate(picked), own, start, transition)
                lengths[rows], valid[rows] = np.diff(at), ok
                parts.append((rows, path, at))
        out_at = np.concatenate([[0], np.cumsum(lengths)])
        out = np.zeros(int(out_at[-1]), dtype=np.int32)
        for rows, path, at in parts:
            for i, row in enumerate(rows):
                out[out_at[row] : out_at[row + 1]] = path[at[i] : at[i + 1]]
        return _pack(out_at, out, valid)

    return decode


def _state_name() -> Column:
    """Name of ``state``, by ``category``."""
    cases = " ".join(f"WHEN '{c}' THEN {V.name_sql(hmm_spec(c)[0], 'state')}" for c in S.HMM_MODELS)
    return F.expr(f"CASE category {cases} END")


def viterbi_paths(sequences: DataFrame, categories: list[str] | None = None, carried: tuple[str, ...] = ()) -> DataFrame:
    """One row per sequence: keys, dates, and ``path`` (state numbers, NULL when no path is possible).

    ``sequences`` has a row per day: keys, date and ``probabilities`` in state order. Sequences of ``carried`` categories are not
    decoded: their path is empty, and a further column ``carried`` holds their days' probabilities, which is empty for all others.
    """
    decode = sequence_decoder(categories)
    packed = sequences.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("date", "probabilities"))).alias("days"))
    flat = F.flatten(F.col("days.probabilities"))
    if not carried:
        return packed.select(*KEYS, F.col("days.date").alias("dates"), decode("category", flat).alias("path"))
    own, none = F.col("category").isin(*carried), F.array()
    found = packed.withColumn("path", decode("category", F.when(own, none).otherwise(flat)))
    return found.select(
        *KEYS, F.col("days.date").alias("dates"), F.when(own, none).otherwise(F.col("path")).alias("path"),
        F.when(own, F.col("days.probabilities")).otherwise(none).alias("carried"),
    )


def _unpack(paths: DataFrame) -> DataFrame:
    """A row per day; a NULL path gives none. A filter on the path would run the decoder a second time."""
    further = [F.col("carried").alias("probabilities")] if "carried" in paths.columns else []
    return paths.select(*KEYS, F.inline(F.arrays_zip(F.col("dates").alias("date"), F.col("path").alias("state"), *further)))


def viterbi_decode(sequences: DataFrame, categories: list[str] | None = None, carried: tuple[str, ...] = ()) -> DataFrame:
    """(phenocam_name, year, date, site_sequence_id, category, hmm_class) of every sequence that has a path.

    Days of ``carried`` categories come along, with ``probabilities`` instead of a class: one pass for states and votes.
    """
    days = _unpack(viterbi_paths(sequences, categories, carried))
    return days.select(
        "phenocam_name", F.year("date").alias("year"), "date", "site_sequence_id", "category",
        _state_name().alias("hmm_class"), *(["probabilities"] if carried else []),
    )


def hmm_failures(sequences: DataFrame, categories: list[str] | None = None) -> DataFrame:
    """Sequences without a possible path, with their length."""
    paths = viterbi_paths(sequences, categories)
    return paths.filter(F.col("path").isNull()).select(*KEYS, F.size("dates").cast("bigint").alias("n_days"))


def hmm_output(cover: DataFrame, status: DataFrame) -> DataFrame:
    return cover.unionByName(status)


# ---- decoding by an associative scan -------------------------------------------------------------------
# A day is a max-plus matrix: entry (i, j) is the score of going from state i on the day before to state j. Products of
# such matrices are associative, so the days of a chunk, and the chunks of a sequence, are combined pairwise in a tree: up
# the tree the products, down the tree the best scores before each block. The same is done with the maps "state after a
# block -> state before it", which resolves the path from its end. All rows of a batch go through a level at once, so the
# number of steps is the logarithm of the length.
def _product(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Max-plus product of (..., k, k) matrices, scaled so that the largest entry is 0; only differences matter."""
    return _scaled((left[..., :, :, None] + right[..., None, :, :]).max(axis=-2))


def _scaled(m: np.ndarray) -> np.ndarray:
    axes = (-2, -1) if m.ndim > 3 else (-1,)
    top = m.max(axis=axes, keepdims=True)
    return np.where(m > IMPOSSIBLE // 2, m - np.where(top > IMPOSSIBLE // 2, top, 0), IMPOSSIBLE)


def _ranked_product(left: np.ndarray, left_rank: np.ndarray, right: np.ndarray, right_rank: np.ndarray):
    """:func:`_product` that also ranks, for each last state, the first states by the order in which ties are resolved.

    Tracing back takes the lowest state at each step from the end on, so of two equal paths the one wins that is lower at the
    last step where they differ: first the right factor's rank decides, then the left one's.
    """
    k = left.shape[-1]
    sums = left[..., :, :, None] + right[..., None, :, :]
    top = sums.max(axis=-2)
    order = np.where(sums == top[..., None, :], right_rank[..., None, :, :], k)
    middle = order.argmin(axis=-2)
    last = np.take_along_axis(order, middle[..., None, :], axis=-2)[..., 0, :]
    rank = (last * k + np.take_along_axis(left_rank, middle, axis=-1)).argsort(axis=-2, kind="stable").argsort(axis=-2, kind="stable")
    return _scaled(top), rank


def _identity(k: int) -> np.ndarray:
    return np.where(np.eye(k, dtype=bool), 0, IMPOSSIBLE).astype(np.int64)


def _up(matrices: np.ndarray, combine) -> list[np.ndarray]:
    """All levels of the tree over axis 1, whose length is a power of two; the last level holds one block."""
    levels = [matrices]
    while levels[-1].shape[1] > 1:
        levels.append(combine(levels[-1][:, 0::2], levels[-1][:, 1::2]))
    return levels


def _down(levels: list[np.ndarray], first: np.ndarray, through, forward: bool) -> np.ndarray:
    """What holds before each place (or after it, for ``forward`` false), given what holds at that end of the whole."""
    value = first[:, None]
    for blocks in levels[-2::-1]:
        split = np.empty((value.shape[0], 2 * value.shape[1], *value.shape[2:]), value.dtype)
        near, far = (0, 1) if forward else (1, 0)
        split[:, near::2] = value
        split[:, far::2] = through(value, blocks[:, near::2])
        value = split
    return value


def _entries(levels: list[np.ndarray], entry: np.ndarray) -> np.ndarray:
    """Best scores before each place."""
    return _down(levels, entry, lambda v, m: _scaled_rows((v[..., :, None] + m).max(axis=-2)), True)


def _scaled_rows(v: np.ndarray) -> np.ndarray:
    top = v.max(axis=-1, keepdims=True)
    return np.where(v > IMPOSSIBLE // 2, v - np.where(top > IMPOSSIBLE // 2, top, 0), IMPOSSIBLE)


def _states(origins: np.ndarray, last: np.ndarray) -> np.ndarray:
    """State after each place, from the maps back over each place and the state after the last."""
    levels = _up(origins, lambda left, right: np.take_along_axis(left, right, axis=-1))
    return _down(levels, last, lambda s, m: np.take_along_axis(m, s[..., None], axis=-1)[..., 0], False)


def _padded(flat: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a flat list as (row, place, width) with a power of two of places, and which places are there."""
    lengths = np.diff(offsets) // width
    places = 1 << max(int(lengths.max(initial=1)) - 1, 0).bit_length()
    there = np.arange(places) < lengths[:, None]
    grid = np.zeros((len(lengths), places, width), flat.dtype)
    grid[there] = flat.reshape(-1, width)
    return grid, there


def _day_matrices(flat: np.ndarray, offsets: np.ndarray, transition: np.ndarray, opens: np.ndarray | None):
    """(row, day, k, k) matrices of chunks. The first day of a chunk keeps the state (it has no day before) where it opens a
    sequence; with ``opens`` None that day is left to the caller, and its scores are returned. Missing days are identities."""
    k = len(transition)
    grid, there = _padded(_fixed(flat), offsets, k)
    days = np.maximum(transition + grid[:, :, None, :], IMPOSSIBLE)
    days[~there] = _identity(k)
    if opens is None:
        days[:, 0] = _identity(k)
    else:
        days[opens, 0] = np.maximum(_identity(k) + grid[opens, 0, None, :], IMPOSSIBLE)
    return days, there, grid[:, 0]


def _by_model(models, category: pa.Array, offsets: np.ndarray):
    """(start, transition, row numbers) per model, cut so that one batch of trees stays within CELLS."""
    names = np.asarray(category.to_pylist(), dtype=object)
    for name, (start, transition) in models.items():
        rows = np.flatnonzero(names == name)
        days = np.diff(offsets)[rows] // len(start)
        order = np.argsort(-days, kind="stable")
        at = 0
        while at < len(rows):
            size = max(1, CELLS // max(1, 2 * int(days[order[at]]) * len(start) ** 2))
            yield start, transition, rows[order[at : at + size]]
            at += size


def _pick(flat: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists of some rows, as (flat, offsets)."""
    lengths = np.diff(offsets)[rows]
    own = np.concatenate([[0], np.cumsum(lengths)])
    return flat[np.repeat(offsets[rows] - own[:-1], lengths) + np.arange(own[-1])], own


def _scan_functions(categories: list[str]):
    """Arrow functions of the scan: the product of a chunk, what surrounds each chunk of a sequence, the path of a chunk."""
    models = _models(categories)

    @F.arrow_udf("array<bigint>")
    def product(category: pa.Array, probabilities: pa.Array) -> pa.Array:
        """Scores of the first day, then the product of the other days and the ranks of its entries, row by row."""
        offsets, flat = _lists(probabilities)
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(category)
        for _, transition, rows in _by_model(models, category, offsets):
            k = len(transition)
            days, _, first = _day_matrices(*_pick(flat, offsets, rows), transition, None)
            rank = np.broadcast_to(np.arange(k)[:, None], days.shape).copy()
            while days.shape[1] > 1:
                days, rank = _ranked_product(days[:, 0::2], rank[:, 0::2], days[:, 1::2], rank[:, 1::2])
            whole = np.concatenate([first, days.reshape(-1, k * k), rank.reshape(-1, k * k)], axis=1)
            for row, values in zip(rows, whole):
                out[row] = values
        return _pack(np.concatenate([[0], np.cumsum([len(x) for x in out])]), np.concatenate([np.zeros(0, np.int64), *out]))

    @F.arrow_udf("array<bigint>")
    def surroundings(category: pa.Array, products: pa.Array) -> pa.Array:
        """Per chunk of a sequence, the best scores before it and the state after it; NULL without a possible path."""
        offsets, flat = _lists(products)
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(category)
        valid = np.zeros(len(category), bool)
        for start, transition, rows in _by_model(models, category, offsets):
            k = len(start)
            grid, there = _padded(*_pick(flat, offsets, rows), k + 2 * k * k)
            first, inner = grid[:, :, None, :k], grid[:, :, k : k + k * k].reshape(*there.shape, k, k)
            rank = grid[:, :, k + k * k :].reshape(inner.shape)
            entering = np.maximum(transition + first, IMPOSSIBLE)
            entering[:, 0] = np.maximum(_identity(k) + first[:, 0], IMPOSSIBLE)
            lowest = np.broadcast_to(np.arange(k)[:, None], inner.shape)
            chunks, rank = _ranked_product(entering, lowest, inner, rank)
            chunks[~there], rank[~there] = _identity(k), np.arange(k)[:, None]
            levels = _up(chunks, _product)
            entries = _entries(levels, np.broadcast_to(start, (len(rows), k)))
            reach = entries[..., :, None] + chunks
            origins = np.where(reach == reach.max(axis=-2, keepdims=True), rank, k).argmin(axis=-2)
            origins[~there] = np.arange(k)
            final = (start[:, None] + levels[-1][:, 0]).max(axis=-2)
            states = _states(origins, final.argmax(axis=-1))
            valid[rows] = final.max(axis=-1) > IMPOSSIBLE // 2
            both = np.concatenate([entries, states[..., None]], axis=-1)
            for row, values, n in zip(rows, both, there.sum(axis=1)):
                out[row] = values[:n].ravel()
        return _pack(np.concatenate([[0], np.cumsum([len(x) for x in out])]), np.concatenate([np.zeros(0, np.int64), *out]), valid)

    @F.arrow_udf("array<int>")
    def path(category: pa.Array, opens: pa.Array, probabilities: pa.Array, around: pa.Array) -> pa.Array:
        """States of a chunk's days, given the scores before it and the state after it; NULL where these are."""
        offsets, flat = _lists(probabilities)
        around_at, around_flat = _lists(around)
        first_chunk = np.asarray(opens)
        known = np.diff(around_at) > 0
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(category)
        for start, transition, rows in _by_model(models, category, offsets):
            k, rows = len(start), rows[known[rows]]
            if not len(rows):
                continue
            own = _pick(around_flat, around_at, rows)[0].reshape(-1, k + 1)
            days, there, _ = _day_matrices(*_pick(flat, offsets, rows), transition, first_chunk[rows])
            entries = _entries(_up(days, _product), own[:, :k])
            origins = (entries[..., :, None] + days).argmax(axis=-2)
            origins[~there] = np.arange(k)
            for row, states, n in zip(rows, _states(origins, own[:, k]), there.sum(axis=1)):
                out[row] = states[:n]
        return _pack(np.concatenate([[0], np.cumsum([len(x) for x in out])]), np.concatenate([np.zeros(0, np.int64), *out]).astype(np.int32), known)

    return product, surroundings, path


def viterbi_decode_long(sequences: DataFrame, chunk: int = 4096, categories: list[str] | None = None) -> DataFrame:
    """:func:`viterbi_decode` for sequences of any length, cut into chunks of at most ``chunk`` days.

    Chunks are shuffled once and read twice (the second time from the same exchange). First each is reduced to the product of
    its days, a k x k matrix; the products of a sequence, a small row each, meet and tell every chunk the scores before it and
    the state after it; with these every chunk finds its own days. Scores are whole numbers and products are scaled by whole
    numbers, so ties and paths are those of the direct decoding, and no length overflows them.
    """
    categories = categories or list(S.HMM_MODELS)
    product, surroundings, path = _scan_functions(categories)
    k = F.expr("CASE category " + " ".join(f"WHEN '{c}' THEN {len(hmm_spec(c)[0])}" for c in categories) + " END")

    rows = sequences.withColumn("chunk", F.floor(F.unix_date("date") / chunk))
    # stated here, not only inferred from the join, so that both uses of the chunks read one exchange
    known = " AND ".join(f"{c} IS NOT NULL" for c in [*KEYS, "chunk"])
    # dealt by chunk explicitly: an input that is already dealt by site would be packed where it lies, without an exchange that
    # both uses could read, and everything before would be computed twice
    rows = rows.filter(known).select(*KEYS, "chunk", "date", "probabilities").repartition(*KEYS, "chunk")
    chunks = rows.groupBy(*KEYS, "chunk").agg(F.array_sort(F.collect_list(F.struct("date", "probabilities"))).alias("days"))
    flat = F.flatten(F.col("days.probabilities"))
    joined = (
        chunks.select(*KEYS, "chunk", product("category", flat).alias("product"))
        .groupBy(*KEYS)
        .agg(F.array_sort(F.collect_list(F.struct("chunk", "product"))).alias("parts"))
        .select(*KEYS, F.col("parts.chunk").alias("chunks"), surroundings("category", F.flatten(F.col("parts.product"))).alias("around"))
    )
    placed = joined.select(*KEYS, "around", F.posexplode("chunks").alias("place", "chunk")).select(
        *KEYS, "chunk", (F.col("place") == 0).alias("opens"), F.slice("around", F.col("place") * (k + 1) + 1, k + 1).alias("around")
    )
    found = chunks.join(placed, [*KEYS, "chunk"]).select(
        *KEYS, F.col("days.date").alias("dates"), path("category", "opens", flat, "around").alias("path")
    )
    return _unpack(found).select(
        "phenocam_name", F.year("date").alias("year"), "date", "site_sequence_id", "category", _state_name().alias("hmm_class")
    )
