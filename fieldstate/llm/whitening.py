"""Whitening of embeddings by spectral divide and conquer.

Spark gathers exact integer sums and an exact integer Gram matrix of the vectors shifted by their rounded mean; from them the
covariance comes out with one rounding per entry. The driver sees nothing but these d x d numbers. It splits the covariance
recursively: the polar factor of the matrix minus a shift, found by the QDWH iteration, is the sign of that matrix; half of
identity plus sign projects on the eigenvectors above the shift, and an orthonormal basis of both projections leaves two
smaller problems. The components and their scales travel to the tasks with the job, where every row is whitened.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EPS = np.finfo(np.float64).eps
#: Rows whose products are summed at once; with shifted entries below 2 ** LIMB the sums are exact in a double.
BLOCK, LIMB = 4096, 20
#: Entries beyond this are held at it, so that every x is a whole number that a double holds.
LARGEST = float(1 << 50)


# ---- spectral decomposition ----------------------------------------------------------------------------
def polar(a: np.ndarray, limit: int = 30) -> np.ndarray:
    """Orthogonal polar factor of a symmetric matrix by the QR form of the dynamically weighted Halley iteration."""
    d = len(a)
    x = a / max(np.linalg.norm(a), np.finfo(float).tiny)
    low = max(1 / (np.linalg.norm(np.linalg.inv(x)) if np.linalg.matrix_rank(x) == d else np.inf), EPS) * 0.9
    for _ in range(limit):
        # weights that raise the bound ``low`` on the least singular value as far as one step can
        gamma = np.cbrt(4 * (1 - low * low) / low**4)
        root = np.sqrt(1 + gamma)
        wa = root + 0.5 * np.sqrt(8 - 4 * gamma + 8 * (2 - low * low) / (low * low * root))
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        q, _ = np.linalg.qr(np.vstack([np.sqrt(wc) * x, np.eye(d)]))
        new = (wb / wc) * x + (wa - wb / wc) / np.sqrt(wc) * q[:d] @ q[d:].T
        new = (new + new.T) / 2
        low = min(low * (wa + wb * low * low) / (1 + wc * low * low), 1.0)
        moved = np.linalg.norm(new - x)
        x = new
        if moved < 10 * EPS * np.sqrt(d) or (1 - low < 10 * EPS and moved < np.cbrt(EPS) * EPS):
            break
    return x


def basis(projector: np.ndarray, rank: int) -> tuple[np.ndarray, np.ndarray]:
    """Orthonormal bases of a projector's range and of its complement."""
    d = len(projector)
    order = np.argsort(-np.diag(projector), kind="stable")
    q, _ = np.linalg.qr(np.hstack([projector[:, order[:rank]], np.eye(d)[:, order[rank:]]]))
    for _ in range(2):  # columns picked by their diagonal may be close to dependent; one power step mends that
        top, _ = np.linalg.qr(projector @ q[:, :rank])
        rest, _ = np.linalg.qr(q[:, rank:] - top @ (top.T @ q[:, rank:]))
        q = np.hstack([top, rest])
    return q[:, :rank], q[:, rank:]


def rotated(a: np.ndarray) -> np.ndarray:
    """Eigenvectors of a small symmetric matrix by plane rotations."""
    a, v = a.copy(), np.eye(len(a))
    for _ in range(60):
        if np.abs(a - np.diag(np.diag(a))).max(initial=0) <= EPS * np.abs(np.diag(a)).max(initial=0) / 16:
            break
        for i in range(len(a) - 1):
            for j in range(i + 1, len(a)):
                if a[i, j]:
                    angle = 0.5 * np.arctan2(2 * a[i, j], a[i, i] - a[j, j])
                    turn = np.array([[np.cos(angle), -np.sin(angle)], [np.sin(angle), np.cos(angle)]])
                    a[:, [i, j]] = a[:, [i, j]] @ turn
                    a[[i, j]] = turn.T @ a[[i, j]]
                    v[:, [i, j]] = v[:, [i, j]] @ turn
    return v


def shifts(a: np.ndarray) -> Iterator[float]:
    """Places to split at: the median of the diagonal first, then others across the range of eigenvalues."""
    diagonal = np.sort(np.diag(a))
    yield float(np.median(diagonal))
    spread = np.sqrt(np.maximum(np.sum(a * a) - np.sum(np.trace(a) ** 2) / len(a), 0) / len(a))
    centre = float(np.trace(a)) / len(a)
    for k in (0.0, 0.5, -0.5, 1.0, -1.0, 0.25, -0.25):
        yield centre + k * spread
    yield from (float((x + y) / 2) for x, y in zip(diagonal[:-1], diagonal[1:]))


def eigenvectors(a: np.ndarray, norm: float | None = None) -> np.ndarray:
    """Orthonormal eigenvectors of a symmetric matrix, as columns in no order."""
    d = len(a)
    norm = np.linalg.norm(a) if norm is None else norm
    if d <= 2:
        return rotated(a)
    if np.linalg.norm(a - np.diag(np.diag(a))) <= EPS * norm:
        return np.eye(d)
    best = None
    for shift in shifts(a):
        sign = polar(a - shift * np.eye(d))
        rank = int(np.rint((np.trace(sign) + d) / 2))
        if not 0 < rank < d:
            continue
        v, w = basis((sign + np.eye(d)) / 2, rank)
        left = np.linalg.norm(w.T @ (a @ v))
        if best is None or left < best[0]:
            best = (left, v, w)
        if left <= 16 * EPS * np.sqrt(d) * norm:  # else an eigenvalue lies at the shift
            break
    if best is None:  # all eigenvalues so close together that no shift parts them
        return rotated(a)
    _, v, w = best
    parts = [x @ eigenvectors((m + m.T) / 2, norm) for x in (v, w) for m in [x.T @ a @ x]]
    return np.hstack(parts)


def spectrum(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix, falling, and unit eigenvectors as columns with a fixed sign.

    After the recursion, one round of refinement takes out what the splits left beside the diagonal.
    """
    v = eigenvectors(a)
    for _ in range(2):
        v, _ = np.linalg.qr(v)
        m = v.T @ a @ v
        e = np.diag(m)
        gap = e[None, :] - e[:, None]
        apart = np.abs(gap) > np.sqrt(EPS) * np.linalg.norm(a)
        v = v @ (np.eye(len(a)) + np.where(apart, m / np.where(apart, gap, 1), 0))
    v, _ = np.linalg.qr(v)
    e = np.einsum("ij,ij->j", v, a @ v)
    order = np.argsort(-e, kind="stable")
    e, v = np.maximum(e[order], 0), v[:, order]
    largest = np.abs(v).argmax(axis=0)
    return e, v * np.where(v[largest, np.arange(len(a))] < 0, -1, 1)


# ---- rows ----------------------------------------------------------------------------------------------
def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of the rows whose vector is there, with no null, NaN or infinite entry."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))))
    return rows.filter(F.col("v").isNotNull() & finite)


def whole(column: pa.Array, d: int) -> np.ndarray:
    """x = floor(1024 c) + 100000 of a batch."""
    c = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
    return np.floor(np.clip(1024 * c, -LARGEST, LARGEST)).astype(np.int64) + 100_000


def totals(rows: DataFrame, d: int) -> tuple[int, list[int]]:
    """n and the exact sums per dimension; sums per task, then one row per dimension."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, np.zeros((2, d), object)
        for batch in batches:
            x = whole(batch.column(0), d)
            n += len(x)
            sums[0] += (x >> 32).sum(axis=0).astype(object)
            sums[1] += (x & 0xFFFFFFFF).sum(axis=0).astype(object)
        total = [int(a) * (1 << 32) + int(b) for a, b in sums.T]
        yield pa.record_batch([pa.array(range(-1, d), pa.int32()), pa.array([str(t) for t in (n, *total)])], ["dim", "total"])

    got = rows.select("v").mapInArrow(emit, "dim int, total string")
    sums = {r["dim"]: int(r["total"]) for r in got.groupBy("dim").agg(F.sum(F.col("total").cast("decimal(38, 0)")).alias("total")).collect()}
    return sums.get(-1, 0), [sums.get(k, 0) for k in range(d)]


def gram(rows: DataFrame, d: int, shift: np.ndarray) -> list[list[int]]:
    """Exact sums of products of the entries of x - shift, over all rows.

    An entry is split into limbs of 20 bits where it needs more, so that a block's products sum exactly in a double. A task
    adds its blocks in two halves of 32 bits and sends one row per line of the matrix; lines meet by number, and a task adds
    the rows it gets one by one.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        halves = np.zeros((2, d, d), np.int64)
        wide = None
        for batch in batches:
            y = whole(batch.column(0), d) - shift
            limbs = max(1, -(-int(np.abs(y).max(initial=0)).bit_length() // LIMB))
            for at in range(0, len(y), BLOCK):
                part = y[at : at + BLOCK]
                sign, size = np.sign(part), np.abs(part)
                limb = [(sign * (size >> LIMB * k & (1 << LIMB) - 1)).astype(np.float64) for k in range(limbs)]
                for i in range(limbs):
                    for j in range(limbs):
                        g = (limb[i].T @ limb[j]).astype(np.int64)
                        if i + j == 0:
                            halves[0] += g >> 32
                            halves[1] += g & 0xFFFFFFFF
                        else:
                            wide = (0 if wide is None else wide) + g.astype(object) * (1 << LIMB * (i + j))
        total = halves[0].astype(object) * (1 << 32) + halves[1] + (0 if wide is None else wide)
        yield pa.record_batch([pa.array(range(d), pa.int32()), pa.array([[str(x) for x in line] for line in total])], ["line", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines: dict[int, np.ndarray] = {}
        for batch in batches:
            for line, sums in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                lines[line] = lines.get(line, 0) + np.array([int(x) for x in sums], object)
        if lines:
            yield pa.record_batch([pa.array(list(lines), pa.int32()), pa.array([[str(x) for x in v] for v in lines.values()])], ["line", "sums"])

    schema = "line int, sums array<string>"
    got = {r["line"]: [int(x) for x in r["sums"]] for r in rows.select("v").mapInArrow(emit, schema).repartition("line").mapInArrow(add, schema).collect()}
    return [got.get(k, [0] * d) for k in range(d)]


def covariance(n: int, sums: list[int], products: list[list[int]], shift: np.ndarray) -> np.ndarray:
    """The covariance with divisor n, each entry rounded once."""
    rest = [s - n * int(m) for s, m in zip(sums, shift)]  # sums of the shifted entries
    return np.array([[(n * p - a * b) / (n * n) for p, b in zip(line, rest)] for line, a in zip(products, rest)])


class Fit:
    """What whitening needs: n, sums, mean, components as columns, eigenvalues, trace of the covariance."""

    def __init__(self, rows: DataFrame, components: int):
        sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
        self.d = sizes[0]["d"] if sizes else 0
        self.rows = rows.filter(F.size("v") == self.d)
        self.n, self.sums = totals(self.rows, self.d) if self.d else (0, [])
        self.shift = np.array([round_half(s, self.n) for s in self.sums], np.int64)
        self.fraction = np.array([(s - self.n * int(m)) / self.n for s, m in zip(self.sums, self.shift)])
        v = covariance(self.n, self.sums, gram(self.rows, self.d, self.shift), self.shift) if self.d else np.zeros((0, 0))
        values, vectors = spectrum(v) if self.d else (np.zeros(0), v)
        self.trace = float(np.trace(v))
        self.values, self.vectors = values[:components], vectors[:, :components]
        null = self.values <= self.d * EPS * max(self.trace, 0)
        self.scale = np.where(null, 0.0, 1 / np.sqrt(np.where(null, 1, self.values)))
        self.explained = self.values / self.trace if self.trace > 0 else np.zeros(len(self.values))

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.shift) - self.fraction) @ self.vectors * self.scale

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "rows"}


def round_half(total: int, n: int) -> int:
    return (2 * total + n) // (2 * n)


def identity_error(fit: Fit) -> float:
    """Largest absolute entry of the whitened rows' measured covariance minus the identity, over components with variance."""
    k = len(fit.values)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, products = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            w = fit.whitened(whole(batch.column(0), fit.d))
            sums += w.sum(axis=0)
            products += w.T @ w
        yield pa.record_batch([pa.array(range(-1, k), pa.int32()), pa.array([sums, *products], pa.list_(pa.float64()))], ["line", "sums"])

    got = fit.rows.select("v").mapInArrow(emit, "line int, sums array<double>")
    lines = got.select("line", F.posexplode("sums").alias("at", "x")).groupBy("line", "at").agg(F.sum("x").alias("x")).collect()
    both = np.zeros((k + 1, k))
    for r in lines:
        both[r["line"] + 1, r["at"]] = r["x"] / fit.n
    alive = np.flatnonzero(fit.scale)
    error = both[1:] - np.outer(both[0], both[0]) - np.eye(k)
    return float(np.abs(error[np.ix_(alive, alive)]).max(initial=0.0))


OUT = "whitened array<double>, deviation long"


def whiten(vectors: DataFrame, components: int = 8, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, Fit]:
    """((id, whitened, deviation) of every usable row, the fit).

    Rows whose vector is null or holds a null or non-finite entry are left out; so are vectors of another length than most (of
    equally frequent lengths the longest counts). Entries c become ``x = floor(1024 c) + 100000``, held at 2 ** 50. All other
    rows are in the fit and in the result, also where ids repeat or are null. ``whitened`` projects x - mean on the first
    ``components`` eigenvectors (all, if there are fewer) over the root of the eigenvalue; where that is 0 up to rounding it
    is 0.0. ``deviation`` is the exact sum of (n x - sum) ** 2, null where no long holds it. An empty table gives no rows.
    """
    fit = Fit(usable(vectors, id_col, vector_col), components)
    @F.arrow_udf(OUT)
    def run(v: pa.Array) -> pa.Array:
        x = whole(v, fit.d)
        w = fit.whitened(x)
        y = x - fit.shift
        rest = np.array([s - fit.n * int(m) for s, m in zip(fit.sums, fit.shift)], object)
        if float(np.abs(y).max(initial=0) + 1) * fit.n < 2.0**31 / np.sqrt(fit.d):
            deviation = ((fit.n * y - rest.astype(np.int64)) ** 2).sum(axis=1).tolist()
        else:
            deviation = [t if (t := int((row * row).sum())) < 1 << 63 else None for row in fit.n * y.astype(object) - rest]
        flat = pa.array(w.ravel())
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1) * w.shape[1], pa.int32()), flat)
        return pa.StructArray.from_arrays([lists, pa.array(deviation, pa.int64())], ["whitened", "deviation"])

    nothing = F.lit(None).cast("struct<whitened: array<double>, deviation: bigint>")
    out = fit.rows.withColumn("o", run("v") if fit.d else nothing)
    return out.select(F.col("id").alias(id_col), "o.whitened", "o.deviation"), fit


def digest(vectors: DataFrame, components: int = 8, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error), one row per usable row and component."""
    rows, fit = whiten(vectors, components, id_col, vector_col)
    error = identity_error(fit) if fit.d else 0.0
    explained = F.array(*[F.lit(float(x)) for x in fit.explained]) if fit.d else F.array().cast("array<double>")
    return rows.select(id_col, "deviation", F.posexplode("whitened").alias("at", "whitened")).select(
        id_col, (F.col("at") + 1).cast("int").alias("component"), F.lit(fit.n).cast("long").alias("n"), "deviation", "whitened",
        F.element_at(explained, F.col("at") + 1).alias("explained"), F.lit(error).alias("identity_error"),
    )
