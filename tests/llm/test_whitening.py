"""Whitening against plain numpy; the spectral decomposition on hard matrices."""

import math

import numpy as np
import pytest

from fieldstate.llm import whitening


def plain(rows):
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(1024 * c) + 100000 for c in v] for _, v in kept]
    n, d = len(x), len(x[0])
    sums = [sum(r[k] for r in x) for k in range(d)]
    y = np.array([[r[k] - sums[k] / n for k in range(d)] for r in x])
    e, v = np.linalg.eigh(y.T @ y / n)
    e, v = e[::-1], v[:, ::-1]
    deviation = [sum((n * r[k] - sums[k]) ** 2 for k in range(d)) for r in x]
    return [i for i, _ in kept], n, deviation, y @ v[:, :8] / np.sqrt(e[:8]), e / e.sum()


def compare(got, want, tolerance=1e-7):
    ids, n, deviation, whitened, explained = want
    k = whitened.shape[1]
    got = sorted(got, key=lambda r: (r.vec_id, r.component))
    order = np.argsort(ids)
    assert [(r.vec_id, r.component) for r in got] == [(ids[i], c + 1) for i in order for c in range(k)]
    assert all(r.n == n for r in got) and [r.deviation for r in got[::k]] == [deviation[i] for i in order]
    w = np.array([r.whitened for r in got]).reshape(-1, k)
    signs = np.sign((w * whitened[order]).sum(axis=0))
    assert np.abs(w * signs - whitened[order]).max() < tolerance
    assert np.allclose([r.explained for r in got[:k]], explained[:k], rtol=1e-9)
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9


def test_equals_numpy_on_the_given_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding)) for r in table.select("vec_id", "embedding").collect()]
    compare(whitening.digest(table).collect(), plain(rows))


def test_odd_rows_and_clashing_columns(spark):
    rng = np.random.default_rng(2)
    rows = [(k, (rng.normal(size=5) * [9, 4, 2, 1, 0.3] + 50).tolist()) for k in range(200)]
    bad = [(300, None), (301, [1.0, None, 1.0, 1.0, 1.0]), (302, [1.0, math.nan, 0.0, 0.0, 0.0]), (303, [math.inf] * 5), (304, [1.0, 2.0]), (305, [])]
    table = spark.createDataFrame([(i, v, "n", 0.5, [1]) for i, v in rows + bad], "vec_id long, embedding array<double>, v string, component double, o array<int>")
    compare(whitening.digest(table.repartition(3)).collect(), plain(rows))
    twice = whitening.digest(table.filter("vec_id < 200").union(table.filter("vec_id < 200"))).collect()
    assert len(twice) == 2000 and twice[0].n == 400


def test_large_values_stay_exact(spark):
    """Entries of several limbs; deviations that no long holds are null."""
    rng = np.random.default_rng(4)
    rows = [(k, (rng.normal(size=3) * [1e7, 1e3, 1]).tolist()) for k in range(40)]
    schema = "vec_id long, embedding array<double>"
    table = spark.createDataFrame(rows, schema)
    want = plain(rows)
    want[2][:] = [x if x < 1 << 63 else None for x in want[2]]
    assert None in want[2]
    compare(whitening.digest(table).collect(), want, 1e-6)
    whitening.digest(spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0])], schema)).collect()


def test_no_variance_and_empty(spark):
    schema = "vec_id long, embedding array<double>"
    same = whitening.digest(spark.createDataFrame([(1, [0.5, 2.0]), (2, [0.5, 2.0]), (None, [0.5, 2.0])], schema)).collect()
    assert len(same) == 6 and all(r.whitened == 0.0 and r.deviation == 0 and r.explained == 0.0 and r.identity_error == 0.0 for r in same)
    for rows in ([], [(1, None)], [(1, [])]):
        assert whitening.digest(spark.createDataFrame(rows, schema)).collect() == []


@pytest.mark.parametrize("name", ["random", "repeated", "graded", "close", "one", "identity", "zero"])
def test_spectrum(name):
    rng = np.random.default_rng(7)
    q, _ = np.linalg.qr(rng.normal(size=(40, 40)))
    values = {
        "random": rng.random(40), "repeated": np.repeat([5.0, 4.0, 1e-3, 0.0], 10), "graded": np.logspace(6, -12, 40),
        "close": 1 + 1e-14 * np.arange(40), "one": np.eye(40)[0], "identity": np.ones(40), "zero": np.zeros(40),
    }[name]
    a = (q * values) @ q.T
    a = (a + a.T) / 2
    e, v = whitening.spectrum(a)
    norm = max(np.linalg.norm(a), 1.0)
    assert np.abs(e - np.sort(values)[::-1]).max() < 1e-14 * norm
    assert np.abs(v.T @ v - np.eye(40)).max() < 1e-14 and np.abs(a @ v - v * e).max() < 1e-14 * norm
    assert (np.diff(e) <= 0).all()


def test_polar_factor_is_the_sign():
    rng = np.random.default_rng(8)
    a = rng.normal(size=(30, 30))
    a = a + a.T
    e, v = np.linalg.eigh(a)
    assert np.abs(whitening.polar(a) - (v * np.sign(e)) @ v.T).max() < 1e-13
