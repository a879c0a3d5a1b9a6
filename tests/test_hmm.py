"""Decoding: hand cases and comparison with exhaustive search."""

import itertools
import math
from datetime import date, timedelta

import numpy as np
import pytest

from fieldstate import schema as S
from fieldstate.operators import hmm

SCHEMA = "phenocam_name STRING, year INT, date DATE, category STRING, site_sequence_id BIGINT, probabilities ARRAY<DOUBLE>"
DAY0 = date(2019, 12, 20)


def sequences(spark, category, *series):
    rows = [
        (f"s{i}", 2020, DAY0 + timedelta(t), category, 1, [float(p) for p in probs])
        for i, probs_list in enumerate(series)
        for t, probs in enumerate(probs_list)
    ]
    return spark.createDataFrame(rows, SCHEMA)


def paths(df):
    out = {}
    for r in df.orderBy("phenocam_name", "date").collect():
        out.setdefault(r.phenocam_name, []).append(r.hmm_class)
    return out


DECODERS = [hmm.viterbi_decode, lambda df: hmm.viterbi_decode_long(df, chunk=3)]


@pytest.mark.parametrize("decode", DECODERS)
def test_flicker_is_smoothed_and_forbidden_step_avoided(spark, decode):
    veg, soil = [0.6, 0.1, 0.1, 0.1, 0.1], [0.3, 0.1, 0.4, 0.1, 0.1]
    strong_soil, strong_residue = [0.01, 0.01, 0.96, 0.01, 0.01], [0.01, 0.96, 0.01, 0.01, 0.01]
    got = paths(decode(sequences(spark, "dominant_cover", [veg, veg, soil, veg, veg], [strong_soil] * 6 + [strong_residue] * 6, [soil])))
    assert got["s0"] == ["vegetation"] * 5
    pairs = list(zip(got["s1"], got["s1"][1:]))
    assert ("soil", "residue") not in pairs
    assert got["s2"] == ["soil"]


@pytest.mark.parametrize("decode", DECODERS)
def test_dead_end_is_left_out_and_reported(spark, decode):
    only = [[1.0 if k == s else 0.0 for k in range(6)] for s in (0, 2)]  # emergence straight to flowers: no such step
    df = sequences(spark, "crop_status", [only[0], only[1]], [only[0], only[0]])
    assert paths(decode(df)) == {"s1": ["emergence", "emergence"]}
    failed = hmm.hmm_failures(df).collect()
    assert [(r.phenocam_name, r.n_days) for r in failed] == [("s0", 2)]


def exhaustive(category, probs):
    states, start, transition = hmm.hmm_spec(category)
    best, path = -math.inf, None
    for p in itertools.product(range(len(states)), repeat=len(probs)):
        score = math.prod([start[p[0]]] + [transition[a][b] for a, b in zip(p, p[1:])] + [probs[t][s] for t, s in enumerate(p)])
        if score > best:
            best, path = score, [states[s] for s in p]
    return path if best > 0 else None


@pytest.mark.parametrize("category", list(S.HMM_MODELS))
def test_matches_exhaustive_search(spark, category):
    rng = np.random.default_rng(11)
    k = len(hmm.hmm_spec(category)[0])
    series = [rng.dirichlet(np.ones(k) * 0.4, size=int(n)).round(4) for n in rng.integers(1, 6, size=25)]
    want = {f"s{i}": exhaustive(category, s) for i, s in enumerate(series)}
    want = {name: path for name, path in want.items() if path}
    df = sequences(spark, category, *series)
    assert paths(hmm.viterbi_decode(df)) == want
    assert paths(hmm.viterbi_decode_long(df, chunk=2)) == want


def test_chunked_equals_direct_with_ties(spark):
    rng = np.random.default_rng(5)
    choices = np.array([[0.2] * 5, [0.5, 0.5, 0, 0, 0], [0, 0.4, 0.4, 0.1, 0.1], [0.25, 0.25, 0.25, 0.25, 0]])
    series = [choices[rng.integers(0, 4, size=n)] for n in (1, 2, 50, 333)]
    df = sequences(spark, "dominant_cover", *series)
    direct = paths(hmm.viterbi_decode(df))
    for chunk in (1, 7, 100, 1000):
        assert paths(hmm.viterbi_decode_long(df, chunk=chunk)) == direct


def test_emission_logprob(spark):
    df = spark.createDataFrame([(0.5,), (0.0,), (None,)], "p DOUBLE").select(hmm.emission_logprob("p").alias("v"))
    a, b, c = [r.v for r in df.collect()]
    assert a == pytest.approx(math.log(0.5)) and b == -math.inf and c is None


@pytest.mark.parametrize("category", list(S.HMM_MODELS))
def test_scan_equals_direct_for_both_models(spark, category):
    """Random and tied days, impossible states, chunks of one day and of many."""
    rng = np.random.default_rng(9)
    k = len(hmm.hmm_spec(category)[0])
    coarse = [np.round(rng.dirichlet(np.ones(k) * 0.3, size=n) * 4) / 4 + 0.05 * rng.integers(0, 2, size=(n, k)) for n in (1, 2, 3, 40, 129, 260)]
    fine = [rng.dirichlet(np.ones(k) * 0.5, size=n) for n in (64, 65, 200)]
    equal = [np.full((90, k), 1 / k)]
    df = sequences(spark, category, *coarse, *fine, *equal)
    direct = paths(hmm.viterbi_decode(df))
    assert len(direct) >= 4
    for chunk in (1, 5, 64, 1000):
        assert paths(hmm.viterbi_decode_long(df, chunk=chunk)) == direct


def test_one_sequence_of_200000_days_in_several_tasks(spark):
    """The states of a random walk, observed with noise, against the direct decoder on the packed sequence."""
    n, k = 200_000, 5
    rng = np.random.default_rng(3)
    truth = np.repeat(rng.integers(0, k, size=n // 40), 40)
    probs = np.round(np.where(np.arange(k) == truth[:, None], 0.5, 0.1) * rng.uniform(0.2, 1, size=(n, k)), 6)
    rows = [(i, probs[i].tolist()) for i in range(n)]
    from pyspark.sql import functions as F

    days = spark.createDataFrame(rows, "i INT, probabilities ARRAY<DOUBLE>").repartition(8).select(
        F.lit("s").alias("phenocam_name"), F.lit(0).alias("year"), F.expr("date_add(DATE '1500-01-01', i)").alias("date"),
        F.lit("dominant_cover").alias("category"), F.lit(1).cast("bigint").alias("site_sequence_id"), "probabilities",
    )
    found = hmm.viterbi_decode_long(days, chunk=4096)
    got = {(r.date, r.hmm_class) for r in found.collect()}
    want = {(r.date, r.hmm_class) for r in hmm.viterbi_decode(days).collect()}
    assert len(got) == n and got == want
    # the chunks are shuffled once for both uses, and those of the one sequence are spread over tasks
    plan = found._jdf.queryExecution().executedPlan().toString()
    final = plan[plan.index("Final Plan") : plan.index("Initial Plan")]
    assert "ReusedExchange" in final and final.count("Scan") == 1 and final.count("ArrowEvalPython") == 3
    assert found.select(F.spark_partition_id()).distinct().count() > 1


def test_building_the_plan_runs_no_job(spark):
    df = sequences(spark, "dominant_cover", [[0.2] * 5] * 4)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("plan", "plan")
    hmm.viterbi_decode_long(df, chunk=2)
    assert not tracker.getJobIdsForGroup("plan")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
