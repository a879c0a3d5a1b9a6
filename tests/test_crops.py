"""Segments, votes, final table, transitions and harvests."""

from datetime import date, timedelta

import pytest

from fieldstate import schema as S
from fieldstate.operators import croptype, sites, transitions
from fieldstate.operators import islands as I

DAY0 = date(2020, 1, 1)
HMM = "phenocam_name STRING, year INT, date DATE, site_sequence_id BIGINT, category STRING, hmm_class STRING"


def hmm_rows(spark, days):
    """(day number, cover, status) of one site."""
    rows = []
    for n, cover, status in days:
        d = DAY0 + timedelta(n)
        rows += [("a", d.year, d, 1, c, v) for c, v in (("dominant_cover", cover), ("crop_status", status)) if v]
    return spark.createDataFrame(rows, HMM)


def types(spark, days):
    rows = []
    for n, shares in days:
        p = [0.0] * 7
        for name, v in shares.items():
            p[S.CLASSES["crop_type"].index(name) - 1] = v
        rows.append(("a", DAY0 + timedelta(n), p))
    return spark.createDataFrame(rows, "phenocam_name STRING, date DATE, probabilities ARRAY<DOUBLE>")


def test_segments_start_at_zero_and_split_on_missing_days(spark):
    states = [(0, "soil", "growth"), (1, "soil", "growth"), (3, "soil", "growth"), (4, "soil", "no_crop"), (5, "soil", "growth"), (6, "soil", None)]
    got = croptype.crop_segments(hmm_rows(spark, states)).orderBy("date").collect()
    assert [(r.date.day - 1, r.crop_sequence_id) for r in got] == [(0, 0), (1, 0), (3, 1), (5, 2)]


def test_vote_tie_unknown_rules_and_final(spark):
    days = [(n, "soil", "emergence") for n in range(60)]                       # short, emergence
    days += [(n, "soil", "emergence") for n in range(70, 131)]                 # 61 days
    days += [(n, "soil", "growth") for n in range(140, 142)]                   # voted no_crop
    days += [(n, "soil", s) for n, s in ((150, "growth"), (151, "flowers"))]   # mode tie
    days += [(160, "soil", "growth"), (165, "soil", "no_crop")]                # no votes; no crop
    states = hmm_rows(spark, days)
    segments = croptype.crop_segments(states)
    share = {"corn": 0.5, "soybean": 0.5}
    probs = types(spark, [(0, share), (70, share), (140, {"no_crop": 0.9}), (150, {"unknown_plant": 0.9, "other": 0.1})])
    votes = croptype.vote_crop_type(probs, segments)
    assert {r.crop_sequence_id: r.crop_class for r in votes.collect()} == {0: "corn", 1: "corn", 2: "no_crop", 3: "other"}
    tied = croptype.vote_uniqueness_check(probs, segments).collect()
    assert sorted((r.crop_sequence_id, r.n) for r in tied) == [(0, 2), (1, 2)]
    modes = croptype.segment_mode_status(segments)
    assert {r.crop_sequence_id: (r.most_common_status, r.n_days) for r in modes.collect()}[3] == ("flowers", 2)
    ruled = croptype.unknown_rules(votes, modes)
    assert {r.crop_sequence_id: r.crop_class for r in ruled.collect()} == {0: "unknown_plant", 1: "corn", 2: "unknown_plant", 3: "other"}
    final = {(r.date - DAY0).days: r.crop_type for r in croptype.final_predictions(states, segments, ruled).collect()}
    assert (final[5], final[100], final[141], final[151], final[160], final[165]) == ("unknown_plant", "corn", "unknown_plant", "other", None, "no_crop")


def test_one_plan_equals_stage_operators(spark):
    from fieldstate.plans import catalog

    d = "/root/testdata/sf0.001"
    a = sorted(map(str, catalog.QUERIES["field_states"](spark, d).collect()))
    b = sorted(map(str, catalog.QUERIES["final_predictions"](spark, d).collect()))
    assert len(a) > 1000 and a == b


def test_transitions_need_the_calendar_day_before(spark):
    rows = [
        ("a", date(2019, 12, 31), "residue", "no_crop"), ("a", date(2020, 1, 1), "soil", "emergence"),
        ("a", date(2020, 1, 3), "vegetation", "growth"), ("a", date(2020, 1, 4), "soil", "growth"),
        ("a", date(2020, 1, 6), "residue", None), ("b", date(2020, 1, 7), "soil", None),
    ]
    df = spark.createDataFrame(rows, "phenocam_name STRING, date DATE, dominant_cover STRING, crop_status STRING")
    got = transitions.state_transitions(df).orderBy("date", "transition").collect()
    assert [(r.date.isoformat(), r.transition, r.prior_day_class, r.doy) for r in got] == [
        ("2020-01-01", "emergence", "no_crop", 1), ("2020-01-01", "tillage", "residue", 1), ("2020-01-04", "harvest-to-soil", "vegetation", 4),
    ]


def test_mean_change_and_harvest(spark):
    veg = [0.9, 0.9, 0.9, 0.1, 0.7, 0.7, 0.7, None, 0.7]
    rows = [("a", DAY0 + timedelta(i), None if v is None else [0.0, v, (1 - v) / 2, (1 - v) / 2, 0.0, 0.0]) for i, v in enumerate(veg)]
    df = spark.createDataFrame(rows, "phenocam_name STRING, date DATE, dominant_cover ARRAY<DOUBLE>")
    window = I.ordered(["phenocam_name"], ["date"])
    from pyspark.sql import functions as F

    change = df.select("date", transitions.mean_change(F.get("dominant_cover", F.lit(1)), window, 7).alias("c")).orderBy("date").collect()
    values = [r.c for r in change]
    assert values[3] == pytest.approx(-0.2) and [v is None for v in values] == [i != 3 for i in range(9)]
    hit = transitions.harvest_detect(df, vegetation=-0.19, soil_residue=0.19).orderBy("date").collect()
    assert [r.transition_harvest for r in hit] == [i == 3 for i in range(9)]
    assert not any(r.transition_harvest for r in transitions.harvest_detect(df, vegetation=-0.21).collect())
    with pytest.raises(ValueError):
        transitions.mean_change("x", window, 4)
    with pytest.raises(ValueError):
        transitions.mean_change("x", window, 3)


def test_duplicate_site_names_do_not_multiply_rows(spark):
    rois = spark.createDataFrame(
        [("a", 1.0, 2.0, "AG", 1000, 2.5), ("a", 3.0, 4.0, "AG", 2000, 4.0), ("b", 0.0, 0.0, "AG", 1000, 3.0)],
        "phenocam_name STRING, lat DOUBLE, lon DOUBLE, roi_type STRING, roi_id INT, site_years DOUBLE",
    )
    final = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "phenocam_name STRING, x INT")
    got = sites.publish_join(final, rois).orderBy("x").collect()
    assert [(r.x, r.lat, r.site_years) for r in got] == [(1, 3.0, 4.0), (2, 0.0, 3.0), (3, None, None)]
    assert [r.phenocam_name for r in sites.select_sites(rois, ["b"]).collect()] == ["a", "a"]
    assert sites.select_sites(rois, rois.select("phenocam_name")).count() == 0
