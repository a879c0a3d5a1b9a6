"""Hand cases for cleaning: gaps, masks, calendar, sequences."""

from datetime import date, timedelta

import numpy as np
import pytest

from fieldstate import schema as S
from fieldstate.operators import checks, series

DAY0 = date(2020, 2, 27)
SCHEMA = (
    "phenocam_name STRING, date DATE, file STRING, dominant_cover ARRAY<DOUBLE>, crop_type ARRAY<DOUBLE>, crop_status ARRAY<DOUBLE>"
)


def vec(category, **at):
    values = [0.0] * S.WIDTHS[category]
    for name, p in at.items():
        values[S.code(category, name)] = p
    return values


def table(spark, rows):
    """Rows of (site, day number, cover, type, status); file names follow the day and the order given."""
    data = [
        (s, DAY0 + timedelta(n), f"{s}_{i:04d}.jpg", c, t, u) for i, (s, n, c, t, u) in enumerate(rows)
    ]
    return spark.createDataFrame(data, SCHEMA)


def status_series(spark, values, days=None):
    """One site; ``values`` are probabilities of growth, None for a missing vector."""
    cover, kind = vec("dominant_cover", soil=1.0), vec("crop_type", corn=1.0)
    days = days or range(len(values))
    return table(spark, [("a", d, cover, kind, None if v is None else vec("crop_status", growth=v)) for d, v in zip(days, values)])


def growth(df):
    rows = df.select("date", "crop_status").orderBy("date").collect()
    return [None if r.crop_status is None else round(r.crop_status[2], 9) for r in rows]


@pytest.mark.parametrize("fill", [series.interpolate_daily, series.interpolate_gaps])
def test_gap_limits_and_edges(spark, fill):
    df = status_series(spark, [None, 0.0, None, None, 0.3, None, None, None, 0.7, None])
    assert growth(fill(df, 2)) == [None, 0.0, 0.1, 0.2, 0.3, None, None, None, 0.7, None]
    assert growth(fill(df, 3)) == [None, 0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, None]


@pytest.mark.parametrize("fill", [series.interpolate_daily, series.interpolate_gaps])
def test_gap_needs_two_values(spark, fill):
    assert growth(fill(status_series(spark, [None, None, None]), 5)) == [None, None, None]
    assert growth(fill(status_series(spark, [None, 0.5, None]), 5)) == [None, 0.5, None]


@pytest.mark.parametrize("fill", [series.interpolate_daily, series.interpolate_gaps])
def test_gap_by_row_or_by_date(spark, fill):
    df = status_series(spark, [0.0, None, 0.8], days=[0, 1, 8])
    assert growth(fill(df, 5)) == [0.0, 0.4, 0.8]
    assert growth(fill(df, 5, by="date")) == [0.0, None, 0.8]
    assert growth(fill(df, 7, by="date")) == [0.0, 0.1, 0.8]


def brute_force(values, max_gap):
    out = list(values)
    known = [i for i, v in enumerate(values) if v is not None]
    for a, b in zip(known, known[1:]):
        if b - a - 1 <= max_gap:
            for i in range(a + 1, b):
                out[i] = values[a] + (values[b] - values[a]) * ((i - a) / (b - a))
    return [None if v is None else round(v, 9) for v in out]


@pytest.mark.parametrize("partitions", [1, 7, 64])
def test_general_interpolation_matches_brute_force_with_many_images_per_day(spark, partitions):
    rng = np.random.default_rng(3)
    cover, kind = vec("dominant_cover", soil=1.0), vec("crop_type", corn=1.0)
    rows, want = [], {}
    for site in ("a", "hot"):
        values = [None if rng.random() < 0.5 else round(float(rng.random()), 4) for _ in range(200 if site == "hot" else 40)]
        per_day = 40 if site == "hot" else 2  # one site with nearly all rows
        rows += [(site, i // per_day, cover, kind, None if v is None else vec("crop_status", growth=v)) for i, v in enumerate(values)]
        want[site] = brute_force(values, 3)
    df = table(spark, rows).repartition(partitions)
    got = series.interpolate_gaps(df, 3).orderBy("phenocam_name", "date", "file").collect()
    for site in want:
        mine = [None if r.crop_status is None else round(r.crop_status[2], 9) for r in got if r.phenocam_name == site]
        assert mine == want[site]


def test_snow_and_blur_masks_count_ties_and_ignore_null(spark):
    kind, status = vec("crop_type", corn=1.0), vec("crop_status", growth=1.0)
    df = table(spark, [
        ("a", 0, vec("dominant_cover", snow=0.6, soil=0.4), kind, status),
        ("a", 1, vec("dominant_cover", snow=0.5, soil=0.5), kind, status),
        ("a", 2, vec("dominant_cover", blurry=0.5, snow=0.5), kind, status),
        ("a", 3, None, kind, status),
        ("a", 4, vec("dominant_cover", soil=1.0), kind, status),
    ])
    for snow, blur in ((series.mask_snow_daily, series.mask_blurry_daily), (series.mask_snow_days, series.mask_blurry_days)):
        snowed = snow(df).orderBy("date").collect()
        assert [r.crop_type is None for r in snowed] == [True, True, True, False, False]
        assert [r.dominant_cover is None for r in snowed] == [False, False, False, True, False]
        blurred = blur(df).orderBy("date").collect()
        assert [r.crop_status is None for r in blurred] == [False, False, True, False, False]


def test_mask_looks_at_all_images_of_the_day(spark):
    kind, status = vec("crop_type", corn=1.0), vec("crop_status", growth=1.0)
    df = table(spark, [
        ("a", 0, vec("dominant_cover", blurry=0.6, soil=0.4), kind, status),
        ("a", 0, vec("dominant_cover", blurry=0.1, soil=0.9), kind, status),
    ])
    assert all(r.crop_type is not None for r in series.mask_blurry_days(df).collect())


def test_renorm(spark):
    kind = vec("crop_type", corn=1.0)
    hole = [0.0, None, 0.5, 0.5, 0.0, 0.0, 0.0]
    df = table(spark, [
        ("a", 0, vec("dominant_cover", blurry=0.5, soil=0.2, snow=0.3), kind, vec("crop_status", blurry=1.0)),
        ("a", 1, vec("dominant_cover", soil=1.0), kind, hole),
    ])
    first, second = series.drop_blurry_renorm(df).orderBy("date").collect()
    assert first.dominant_cover == pytest.approx([0, 0, 0.4, 0.6, 0])
    assert first.crop_status is None and second.crop_status is None
    assert sum(first.crop_type) == pytest.approx(1)


@pytest.mark.parametrize("fill", [series.fill_calendar, series.fill_calendar_daily])
def test_calendar_per_site_and_leap_day(spark, fill):
    one = vec("dominant_cover", soil=1.0)
    df = table(spark, [("a", 0, one, None, None), ("a", 4, one, None, None), ("b", 1, one, None, None)])
    got = fill(df).orderBy("phenocam_name", "date").collect()
    assert [(r.phenocam_name, r.date.isoformat(), r.year, r.dominant_cover is None) for r in got] == [
        ("a", "2020-02-27", 2020, False), ("a", "2020-02-28", 2020, True), ("a", "2020-02-29", 2020, True),
        ("a", "2020-03-01", 2020, True), ("a", "2020-03-02", 2020, False), ("b", "2020-02-28", 2020, False),
    ]


def test_sequences_and_minimum_length(spark):
    df = status_series(spark, [None] + [0.5] * 61 + [None] + [0.5] * 60 + [None, 0.5])
    ids = series.sequence_ids(df, ("crop_status",)).orderBy("date").collect()
    assert [r.crop_status_seq for r in ids] == [None] + [1] * 61 + [None] + [2] * 60 + [None, 3]
    assert {(r.crop_status_seq, r.crop_status_days) for r in ids if r.crop_status_seq} == {(1, 61), (2, 60), (3, 1)}
    kept = series.min_sequence(series.sequence_ids(df, ("crop_status",))).collect()
    assert len(kept) == 61 and {r.crop_status_seq for r in kept} == {1}


def test_sequence_violations(spark):
    hole = [None, 1.0, 0.0, 0.0, 0.0, 0.0]
    df = table(spark, [("a", 0, hole, None, None), ("a", 1, vec("dominant_cover", soil=1.0), None, None)])
    got = checks.sequence_violations(df).collect()
    assert [(r.category, round(r.share_missing, 3)) for r in got] == [("dominant_cover", 0.167)]


def test_exchange_forms_round_trip(spark):
    df = status_series(spark, [0.25, None])
    assert sorted(map(str, series.from_class_columns(series.to_class_columns(df)).collect())) == sorted(map(str, df.collect()))
    back = series.long_to_wide(series.wide_to_long(df), ["phenocam_name", "date", "file"])
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))


def test_cleaning_keeps_sums_and_ignores_partitioning(spark):
    from fieldstate.sources import derived as D

    daily = series.first_image_per_day(D.observations(spark, "/root/testdata/sf0.001")).drop("file")
    frames = []
    for n in (1, 7):
        clean = series.clean_daily(daily.repartition(n)).toPandas().sort_values(["phenocam_name", "date"]).reset_index(drop=True)
        frames.append(clean)
        for c in S.CATEGORIES:
            totals = np.array([v.sum() for v in clean[c] if v is not None])
            assert np.allclose(totals, 1)
    for c in S.CATEGORIES:
        assert all((a is None and b is None) or np.array_equal(a, b) for a, b in zip(frames[0][c], frames[1][c]))


def final_plan(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan[plan.index("Final Plan") : plan.index("Initial Plan")]


@pytest.fixture(scope="module")
def stored_days(spark, tmp_path_factory):
    """Two sites with several images a day, missing days, blurry days and empty values."""
    import random
    from datetime import date, timedelta

    rng = random.Random(6)
    rows = []
    for site in "ab":
        for k in range(60):
            if rng.random() < 0.3:
                continue
            blurry = rng.random() < 0.2
            for j in range(rng.randrange(1, 4)):
                vectors = [[(0.9 if blurry else 0.1) if i == 0 else rng.random() * 0.6 + 0.2 for i in range(w)] for w in S.WIDTHS.values()]
                gone = rng.random() < 0.4
                rows.append((site, date(2020, 1, 1) + timedelta(k), f"f{k:03}_{j}", *[None if gone else v for v in vectors], rng.random()))
    schema = "phenocam_name STRING, date DATE, file STRING, dominant_cover ARRAY<DOUBLE>, crop_type ARRAY<DOUBLE>, crop_status ARRAY<DOUBLE>, more DOUBLE"
    path = str(tmp_path_factory.mktemp("days") / "t")
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


def listed(df):
    return sorted((r.phenocam_name, r.date, r.file or "", r.year, [None if v is None else [round(p, 9) for p in v] for v in (r.dominant_cover, r.crop_type, r.crop_status)], r.more or 0.0) for r in df.collect())


@pytest.mark.parametrize("gap", [2, 9])
def test_profile_equals_its_three_steps(stored_days, gap):
    steps = series.interpolate_gaps(series.mask_blurry_days(series.fill_calendar(stored_days)), gap)
    got = series.prep_profile_simple(stored_days, gap)
    assert set(got.columns) == set(steps.columns) and listed(got) == listed(steps)
    assert any(f == "" and v[0] for _, _, f, _, v, _ in listed(got)) and any(f and not v[0] for _, _, f, _, v, _ in listed(got))


@pytest.mark.parametrize("run", [lambda df: series.interpolate_gaps(df, 3), series.prep_profile_simple])
def test_gaps_scan_once_and_shuffle_three_times(spark, stored_days, run):
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = final_plan(run(stored_days))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    assert plan.count("FileScan") == 1
    assert len([x for x in plan.splitlines() if " Exchange hashpartitioning" in x and "ReusedExchange" not in x]) <= 3
    assert "ReusedExchange" in plan


def test_renormalised_keeps_null_and_zero_rules(spark):
    from fieldstate.functions import vectors as V

    rows = [([0.5, 0.1, 0.3],), ([0.5, 0.0, 0.0],), ([0.5, None, 0.3],), (None,), ([None, 1.0, 3.0],)]
    got = spark.createDataFrame(rows, "v array<double>").select(V.renormalised("v", 3, 1)).collect()
    assert [r[0] for r in got] == [[0.1 / (0.1 + 0.3), 0.3 / (0.1 + 0.3)], None, None, None, [0.25, 0.75]]
