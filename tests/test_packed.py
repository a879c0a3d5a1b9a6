"""Vectors in shuffles: packed without loss, in the same order, and once per query."""

import random
import re

import pytest

from fieldstate import schema as S
from fieldstate.operators import hmm, series
from fieldstate.plans import catalog, field_states
from fieldstate.sources import derived as D

SF = "/root/testdata/sf0.001"
VECTORS = ", ".join(f"{c} array<double>" for c in S.CATEGORIES)


def plan_of(df):
    return re.sub(r"#\d+L?", "", df._jdf.queryExecution().executedPlan().toString())


@pytest.fixture
def whole_plans(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield spark
    spark.conf.unset("spark.sql.adaptive.enabled")


def odd_rows(n, seed):
    """Rows of scores, of values beyond four digits or outside 0 to 1, of nulls, and of several lengths."""
    rng = random.Random(seed)
    odd = [None, float("nan"), float("inf"), float("-inf"), -0.5, 1.6383, 1.6384, 1.63835, 2.0, 1e300, -1e300, 5e-5, 0.00014999, 1 / 3, 0.1 + 0.2, 1e-320]

    def value():
        r = rng.random()
        return round(rng.random(), 4) if r < 0.6 else rng.choice([0.0, 1.0, 0.25]) if r < 0.8 else rng.choice(odd) if r < 0.9 else rng.random()

    def vector(width):
        r = rng.random()
        width = 0 if r < 0.1 else rng.randrange(1, width) if r > 0.9 else width
        return None if r < 0.05 else [value() if rng.random() < 0.3 else 0.25 for _ in range(width)]

    few = [[0.25], [1 / 3, 0.2], [1 / 3, 0.5], [0.25, 0.25], [0.3333], None, []]
    rows = [tuple(vector(w) for w in S.WIDTHS.values()) for _ in range(n)]
    return rows + [tuple(rng.choice(few) for _ in S.WIDTHS) for _ in range(n)]


def test_packed_vectors_come_back_in_their_order(spark):
    rows = [(i, *r) for i, r in enumerate(odd_rows(800, 1))]
    df = spark.createDataFrame(rows, f"i int, {VECTORS}")
    packed = series.packed(df)
    assert packed.columns == ["i", series.CODES, series.KEPT] and 0 < packed.filter(f"{series.KEPT} IS NULL").count() < len(rows)
    back = series.unpacked(packed).select(*df.columns)
    assert sorted(map(repr, back.collect())) == sorted(map(repr, df.collect()))
    ordered = series.unpacked(packed.orderBy(series.CODES, series.KEPT)).select(*S.CATEGORIES)
    assert list(map(repr, ordered.collect())) == list(map(repr, df.orderBy(*S.CATEGORIES).select(*S.CATEGORIES).collect()))
    for c, names in S.CLASSES.items():
        for k in (0, len(names) - 1):
            one = {r.i: r[c] for r in series.unpacked_class(packed, c, k).collect()}
            want = {r[0]: [v[k] if v is not None and k < len(v) else None] for r in rows for v in [r[1 + S.CATEGORIES.index(c)]]}
            assert repr(sorted(one.items())) == repr(sorted(want.items()))


def test_scores_of_four_digits_are_kept_as_codes_only(spark):
    rows = [(0, [k / 10000, round(1 - k / 10000, 4), 0.0, 1.0, round(k / 30000, 4), 0.5], None, [0.25] * 7) for k in range(0, 10001, 7)]
    packed = series.packed(spark.createDataFrame(rows, f"i int, {VECTORS}"))
    assert packed.filter(f"{series.KEPT} IS NOT NULL").count() == 0
    assert dict(packed.dtypes)[series.CODES] == "array<array<smallint>>"


def test_first_image_of_twins_is_the_least(spark):
    """Images of one name and day: the vectors decide, whether or not their values have four digits."""
    from pyspark.sql import functions as F

    rows = [("a", 1 + i // 6, "f.jpg", *r) for i, r in enumerate(odd_rows(120, 2))]
    df = spark.createDataFrame(rows, f"phenocam_name string, date int, file string, {VECTORS}").withColumn("date", F.date_from_unix_date("date"))
    got = series.first_image_per_day(df).collect()
    want = {}
    for r in df.orderBy(*S.CATEGORIES).collect():
        want.setdefault(r.date, r)
    assert sorted(map(repr, got)) == sorted(map(repr, want.values()))


def test_long_gaps_are_filled_from_days_dealt_once(whole_plans):
    """neither 21 rows of a day are shuffled, nor are they sorted together; every class reads one exchange of days."""
    query = catalog.QUERIES["interpolate_gaps_long"](whole_plans, SF)
    plan = plan_of(query)
    assert "hashpartitioning(phenocam_name, category, class" not in plan
    exchanges = [line for line in plan.split("\n") if "Exchange hashpartitioning(phenocam_name, " in line and "REPARTITION_BY_COL" in line]
    assert len(exchanges) == 21 and sum("ReusedExchange" not in line for line in exchanges) == 1
    long = series.wide_to_long(series.mask_blurry_daily(catalog.daily(whole_plans, SF)).drop("file"))
    want = series.interpolate_long(long, 3).selectExpr(*query.columns[:-1], "round(probability, 9) AS probability")
    assert query.columns == want.columns and sorted(map(str, query.collect())) == sorted(map(str, want.collect()))


def sent(plan, exchange):
    """Columns of the projection below each exchange of that kind."""
    return re.findall(re.escape(exchange) + r".*\n[^\n]*?Project \[(.*)\]", plan)


def test_images_and_days_are_dealt_packed(whole_plans):
    """F1 to F3, F5: images by site and day, days by site, and the panel's images by range carry codes, no vectors."""
    prepared = plan_of(catalog.prepared(whole_plans, SF))
    for exchange in ("Exchange hashpartitioning(phenocam_name, date, ", "Exchange hashpartitioning(phenocam_name, "):
        assert "AS _codes" in prepared[prepared.index(exchange):] and "CASE WHEN isnotnull(_kept" not in prepared[prepared.index(exchange):]
    panel = plan_of(catalog.QUERIES["timeseries_panel"](whole_plans, SF))
    ranged = sent(panel, "- Exchange rangepartitioning(phenocam_name")
    assert len(ranged) == 1 and "AS _codes" in ranged[0] and not re.search(r"(^|, )(dominant_cover|year)(,|$)", ranged[0])


@pytest.mark.parametrize("name", ("vote_crop_type", "unknown_rules", "vote_uniqueness_check", "final_predictions"))
def test_votes_and_states_are_dealt_after_decoding(whole_plans, name):
    """sequences are decoded where the series is cleaned; their days are dealt once, as states or votes."""
    plan = plan_of(catalog.QUERIES[name](whole_plans, SF))
    assert "Exchange hashpartitioning(phenocam_name, category, site_sequence_id" not in plan
    assert len(re.findall(r"- Exchange hashpartitioning\(phenocam_name, date, \d+\), REPARTITION_BY_COL", plan)) == 2  # images, decoded days


def test_carried_days_come_with_the_decoded_ones(spark):
    days = [(site, cat, seq, f"2020-01-{i + 1:02d}", [0.9, 0.025, 0.025, 0.025, 0.025, 0.1][: 5 + (cat != "dominant_cover")])
            for site in ("a", "b") for cat in S.CATEGORIES for seq in (1, 2) for i in range(3 * seq)]
    days += [("dead", "dominant_cover", 1, "2020-01-01", [0.0] * 5)]
    frame = spark.createDataFrame(days, "phenocam_name string, category string, site_sequence_id int, date string, probabilities array<double>")
    frame = frame.withColumn("date", frame.date.cast("date"))
    both = hmm.viterbi_decode(frame, carried=("crop_type",)).collect()
    plain = hmm.viterbi_decode(frame.filter("category <> 'crop_type'")).collect()
    assert sorted(map(str, (r[:-1] for r in both if r.hmm_class))) == sorted(map(str, map(tuple, plain)))
    votes = [(r.phenocam_name, r.category, r.site_sequence_id, str(r.date), r.probabilities) for r in both if r.hmm_class is None]
    assert sorted(votes) == sorted(d for d in days if d[1] == "crop_type")


def test_dates_of_sequences_are_named_by_their_ends(spark):
    """days that follow each other are not sent one by one; others are, and nothing is lost."""
    from pyspark.sql import functions as F

    shapes = {"run": range(70), "holes": [i for i in range(90) if i % 9], "twice": [0, 0, *range(2, 70)]}
    rows = [(site, i, [0.9, 0.02, 0.02, 0.03, 0.03]) for site, days in shapes.items() for i in days]
    days = spark.createDataFrame(rows, "phenocam_name string, i int, dominant_cover array<double>").withColumn("date", F.date_from_unix_date("i"))
    wide = days.selectExpr(
        "phenocam_name", "year(date) AS year", "date", "dominant_cover", "CAST(NULL AS ARRAY<DOUBLE>) AS crop_type", "CAST(NULL AS ARRAY<DOUBLE>) AS crop_status",
        "1 AS dominant_cover_seq", "CAST(NULL AS INT) AS crop_type_seq", "CAST(NULL AS INT) AS crop_status_seq",
    )
    final = field_states.final_table(wide)
    got = sorted((r.phenocam_name, (r.date - r.date.replace(year=1970, month=1, day=1)).days, r.dominant_cover) for r in final.collect())
    assert got == sorted((site, i, "vegetation") for site, own in shapes.items() for i in set(own))
    plan = plan_of(field_states.field_states(D.predictions(spark, SF), catalog.EXTRA))
    assert "_listed" in plan
