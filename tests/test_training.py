"""Labels, splits, sampling, evaluation."""

from collections import Counter
from datetime import date
from re import search as re_search

import numpy as np
import pytest

from fieldstate.functions import keys as K
from fieldstate.operators import checks, evaluate, sampling, seasons, training
from pyspark.sql import functions as F


def test_merge_annotations_rules(spark):
    session = spark.createDataFrame(
        [("a", 2, 3, 1, 9), ("b", 0, 3, 0, 9), ("c", 6, 3, 2, 9), ("d", None, 6, 2, 9), ("e", 2, 3, 1, 9), ("f", 2, 3, 1, 9), ("g", 0, 6, 1, 9)],
        "file STRING, crop_status INT, crop_type INT, dominant_cover INT, time INT",
    )
    redo = spark.createDataFrame([("a", 7, 1), ("b", 7, 1), ("c", 2, 1), ("d", 0, 1), ("e", 4, 1), ("g", 0, 1)], "file STRING, crop_type INT, time INT")
    got = {r.file: r.crop_type for r in training.merge_annotations(session, redo).collect()}
    assert got == {"a": 1, "b": 0, "c": 7, "d": 7, "e": 4, "f": None, "g": 0}


def labelled(spark, n, sites=10):
    return spark.range(n).select(
        F.concat(F.lit("site"), (F.col("id") % sites).cast("string"), F.lit("_x_"), "id").alias("filename"),
        F.concat(F.lit("site"), (F.col("id") % sites).cast("string")).alias("phenocam_name"), F.lit(date(2020, 1, 1)).alias("date"),
        F.when(F.col("id") % 3 == 0, 1).otherwise(2).alias("dominant_cover"), (F.col("id") % 2).cast("int").alias("crop_type"),
        F.when(F.col("id") % 50 == 0, F.lit(None)).otherwise(1).cast("int").alias("crop_status"),
    )


@pytest.mark.parametrize("n", [997, 40])
def test_split_has_exact_size_and_is_reproducible(spark, n):
    df = labelled(spark, n, sites=40)
    first = {r.filename: r.is_validation for r in training.holdout_split(df, "(site3)").collect()}
    again = {r.filename: r.is_validation for r in training.holdout_split(df.repartition(7), "(site3)").collect()}
    held = {f for f in first if f.startswith("site3")}  # substring match: site3 and site30..site39
    assert first == again and len(first) == n
    assert all(first[f] for f in held)
    assert sum(first.values()) == max(int(n * 0.2), len(held))


def test_split_assertions(spark):
    split = spark.createDataFrame([("site3_a", False), ("b_a", False), ("b_a", False), ("c_a", True)], "filename STRING, is_validation BOOLEAN")
    got = {r.rule: r.violations for r in checks.split_assertions(split, "site3").collect()}
    assert got == {"holdout_site_in_train": 1, "duplicates_in_train": 1, "duplicates_in_validation": 0}


@pytest.mark.parametrize("n", [0, 1, 500, 999, 1000, 2000])
def test_take_exactly_any_size(spark, n):
    df = spark.range(1000).select(F.col("id").cast("string").alias("x"))
    got = sampling.take_exactly(df, F.lit(n), K.sample_key("x", 1), ["x"], "hit").collect()
    assert len(got) == 1000 and sum(r.hit for r in got) == min(n, 1000)
    order = sorted(got, key=lambda r: (__import__("hashlib").md5(f"1|{r.x}".encode()).hexdigest(), r.x))
    assert all(r.hit for r in order[:n]) and not any(r.hit for r in order[n:])


def test_split_of_images_listed_twice(spark):
    df = labelled(spark, 60).union(labelled(spark, 60))
    rows = training.holdout_split(df, "(site3)")
    assert rows.columns == [*df.columns, "is_validation"]
    got = Counter((r.filename, r.is_validation) for r in rows.collect())
    assert sum(got.values()) == 120 and sum(n for (_, v), n in got.items() if v) == 24
    assert all(got[f, True] == 2 for f, _ in got if f.startswith("site3"))


def test_resample_with_one_combination_of_nearly_all_rows(spark):
    hot = F.when(F.col("id") % 100 == 0, 1).otherwise(2)
    df = labelled(spark, 2000).withColumn("id", F.regexp_extract("filename", r"(\d+)$", 1).cast("long"))
    df = df.withColumns({"dominant_cover": hot, "crop_type": F.lit(1), "crop_status": F.lit(1)}).drop("id")
    df = df.union(df.filter("dominant_cover = 1"))  # files listed twice count twice
    got = Counter(r.dominant_cover for r in training.resample_balanced(df, n=4000).collect())
    assert sum(got.values()) == 4000 and abs(got[1] - 2000) < 5 * np.sqrt(2000)


def test_resample_draws_combinations_evenly(spark):
    df = labelled(spark, 600)
    got = training.resample_balanced(df, n=6000).select("draw", *training.LABELS).collect()
    assert sorted(r.draw for r in got) == list(range(6000))
    counts = Counter((r.dominant_cover, r.crop_type, r.crop_status) for r in got)
    combos = df.select(*training.LABELS).distinct().count()
    assert len(counts) == combos
    assert all(abs(c - 6000 / combos) < 5 * np.sqrt(6000 / combos) for c in counts.values())


def test_weights_and_rare_combos_with_null_labels(spark):
    df = labelled(spark, 600)
    weighted = training.balanced_weights(df).collect()
    assert len(weighted) == 600 and sum(r.sample_weight for r in weighted) == pytest.approx(600)
    sizes = Counter((r.dominant_cover, r.crop_type, r.crop_status) for r in df.collect())
    kept = training.drop_rare_combos(df, min_n=10).count()
    assert kept == sum(n for n in sizes.values() if n >= 10) < 600


def test_targets_round_trip(spark):
    df = spark.createDataFrame([(1, 7, 0)], "dominant_cover INT, crop_type INT, crop_status INT")
    row = training.split_targets(training.one_hot_targets(df)).collect()[0]
    assert len(row.target) == 21 and sum(row.target) == 3
    assert row.dominant_cover_target[1] == row.crop_type_target[7] == row.crop_status_target[0] == 1


def test_crop_plan_relaxes_the_cutoff_and_rejects_large_crops(spark):
    meta = spark.createDataFrame([("tall", 1000, 500), ("low", 300, 500), ("same", 224, 500)], "file STRING, height INT, width INT")
    got = training.crop_plan(meta, 40, 224).collect()
    boxes = {f: [(r.y0, r.x0) for r in got if r.file == f] for f in ("tall", "low", "same")}
    assert len(boxes["tall"]) == len(boxes["low"]) == 40 and not boxes["same"]
    assert all(500 < y < 1000 - 224 and 1 <= x < 500 - 224 for y, x in boxes["tall"])
    assert all(60 - 1 < y < 300 - 224 for y, x in boxes["low"])  # relaxed from 150 to 60 rows cut
    assert [r.file for r in training.crop_plan_violations(meta, 224).collect()] == ["same"]


def test_propagate_labels_fans_out_and_drops_unlabelled(spark):
    cols = "filename STRING, phenocam_name STRING, date DATE, dominant_cover INT, crop_type INT, crop_status INT"
    d = date(2020, 1, 1)
    annotated = spark.createDataFrame([("p", "a", d, 1, 2, 3), ("q", "a", d, 4, 5, 6), ("r", "b", d, None, 1, 1)], cols)
    extra = spark.createDataFrame([("x", "a", d), ("y", "b", d), ("z", "c", d)], "filename STRING, phenocam_name STRING, date DATE")
    got = Counter(r.filename for r in training.propagate_labels(annotated, extra).collect())
    assert got == {"p": 1, "q": 1, "r": 1, "x": 2}


def test_group_sample_is_bounded_per_group(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("f"), F.when(F.col("id") < 900, "hot").otherwise("cold").alias("g"))
    got = Counter(r.g for r in sampling.sample_per_group(df, ("g",), "f", 150).collect())
    assert got == {"hot": 150, "cold": 100}


def test_seasons_carry_forward_and_keep_shared_dates(spark):
    rows = [("a", "rising", "transition_10", date(2020, 1, 1)), ("a", "rising", "transition_25", date(2020, 1, 4)), ("a", "rising", "transition_50", date(2020, 1, 4))]
    df = spark.createDataFrame(rows, "phenocam_name STRING, direction STRING, threshold STRING, date DATE")
    got = seasons.season_period(seasons.densify_locf(df)).orderBy("date", "threshold").collect()
    assert [(r.date.day, r.period, r.original_transition_date) for r in got] == [
        (1, "growing", True), (2, "growing", None), (3, "growing", None), (4, "growing", True), (4, "peak", True),
    ]
    images = spark.createDataFrame([("a", date(2020, 1, 3)), ("a", date(2020, 1, 4)), ("a", date(2020, 1, 9))], "phenocam_name STRING, date DATE")
    assert [r.period for r in seasons.asof_season(images, df).orderBy("date").collect()] == ["growing", "peak", None]


def test_present_runs_tally(spark):
    rows = [("a", date(2020, 1, i + 1), "t", "d", f) for i, f in enumerate(["x", "x", None, "x", None, None])]
    df = spark.createDataFrame(rows, "phenocam_name STRING, date DATE, threshold STRING, direction STRING, image_filename STRING")
    got = seasons.present_runs(df).orderBy("date").collect()
    assert [r.running_tally for r in got] == [1, 2, 0, 1, 0, 0]
    assert [r.site_seq_id for r in got] == [1, 1, None, 2, None, None]


def test_metrics_with_classes_missing_on_one_side(spark):
    pairs = [("c", "val", "x", "x")] * 3 + [("c", "val", "x", "y")] + [("c", "val", "z", "x")] + [("c", "val", "x", None)]
    df = spark.createDataFrame(pairs, "category STRING, data_type STRING, true_class STRING, predicted_class STRING")
    metrics = evaluate.class_metrics(df, terms=evaluate.METRICS)
    got = {(r["class"], r.term): r.estimate for r in metrics.collect()}
    assert got["x", "precision"] == pytest.approx(3 / 4) and got["x", "recall"] == pytest.approx(3 / 4)
    assert got["z", "precision"] is None and got["z", "recall"] == 0 and got["y", "recall"] is None and got["z", "f1"] is None
    assert got["x", "prevalence"] == pytest.approx(4 / 5) and got["x", "specificity"] == 0
    sizes = spark.createDataFrame([("c", "x", "val", 4), ("c", "z", "val", 1)], "category STRING, class STRING, data_type STRING, sample_size BIGINT")
    overall = {r.term: r.estimate for r in evaluate.overall_metrics(metrics.filter("class <> 'y'"), sizes).collect()}
    assert overall["recall"] == pytest.approx(0.6) and overall["precision"] is None
    cells = {(r.true_class, r.predicted_class): r.n for r in evaluate.confusion_matrix(df).collect()}
    # a missing prediction is a level of the matrix and no part of the metrics
    assert cells == {("x", "x"): 3, ("x", "y"): 1, ("x", None): 1, ("z", "x"): 1, ("z", "y"): 0, ("z", None): 0}


def test_images_without_prediction_stay_in_the_evaluation(spark):
    truth = spark.createDataFrame(
        [("a", "f1", 2020, date(2020, 1, 1), "crop_type", "val", "corn"), ("a", "f2", 2020, date(2020, 1, 2), "crop_type", "val", "corn")],
        "phenocam_name STRING, filename STRING, year INT, date DATE, category STRING, data_type STRING, true_class STRING")
    top = spark.createDataFrame([("f1", "crop_type", "corn"), ("f3", "crop_type", "corn")], "file STRING, category STRING, maxprob_class STRING")
    pairs = evaluate.raw_eval_set(truth, top)
    assert {(r.filename, r.maxprob_class) for r in pairs.collect()} == {("f1", "corn"), ("f2", None)}
    assert [r.n_images for r in evaluate.truth_counts(truth, ("a",)).collect()] == [2]


def test_undated_names_are_listed(spark):
    df = spark.createDataFrame([("site1_2020_01_02_120000.jpg",), ("thumb_7.jpg",), ("site1_2020_13_02_120000.jpg",)], "file STRING")
    assert "thumb_7.jpg" in [r.file for r in checks.undated_files(df).collect()]
    assert "site1_2020_01_02_120000.jpg" not in [r.file for r in checks.undated_files(df).collect()]


def test_maxprob_keeps_ties_and_first_takes_lowest_code(spark):
    rows = [("a", "f", date(2020, 1, 1), [0.0, 0.5, 0.0, 0.5, 0.0, 0.0], [1.0] + [0.0] * 7, [0.0] * 6 + [1.0])]
    df = spark.createDataFrame(rows, "phenocam_name STRING, file STRING, date DATE, dominant_cover ARRAY<DOUBLE>, crop_type ARRAY<DOUBLE>, crop_status ARRAY<DOUBLE>")
    got = sorted((r.category, r.maxprob_class) for r in evaluate.maxprob_class(df).collect())
    assert got == [("crop_status", "no_crop"), ("crop_type", "blurry"), ("dominant_cover", "soil"), ("dominant_cover", "vegetation")]
    assert ("dominant_cover", "vegetation") in [(r.category, r.maxprob_class) for r in evaluate.maxprob_first(df).collect()]
    assert evaluate.maxprob_first(df).count() == 3


def test_take_exactly_splits_copies_and_contents(spark):
    """Half of all rows are one image: the cut falls among its copies, and among rows that differ in other columns only."""
    rows = [("hot", k % 2) for k in range(500)] + [(f"r{k}", 0) for k in range(500)]
    df = spark.createDataFrame(rows, "x STRING, y INT").repartition(5)
    hash_of = lambda x: __import__("hashlib").md5(f"1|{x}".encode()).hexdigest()
    below = sum(hash_of(x) < hash_of("hot") for x, _ in rows)
    n = below + 333
    got = sampling.take_exactly(df, F.lit(n), K.sample_key("x", 1), ["x"], "hit").collect()
    assert Counter((r.x, r.y) for r in got) == Counter(rows) and sum(r.hit for r in got) == n
    assert Counter((r.y, r.hit) for r in got if r.x == "hot") == {(0, True): 250, (1, True): 83, (1, False): 167}
    assert all(r.hit == (hash_of(r.x) < hash_of("hot")) for r in got if r.x != "hot")


@pytest.mark.parametrize("keys", ["equal", "shared_prefix"])
def test_take_exactly_when_keys_share_their_digits(spark, keys):
    df = spark.range(300).select(F.col("id").cast("string").alias("x"))
    key = F.lit("ab" * 16) if keys == "equal" else F.concat(F.lit("0123456789abcdef" * 1), F.lpad("x", 16, "0"))
    got = sampling.take_exactly(df, F.floor(F.col("all_rows") * 0.5), key, ["x"], "hit").collect()
    order = sorted(got, key=lambda r: r.x if keys == "equal" else r.x.zfill(16))
    assert [r.hit for r in order] == [True] * 150 + [False] * 150


def test_plans_of_split_and_resampling(spark, tmp_path):
    """No job while a plan is built, no stored copy; resampling scans and shuffles its input once."""
    import re

    labelled(spark, 3000).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    spark.sparkContext.setJobGroup("plans", "plans")
    split = training.holdout_split(df, "(site3)")
    drawn = training.resample_balanced(df, n=500)
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("plans")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    drawn.collect()
    plan = drawn._jdf.queryExecution().executedPlan().toString()
    final = plan[plan.index("Final Plan") : plan.index("Initial Plan")]
    assert len(re.findall(r"FileScan parquet", final)) == 1 and "ReusedExchange" in final
    windows = re.findall(r"windowspecdefinition\(([^)]*)\)", final)
    assert windows and not any("dominant_cover" in w.split(" ASC")[0] for w in windows)
    main = split._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" not in main and not re.search(r"Join Cross|Checkpoint|LogicalRDD", main)


def test_take_exactly_refines_in_several_steps(spark):
    df = spark.range(5000).select(F.col("id").cast("string").alias("x"))
    flags = [
        sorted(tuple(r) for r in sampling.take_exactly(df, F.lit(1777), K.sample_key("x", 1), ["x"], "hit", digits=d).collect())
        for d in ((5,), (1,), (1, 2, 3), (4, 8))
    ]
    assert sum(h for _, h in flags[0]) == 1777 and all(f == flags[0] for f in flags)


def test_final_class_of_truth_by_category(spark):
    """Rows meet by site and day, each category takes its own class; NULL and unknown classes and other days give none."""
    d, e = date(2020, 1, 1), date(2020, 1, 2)
    truth = spark.createDataFrame(
        [("a", f, 2020, day, c, "val", t) for f, day in (("f", d), ("f", d), ("g", e), ("h", None)) for c, t in (
            ("dominant_cover", "soil"), ("crop_type", "corn"), ("crop_status", "blurry"), (None, "soil"), ("dominant_cover", None))],
        "phenocam_name STRING, filename STRING, year INT, date DATE, category STRING, data_type STRING, true_class STRING",
    )
    final = spark.createDataFrame(
        [("a", 2020, d, "soil", "growth", "unknown_plant"), ("a", 2020, e, None, "growth", "corn"), ("a", 2020, e, "snow", None, None),
         ("b", 2020, d, "soil", "growth", "corn"), ("a", 2020, None, "soil", "growth", "corn"), (None, 2020, d, "soil", "growth", "corn")],
        "phenocam_name STRING, year INT, date DATE, dominant_cover STRING, crop_status STRING, crop_type STRING",
    )
    out = evaluate.hmm_eval_set(truth, final)
    assert out.columns == [*truth.columns, "hmm_class"]
    got = Counter((r.filename, r.category, r.true_class, r.hmm_class) for r in out.collect())
    assert got == {("f", "dominant_cover", "soil", "soil"): 2, ("g", "dominant_cover", "soil", "snow"): 1, ("g", "crop_type", "corn", "corn"): 1}
    # the days of listed images, with all their rows, and nothing for missing keys
    days = evaluate.of_days(final, truth)
    assert days.columns == final.columns and Counter(map(tuple, days.collect())) == Counter(
        tuple(r) for r in final.collect() if r.phenocam_name == "a" and r.date is not None)
    covered = lambda f: evaluate.coverage_check(truth, evaluate.final_long(f), ("phenocam_name", "date", "category"), "hmm_class").collect()
    assert covered(days) == covered(final)


def test_split_of_a_shuffled_table_with_null_and_equal_names(spark):
    """The exchange that the passes of the split share changes nothing, with names that are NULL or stand often."""
    rows = labelled(spark, 200).union(labelled(spark, 30)).withColumn("filename", F.expr("CASE WHEN dominant_cover = 1 AND crop_type = 1 THEN NULL ELSE filename END"))
    for regex in ("(site3)", "(nowhere)", "site"):
        want = Counter((r.filename, r.phenocam_name, r.is_validation) for r in training.holdout_split(rows, regex).collect())
        dealt = training.holdout_split(rows.repartition(*rows.columns), regex).collect()
        got = Counter((r.filename, r.phenocam_name, r.is_validation) for r in dealt)
        assert got == want and len(dealt) == 230
        held = sum(1 for r in dealt if re_search(regex, r.phenocam_name))
        assert sum(r.is_validation for r in dealt) == max(46, held)
