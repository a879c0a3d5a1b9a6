"""Every operator applied to whole tables: name -> function of (spark, table folder)."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldstate import schema as S
from fieldstate.functions import names as N
from fieldstate.functions import vectors as V
from fieldstate.operators import checks, croptype, evaluate, hmm, parsing, sampling, scoring, seasons, series, sites, training, transitions
from fieldstate.operators import islands as I
from fieldstate.plans import field_states as plan
from fieldstate.sources import derived as D
from fieldstate.sources import manifests, tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

HOST = "http://archive.example"
EXTRA = "extra_train_images"
HELD_OUT = r"(site3)|(site7)"
RARE = 150  # on the smaller tables some label combinations lie below, which they do not at the default
DAY = ("phenocam_name", "date", "file")
CLEAN = {c: names[1:] for c, names in S.CLASSES.items()}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def rounded(df: DataFrame, keys: tuple[str, ...], digits: int, classes: dict[str, tuple[str, ...]] = S.CLASSES) -> DataFrame:
    """Vectors as one rounded column per class."""
    flat = [f"round({V.element_sql(c, k)}, {digits}) AS `{c}-{n}`" for c, names in classes.items() for k, n in enumerate(names)]
    return df.selectExpr(*keys, *flat)


# ---- shared inputs -------------------------------------------------------------------------------------
def available(spark: SparkSession, d: str) -> DataFrame:
    return D.images(spark, d).filter("h % 7 <> 0").select("file")


def daily(spark: SparkSession, d: str) -> DataFrame:
    return series.first_image_per_day(D.observations(spark, d))


def prepared(spark: SparkSession, d: str) -> DataFrame:
    return series.prep_for_hmm(D.predictions(spark, d), EXTRA, deal_images=True)


def cleaned(spark: SparkSession, d: str) -> DataFrame:
    return series.clean_daily(daily(spark, d).drop("file"))


def sequences(spark: SparkSession, d: str, *categories: str) -> DataFrame:
    return series.stack_sequences(prepared(spark, d), categories or tuple(S.HMM_MODELS))


def decoded(spark: SparkSession, d: str) -> DataFrame:
    return hmm.viterbi_decode(sequences(spark, d))


def decoded_once(spark: SparkSession, d: str, rows: DataFrame | None = None) -> DataFrame:
    """:func:`decoded`, dealt by site and day: all pivots of a query read this one exchange, so decoding runs once.

    ``rows``: :func:`decoded_and_votes` of a query that also votes.
    """
    if rows is not None:
        return _of_categories(rows, tuple(S.HMM_MODELS), "hmm_class", "probabilities")
    return decoded(spark, d).select("phenocam_name", "date", "category", "hmm_class").repartition("phenocam_name", "date")


def decoded_and_votes(spark: SparkSession, d: str) -> DataFrame:
    """Decoded states and, as rows of their own, the probabilities of crop types, dealt by site and day: states and votes of a query
    read this one exchange. Sequences are decoded where the series is cleaned. What the joins infer is stated here, so that both
    uses ask for the same rows.
    """
    days = hmm.viterbi_decode(sequences(spark, d, *S.CATEGORIES), carried=("crop_type",))
    days = days.select("phenocam_name", "date", "category", "hmm_class", "probabilities")
    return days.filter("phenocam_name IS NOT NULL AND date IS NOT NULL").repartition("phenocam_name", "date")


def _of_categories(rows: DataFrame, categories: tuple[str, ...], value: str, other: str) -> DataFrame:
    """Rows of :func:`decoded_and_votes` of some categories, which have ``value`` and not ``other``. Every column is asked for, and a
    plain filter would go below the exchange, which then serves one use."""
    wanted = F.when(F.col("category").isin(*categories) & F.col(other).isNull(), F.array(value))
    return rows.select("phenocam_name", "date", "category", F.explode_outer(wanted).alias(value)).filter(f"{value} IS NOT NULL")


def final(spark: SparkSession, d: str) -> DataFrame:
    return plan.field_states(D.predictions(spark, d), EXTRA, deal_images=True)


def annotated(spark: SparkSession, d: str) -> DataFrame:
    """Annotations in training form: (filename, phenocam_name, date, labels)."""
    rows = D.annotations(spark, d)
    return rows.select(
        F.col("file").alias("filename"), N.file_site("file").alias("phenocam_name"), N.file_date("file").alias("date"), *training.LABELS
    )


def all_images(spark: SparkSession, d: str) -> DataFrame:
    extra = training.drop_annotated_extras(D.extra(spark, d), D.annotations(spark, d))
    extra = training.keep_available_extras(extra, available(spark, d))
    return training.propagate_labels(training.drop_rare_combos(annotated(spark, d)), extra)


def split(spark: SparkSession, d: str) -> DataFrame:
    # dealt by every column, so that none is pruned below: the four passes of the split read this one exchange
    images = all_images(spark, d)
    return training.holdout_split(images.repartition(*images.columns), HELD_OUT)


def truth(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.truth_table(D.annotations(spark, d), split(spark, d))


def annotated_top(spark: SparkSession, d: str) -> DataFrame:
    """Class of highest probability of the annotated images, as far as they are available."""
    images = evaluate.of_images(D.observations(spark, d), D.annotations(spark, d), "file")
    return evaluate.maxprob_class(evaluate.of_images(images, available(spark, d), "file"))


def raw_pairs(spark: SparkSession, d: str, known: DataFrame | None = None) -> DataFrame:
    top = annotated_top(spark, d)
    return evaluate.raw_eval_set(known or truth(spark, d), top).withColumnRenamed("maxprob_class", "predicted_class")


def final_pairs(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.hmm_eval_set(truth(spark, d), final(spark, d)).withColumnRenamed("hmm_class", "predicted_class")


def melted(spark: SparkSession, d: str) -> DataFrame:
    return seasons.melt_thresholds(D.transitions(spark, d))


def season_images(spark: SparkSession, d: str) -> DataFrame:
    return seasons.season_image_list(D.transitions(spark, d), D.greenness(spark, d))


def segments(spark: SparkSession, d: str, rows: DataFrame | None = None) -> DataFrame:
    return croptype.crop_segments(decoded_once(spark, d, rows))


def type_days(rows: DataFrame) -> DataFrame:
    return _of_categories(rows, ("crop_type",), "probabilities", "hmm_class")


def rounded_votes(df: DataFrame) -> DataFrame:
    return df.withColumn("total_probability", F.round("total_probability", 6))


# ---- sources, manifests --------------------------------------------------------------------------------
@query
def archive_url(spark, d):
    return manifests.image_urls(D.images(spark, d), f"{HOST}/data/archive").select("file", "url")


@query
def browse_url(spark, d):
    days = D.images(spark, d).select("phenocam_name", "date").distinct()
    return days.withColumn("url", N.browse_url(f"{HOST}/browse", "phenocam_name", "date"))


@query
def transition_file_name(spark, d):
    path = F.concat(
        F.lit("gcc/"), "phenocam_name", F.lit("_"), "roi_type", F.lit("_"), F.col("roi_id").cast("string"), F.lit("_1day.csv")
    )
    return D.rois(spark, d).select(path.alias("path")).withColumn("transition_path", N.transition_file_name("path"))


@query
def extract_links(spark, d):
    pages = D.table(spark, d, "pages").select("page_id", "url", "html")
    return manifests.extract_links(pages, HOST, path_pattern="^/[a-z]*", type_pattern="a|the")


@query
def fetch_audit(spark, d):
    files = available(spark, d).withColumnRenamed("file", "filename")
    return manifests.fetch_audit(D.extra(spark, d).select("filename", "phenocam_name", "date", "url"), files, "filename")


@query
def fetch_summary(spark, d):
    files = available(spark, d).withColumnRenamed("file", "filename")
    return manifests.fetch_summary(D.extra(spark, d), files, "filename")


# ---- parsing, sites ------------------------------------------------------------------------------------
@query
def parse_image_file(spark, d):
    return parsing.parse_image_file(D.images(spark, d).select("file"))


@query
def parse_site_date(spark, d):
    return parsing.parse_site_date(D.images(spark, d).select("file"))


@query
def parse_file_parts(spark, d):
    return parsing.parse_file_parts(D.extra(spark, d).select("url"))


@query
def hour_filter(spark, d):
    return parsing.hour_filter(D.extra(spark, d), (9, 10, 11)).select("filename", "phenocam_name", "date", "hour")


@query
def select_sites(spark, d):
    chosen = sites.select_sites(D.rois(spark, d), ("site2", "site5", "site11"))
    return chosen.select("phenocam_name", "lat", "lon", "roi_type", "roi_id", "site_years")


@query
def site_group_flag(spark, d):
    rois = D.rois(spark, d)
    return sites.site_group_flag(rois.select("phenocam_name", "roi_id"), rois.select("phenocam_name", "grp"))


@query
def site_table(spark, d):
    rois = D.rois(spark, d)
    return sites.site_table(sites.site_group_flag(rois.drop("grp"), rois.select("phenocam_name", "grp")))


# ---- seasons, sampling ---------------------------------------------------------------------------------
@query
def melt_thresholds(spark, d):
    return melted(spark, d)


@query
def densify_locf(spark, d):
    return seasons.densify_locf(melted(spark, d))


@query
def season_period(spark, d):
    return seasons.season_period(seasons.densify_locf(melted(spark, d)))


@query
def asof_season(spark, d):
    return seasons.asof_season(D.images(spark, d).select("phenocam_name", "date", "file"), melted(spark, d))


@query
def attach_midday_image(spark, d):
    days = seasons.season_period(seasons.densify_locf(melted(spark, d)))
    return seasons.attach_midday_image(days, D.greenness(spark, d))


@query
def present_runs(spark, d):
    return season_images(spark, d)


@query
def full_image_list(spark, d):
    return seasons.full_image_list(season_images(spark, d))


@query
def sample_per_group(spark, d):
    listed = seasons.full_image_list(season_images(spark, d))
    return sampling.sample_per_group(listed, ("phenocam_name", "period"), "image_filename", S.IMAGES_PER_PERIOD)


@query
def sample_distinct(spark, d):
    return sampling.sample_distinct(D.annotations(spark, d), "file", 50)


# ---- training set --------------------------------------------------------------------------------------
@query
def merge_annotations(spark, d):
    return training.merge_annotations(D.annotations(spark, d), D.redo(spark, d))


@query
def drop_annotated_extras(spark, d):
    return training.drop_annotated_extras(D.extra(spark, d), D.annotations(spark, d))


@query
def keep_available_extras(spark, d):
    return training.keep_available_extras(D.extra(spark, d), available(spark, d))


@query
def drop_rare_combos(spark, d):
    return training.drop_rare_combos(annotated(spark, d), min_n=RARE)


@query
def propagate_labels(spark, d):
    return all_images(spark, d)


@query
def holdout_split(spark, d):
    return split(spark, d).select("filename", "is_validation")


@query
def split_assertions(spark, d):
    return checks.split_assertions(split(spark, d), HELD_OUT)


@query
def balanced_weights(spark, d):
    weighted = training.balanced_weights(all_images(spark, d))
    return weighted.select("filename", *training.LABELS, F.round("sample_weight", 9).alias("sample_weight"))


@query
def resample_balanced(spark, d):
    train = split(spark, d).filter("NOT is_validation").drop("is_validation")
    return training.resample_balanced(train).select("draw", "filename", *training.LABELS)


@query
def one_hot_targets(spark, d):
    coded = training.one_hot_targets(D.annotations(spark, d))
    return coded.select("file", F.array_join(F.col("target").cast("array<string>"), ",").alias("target"))


@query
def split_targets(spark, d):
    cut = training.split_targets(training.one_hot_targets(D.annotations(spark, d)))
    return cut.select("file", *[F.array_join(F.col(f"{c}_target").cast("array<string>"), ",").alias(f"{c}_target") for c in S.WIDTHS])


@query
def crop_plan(spark, d):
    return training.crop_plan(image_sizes(spark, d), 3, 224)


@query
def crop_plan_violations(spark, d):
    return training.crop_plan_violations(image_sizes(spark, d), 224)


def image_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Images from 200 pixels of height, so that some are too small for a crop."""
    return D.images(spark, d).selectExpr("file", "CAST(200 + h % 800 AS INT) AS height", "CAST(500 + h * 7 % 800 AS INT) AS width")


# ---- scoring -------------------------------------------------------------------------------------------
def scored(spark: SparkSession, d: str) -> DataFrame:
    """A fixed linear model over the embedding vectors stands in for the trained classifier."""
    vectors = D.table(spark, d, "embeddings").selectExpr("vec_id", "CAST(embedding AS ARRAY<DOUBLE>) AS embedding")
    widths = dict(S.WIDTHS)

    def weights(size: int) -> list[np.ndarray]:
        column = np.arange(1, size + 1) * 17
        return [
            np.stack([((column + (k + len(c)) * 31) % 13 - 6) / 40 for k in range(w)]) for c, w in widths.items()
        ]

    load = scoring.linear_softmax("embedding", weights)
    return scoring.score_images(vectors, load, ["embedding"], keys=["vec_id"])


@query
def score_images(spark, d):
    return series.to_class_columns(scored(spark, d))


@query
def argmax_label(spark, d):
    return scored(spark, d).select("vec_id", *[scoring.argmax_label(c).alias(c) for c in S.CATEGORIES])


# ---- cleaning ------------------------------------------------------------------------------------------
@query
def drop_extra_and_dups(spark, d):
    return rounded(series.drop_extra_and_dups(D.predictions(spark, d), EXTRA), ("filepath", "file"), 4)


@query
def first_image_per_day(spark, d):
    return rounded(daily(spark, d), DAY, 4)


@query
def wide_to_long(spark, d):
    return series.wide_to_long(daily(spark, d))


@query
def long_to_wide(spark, d):
    return rounded(series.long_to_wide(series.wide_to_long(daily(spark, d)), list(DAY)), DAY, 4)


@query
def mask_snow_days(spark, d):
    return rounded(series.mask_snow_days(D.observations(spark, d)), DAY, 4)


@query
def mask_blurry_days(spark, d):
    return rounded(series.mask_blurry_days(D.observations(spark, d)), DAY, 4)


@query
def drop_blurry_renorm(spark, d):
    return rounded(series.drop_blurry_renorm(series.mask_blurry_daily(daily(spark, d))), DAY, 6, CLEAN)


@query
def fill_calendar(spark, d):
    full = series.fill_calendar(D.observations(spark, d))
    return rounded(full, ("phenocam_name", "date", "year", "file"), 4)


@query
def interpolate_gaps(spark, d):
    return rounded(series.interpolate_gaps(series.mask_snow_daily(daily(spark, d)), S.SNOW_GAP_ROWS), DAY[:2], 9)


@query
def interpolate_gaps_by_date(spark, d):
    return rounded(series.interpolate_daily(series.mask_snow_daily(daily(spark, d)), 5, by="date"), DAY[:2], 9)


@query
def interpolate_gaps_long(spark, d):
    # days are dealt by site as they are; every class then unfolds and sorts its own series, one row per day, from that exchange
    days = series.packed(series.mask_blurry_daily(daily(spark, d)).drop("file")).repartition("phenocam_name")
    parts = [
        series.interpolate_long(series.wide_to_long(series.unpacked_class(days, c, k), {c: (name,)}), 3)
        for c, names in S.CLASSES.items()
        for k, name in enumerate(names)
    ]
    return reduce(DataFrame.unionByName, parts).withColumn("probability", F.round("probability", 9))


@query
def sequence_ids(spark, d):
    ids = series.sequence_ids(cleaned(spark, d))
    return ids.select("phenocam_name", "date", *[f"{c}_{s}" for c in S.CATEGORIES for s in ("seq", "days")])


@query
def min_sequence(spark, d):
    kept = series.min_sequence(series.sequence_ids(cleaned(spark, d)))
    return series.stack_sequences(kept, S.CATEGORIES).select("phenocam_name", "date", "category", "site_sequence_id")


def _handover(spark: SparkSession, d: str, category: str) -> DataFrame:
    table = series.sequence_table(prepared(spark, d), category)
    return table.select(*table.columns[:5], *[F.round(n, 6).alias(n) for n in CLEAN[category]])


@query
def prep_for_hmm_cover(spark, d):
    return _handover(spark, d, "dominant_cover")


@query
def prep_for_hmm_status(spark, d):
    return _handover(spark, d, "crop_status")


@query
def prep_for_hmm_type(spark, d):
    days = prepared(spark, d).filter("crop_type_seq IS NOT NULL")
    rows = days.select("phenocam_name", "year", "date", F.col("crop_type_seq").alias("site_sequence_id"), "crop_type")
    return series.wide_to_long(rows, {"crop_type": CLEAN["crop_type"]}).withColumn("probability", F.round("probability", 6))


@query
def prep_profile_simple(spark, d):
    return rounded(series.prep_profile_simple(D.observations(spark, d)), DAY, 9)


@query
def undated_files(spark, d):
    return checks.undated_files(D.images(spark, d).selectExpr("CASE WHEN h % 10 = 0 THEN concat('thumb_', h, '.jpg') ELSE file END AS file"))


@query
def sequence_violations(spark, d):
    return checks.sequence_violations(D.observations(spark, d))


# ---- decoding ------------------------------------------------------------------------------------------
@query
def emission_logprob(spark, d):
    long = series.wide_to_long(daily(spark, d).select("phenocam_name", "date", *S.HMM_MODELS), {c: S.CLASSES[c] for c in S.HMM_MODELS})
    logs = long.withColumn("_log", hmm.emission_logprob("probability"))
    possible = F.col("_log") > float("-inf")
    return logs.select(
        "phenocam_name", "date", "category", "class", possible.alias("possible"),
        F.when(possible, F.round("_log", 6)).alias("logprob"),
    )


@query
def viterbi_decode(spark, d):
    return decoded(spark, d)


@query
def viterbi_decode_long(spark, d):
    return hmm.viterbi_decode_long(sequences(spark, d), chunk=128)


@query
def hmm_failures(spark, d):
    """Days without any possible state, in every tenth site, make their sequences undecodable."""
    dead = F.col("phenocam_name").endswith("3") & (F.dayofmonth("date") == 15)
    none = F.transform("probabilities", lambda p: F.lit(0.0))
    return hmm.hmm_failures(sequences(spark, d).withColumn("probabilities", F.when(dead, none).otherwise(F.col("probabilities"))))


@query
def hmm_output(spark, d):
    ready = prepared(spark, d)
    cover, status = (hmm.viterbi_decode(series.stack_sequences(ready, (c,))) for c in S.HMM_MODELS)
    return hmm.hmm_output(cover, status)


# ---- crop types, final table, transitions --------------------------------------------------------------
@query
def crop_segments(spark, d):
    return segments(spark, d)


@query
def vote_crop_type(spark, d):
    rows = decoded_and_votes(spark, d)
    return rounded_votes(croptype.vote_crop_type(type_days(rows), segments(spark, d, rows)))


@query
def segment_mode_status(spark, d):
    return croptype.segment_mode_status(segments(spark, d))


@query
def unknown_rules(spark, d):
    rows = decoded_and_votes(spark, d)
    found = segments(spark, d, rows)
    return rounded_votes(croptype.unknown_rules(croptype.vote_crop_type(type_days(rows), found), croptype.segment_mode_status(found)))


@query
def vote_uniqueness_check(spark, d):
    rows = decoded_and_votes(spark, d)
    return croptype.vote_uniqueness_check(type_days(rows), segments(spark, d, rows))


@query
def final_predictions(spark, d):
    rows = decoded_and_votes(spark, d)
    states = decoded_once(spark, d, rows)
    found = croptype.crop_segments(states)
    votes = croptype.unknown_rules(croptype.vote_crop_type(type_days(rows), found), croptype.segment_mode_status(found))
    return croptype.final_predictions(states, found, votes)


@query
def field_states(spark, d):
    return final(spark, d)


@query
def state_transitions(spark, d):
    return transitions.state_transitions(final(spark, d))


@query
def state_transitions_maxprob(spark, d):
    top = [V.class_name(c, V.first_top_code_sql(c)).alias(c) for c in S.CATEGORIES]
    return transitions.state_transitions(daily(spark, d).select("phenocam_name", "date", *top))


@query
def mean_change(spark, d):
    window = I.ordered(["phenocam_name"], ["date"])
    cover = daily(spark, d).select("phenocam_name", "date", V.element("dominant_cover", 1).alias("veg"))
    return cover.select("phenocam_name", "date", F.round(transitions.mean_change("veg", window, 9), 6).alias("vegetation_change"))


@query
def harvest_detect(spark, d):
    return transitions.harvest_detect(daily(spark, d)).select("phenocam_name", "date", "transition_harvest")


@query
def publish_join(spark, d):
    return sites.publish_join(final(spark, d), D.rois(spark, d))


# ---- evaluation ----------------------------------------------------------------------------------------
@query
def maxprob_class(spark, d):
    return evaluate.maxprob_class(D.observations(spark, d))


@query
def maxprob_first(spark, d):
    return evaluate.maxprob_first(D.observations(spark, d))


@query
def truth_table(spark, d):
    return truth(spark, d)


@query
def split_counts(spark, d):
    return evaluate.split_counts(split(spark, d), ("site3", "site7"))


@query
def truth_counts(spark, d):
    return evaluate.truth_counts(truth(spark, d), ("site3", "site7"))


@query
def sample_sizes(spark, d):
    return evaluate.sample_sizes(truth(spark, d))


@query
def coverage_check_raw(spark, d):
    top = annotated_top(spark, d).withColumnRenamed("file", "filename")
    covered = evaluate.coverage_check(truth(spark, d), top, ("filename", "category"), "maxprob_class")
    return covered.select(F.round("percent", 9).alias("percent"), "num")


@query
def coverage_check_final(spark, d):
    covered = evaluate.coverage_check(
        truth(spark, d), evaluate.final_long(evaluate.of_days(final(spark, d), annotated(spark, d))),
        ("phenocam_name", "date", "category"), "hmm_class",
    )
    return covered.select(F.round("percent", 9).alias("percent"), "num")


@query
def hmm_eval_set(spark, d):
    return evaluate.hmm_eval_set(truth(spark, d), final(spark, d))


def _rounded_metrics(metrics: DataFrame) -> DataFrame:
    return metrics.withColumn("estimate", F.round("estimate", 4))


@query
def class_metrics_raw(spark, d):
    return _rounded_metrics(evaluate.class_metrics(raw_pairs(spark, d), terms=evaluate.METRICS))


@query
def class_metrics_final(spark, d):
    return _rounded_metrics(evaluate.class_metrics(final_pairs(spark, d)))


@query
def overall_metrics(spark, d):
    known = truth(spark, d)
    return _rounded_metrics(evaluate.overall_metrics(evaluate.class_metrics(raw_pairs(spark, d, known)), evaluate.sample_sizes(known)))


@query
def overall_metrics_final(spark, d):
    known = truth(spark, d)
    return _rounded_metrics(evaluate.overall_metrics(evaluate.class_metrics(final_pairs(spark, d)), evaluate.sample_sizes(known)))


@query
def report_labels_raw(spark, d):
    known = truth(spark, d)
    return evaluate.report_labels(evaluate.class_metrics(raw_pairs(spark, d, known)), evaluate.sample_sizes(known))


@query
def report_labels_final(spark, d):
    return evaluate.report_labels(evaluate.class_metrics(final_pairs(spark, d)), evaluate.sample_sizes(truth(spark, d)))


@query
def confusion_matrix_raw(spark, d):
    return evaluate.confusion_matrix(raw_pairs(spark, d))


@query
def confusion_matrix_final(spark, d):
    return evaluate.confusion_matrix(final_pairs(spark, d))


@query
def metric_labels(spark, d):
    known = truth(spark, d)
    sized = evaluate.with_sample_sizes(evaluate.class_metrics(raw_pairs(spark, d, known)), evaluate.sample_sizes(known))
    return evaluate.metric_labels(sized)


@query
def class_rank_label(spark, d):
    return evaluate.class_rank_label(evaluate.sample_sizes(truth(spark, d)))


@query
def timeseries_panel(spark, d):
    return evaluate.timeseries_panel(D.observations(spark, d), final(spark, d))


@query
def timeseries_panel_year(spark, d):
    """The cover of one year, from a panel stored by category and year."""
    path = f"{tables.shared_folder(spark)}/panel-{uuid.uuid4().hex}"
    evaluate.store_panel(evaluate.timeseries_panel(D.observations(spark, d), final(spark, d)), path)
    return evaluate.read_panel(spark, path, year=2019, category="dominant_cover")


@query
def site_years(spark, d):
    return evaluate.site_years(D.observations(spark, d))


@query
def image_diagnostic(spark, d):
    return evaluate.image_diagnostic(D.observations(spark, d), truth(spark, d))


@query
def greenness_vs_status(spark, d):
    return evaluate.greenness_vs_status(D.greenness(spark, d), final(spark, d))
