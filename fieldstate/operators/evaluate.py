"""Evaluation of predictions against annotations, and the tables behind the reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldstate import schema as S
from fieldstate.functions import names as N
from fieldstate.functions import vectors as V
from fieldstate.operators.series import long_rows_sql, packed, unpacked
from fieldstate.sources.tables import read_table, write_table

IMAGE = ("phenocam_name", "file", "date")
METRICS = (
    "sensitivity", "specificity", "pos_pred_value", "neg_pred_value", "precision", "recall", "f1", "prevalence",
    "detection_rate", "detection_prevalence", "balanced_accuracy",
)


def of_images(obs: DataFrame, files: DataFrame, name: str = "filename") -> DataFrame:
    """Rows of the listed images only. Applied before any mean, so that few annotated images cost few rows."""
    return obs.join(files.select(F.col(name).alias("file")).distinct(), "file", "left_semi").select(*obs.columns)


def of_days(final: DataFrame, images: DataFrame) -> DataFrame:
    """Days of the listed images only. Applied before days are unfolded by category, so that few annotated days cost few rows."""
    day = ["phenocam_name", "date"]
    return final.join(images.select(*day).distinct(), day, "left_semi").select(*final.columns)


# ---- class of highest probability ----------------------------------------------------------------------
def image_means(obs: DataFrame, keys: tuple[str, ...] = IMAGE) -> DataFrame:
    """Mean vector per image; rows of one image are united by partial aggregation."""
    means = [F.expr(f"avg({V.element_sql(c, k)}) AS {c}_{k}") for c, w in S.WIDTHS.items() for k in range(w)]
    vectors = [f"array({', '.join(f'{c}_{k}' for k in range(w))}) AS {c}" for c, w in S.WIDTHS.items()]
    return obs.groupBy(*keys).agg(*means).selectExpr(*keys, *vectors)


def maxprob_class(obs: DataFrame, keys: tuple[str, ...] = IMAGE) -> DataFrame:
    """(…, category, maxprob_class): every class that shares the highest mean probability of its category."""
    tops = ", ".join(
        f"CASE WHEN {V.element_sql(c, k)} = greatest({', '.join(V.elements_sql(c, w))}) "
        f"THEN named_struct('category', '{c}', 'maxprob_class', {V.quoted(S.CLASSES[c][k])}) END"
        for c, w in S.WIDTHS.items()
        for k in range(w)
    )
    return image_means(obs, keys).selectExpr(*keys, f"inline(array_compact(array({tops})))")


def maxprob_first(obs: DataFrame, keys: tuple[str, ...] = IMAGE) -> DataFrame:
    """As :func:`maxprob_class`, one class per category: the lowest class code on a tie."""
    tops = ", ".join(
        f"named_struct('category', '{c}', 'maxprob_class', {V.name_sql(S.CLASSES[c], V.first_top_code_sql(c))})"
        for c in S.CATEGORIES
    )
    return image_means(obs, keys).selectExpr(*keys, f"inline(array({tops}))").filter("maxprob_class IS NOT NULL")


# ---- truth ---------------------------------------------------------------------------------------------
def truth_table(annotations: DataFrame, split: DataFrame) -> DataFrame:
    """(phenocam_name, filename, year, date, category, data_type, true_class) of all annotated images in the split."""
    kind = split.select("filename", F.when(F.col("is_validation"), "val").otherwise("train").alias("data_type"))
    images = (
        annotations.select(F.col("file").alias("filename"), *S.CATEGORIES).join(kind, "filename").distinct()
    )
    labels = F.array(
        *[F.struct(F.lit(c).alias("category"), V.class_name(c, c).alias("true_class")) for c in S.CATEGORIES]
    )
    date = N.file_date("filename")
    return images.select(
        N.file_site("filename").alias("phenocam_name"), "filename", F.year(date).alias("year"), date.alias("date"),
        "data_type", F.inline(labels),
    ).select("phenocam_name", "filename", "year", "date", "category", "data_type", "true_class")


def split_counts(split: DataFrame, sites: tuple[str, ...]) -> DataFrame:
    """(data_type, is_validation_site, n, n_files) of a split; site names are compared whole."""
    return (
        split.groupBy(
            F.when(F.col("is_validation"), "val").otherwise("train").alias("data_type"),
            F.substring_index("filename", "_", 1).isin(*sites).alias("is_validation_site"),
            "filename",
        )
        .agg(F.count("*").alias("rows"))
        .groupBy("data_type", "is_validation_site")
        .agg(F.sum("rows").alias("n"), F.count("*").alias("n_files"))
    )


def truth_counts(truth: DataFrame, sites: tuple[str, ...]) -> DataFrame:
    """(data_type, is_validation_site, n_images): distinct annotated images; site names are compared whole."""
    images = truth.select("filename", "phenocam_name", "data_type").distinct()
    return images.groupBy("data_type", F.col("phenocam_name").isin(*sites).alias("is_validation_site")).agg(F.count("*").alias("n_images"))


def sample_sizes(truth: DataFrame) -> DataFrame:
    return truth.groupBy("category", F.col("true_class").alias("class"), "data_type").agg(F.count("*").alias("sample_size"))


def coverage_check(truth: DataFrame, pred: DataFrame, on: tuple[str, ...], value: str, image: str = "filename") -> DataFrame:
    """(percent, num): share and number of images with a prediction for each of their categories."""
    joined = truth.join(pred.select(*on, value), list(on), "left")
    complete = joined.groupBy(image).agg(F.bool_and(F.col(value).isNotNull()).alias("complete"))
    return complete.agg(F.avg(F.col("complete").cast("int")).alias("percent"), F.count_if("complete").alias("num"))


def final_long(final: DataFrame) -> DataFrame:
    """(phenocam_name, year, date, category, hmm_class) rows of the final daily table."""
    values = F.array(*[F.struct(F.lit(c).alias("category"), F.col(c).alias("hmm_class")) for c in S.CATEGORIES])
    return final.select("phenocam_name", "year", "date", F.inline(values))


def hmm_eval_set(truth: DataFrame, final: DataFrame) -> DataFrame:
    """Truth with the final class; blurry and unknown plants are left out, as are images without a final class.

    Days meet as they are, one row each, and the category picks its class afterwards: all days are shuffled, few are annotated.
    """
    wanted = truth.filter(~F.col("true_class").isin("blurry", "unknown_plant"))
    days = final.select("phenocam_name", "date", *[F.col(c).alias(f"_{c}") for c in S.CATEGORIES])
    own = "CASE category " + " ".join(f"WHEN '{c}' THEN _{c}" for c in S.CATEGORIES) + " END"
    predicted = wanted.join(days, ["phenocam_name", "date"]).withColumn("hmm_class", F.expr(own))
    return predicted.filter(F.col("hmm_class") != "unknown_plant").select(*truth.columns, "hmm_class")


def raw_eval_set(truth: DataFrame, maxprob: DataFrame) -> DataFrame:
    """Truth with the class of highest probability, per image and category; NULL for images without a prediction."""
    predicted = maxprob.select(F.col("file").alias("filename"), "category", "maxprob_class")
    return truth.join(predicted, ["filename", "category"], "left").select(*truth.columns, "maxprob_class")


# ---- metrics -------------------------------------------------------------------------------------------
def confusion_counts(pairs: DataFrame, keys: tuple[str, ...], known: str = "true_class IS NOT NULL AND predicted_class IS NOT NULL") -> DataFrame:
    """Counts per (keys, true_class, predicted_class): partial aggregation, at most classes x classes rows per key."""
    return pairs.filter(known).groupBy(*keys, "true_class", "predicted_class").agg(F.count("*").alias("n"))


def class_metrics(
    pairs: DataFrame, keys: tuple[str, ...] = ("category", "data_type"), terms: tuple[str, ...] = ("precision", "recall", "f1")
) -> DataFrame:
    """One-vs-rest metrics (…, class, term, estimate) from (…, true_class, predicted_class) pairs.

    Every confusion cell adds to the marginals of its true and of its predicted class, so one more small
    aggregation gives all counts. A metric with a zero denominator is NULL.
    """
    cell = confusion_counts(pairs, keys)
    hit = F.when(F.col("true_class") == F.col("predicted_class"), F.col("n")).otherwise(0)
    none = F.lit(0).cast("bigint")
    sides = F.array(
        F.struct(F.col("true_class").alias("class"), F.col("n").alias("t"), none.alias("p"), hit.alias("tp")),
        F.struct(F.col("predicted_class").alias("class"), none.alias("t"), F.col("n").alias("p"), none.alias("tp")),
    )
    marginal = cell.select(*keys, F.inline(sides)).groupBy(*keys, "class").agg(
        F.sum("t").alias("t"), F.sum("p").alias("p"), F.sum("tp").alias("tp")
    )
    counted = marginal.withColumn("all", F.sum("t").over(Window.partitionBy(*keys)))
    t, p, tp, every = (F.col(c) for c in ("t", "p", "tp", "all"))
    tn = every - t - p + tp
    recall, precision = F.try_divide(tp, t), F.try_divide(tp, p)
    specificity = F.try_divide(tn, every - t)
    values = {
        "sensitivity": recall,
        "specificity": specificity,
        "pos_pred_value": precision,
        "neg_pred_value": F.try_divide(tn, every - p),
        "precision": precision,
        "recall": recall,
        "f1": F.try_divide(2 * precision * recall, precision + recall),
        "prevalence": F.try_divide(t, every),
        "detection_rate": F.try_divide(tp, every),
        "detection_prevalence": F.try_divide(p, every),
        "balanced_accuracy": (recall + specificity) / 2,
    }
    rows = F.array(*[F.struct(F.lit(m).alias("term"), values[m].alias("estimate")) for m in terms])
    return counted.select(*keys, "class", F.inline(rows))


def with_sample_sizes(metrics: DataFrame, sizes: DataFrame) -> DataFrame:
    return metrics.join(sizes, ["category", "class", "data_type"], "left")


def overall_metrics(metrics: DataFrame, sizes: DataFrame) -> DataFrame:
    """Sample-size-weighted mean per (category, term, data_type); NULL if a class has no estimate or no size."""
    e, n = F.col("estimate"), F.col("sample_size")
    complete = (F.count(e) == F.count("*")) & (F.count(n) == F.count("*"))
    return with_sample_sizes(metrics, sizes).groupBy("category", "term", "data_type").agg(
        F.when(complete, F.try_divide(F.sum(e * n), F.sum(n))).alias("estimate"),
        F.when(F.count(n) == F.count("*"), F.sum(n)).alias("sample_size"),
    ).withColumn("class", F.lit("overall"))


def confusion_matrix(pairs: DataFrame) -> DataFrame:
    """Counts per (category, data_type, true_class, predicted_class), zero for absent pairs of observed values.

    A missing prediction is a level of its own, NULL.
    """
    axes = ("data_type", "true_class", "predicted_class")
    counts = confusion_counts(pairs.fillna("", "predicted_class"), ("category", "data_type"), "true_class IS NOT NULL")
    # one small row per category: the observed values and the counted cells; the grid is unfolded from it
    cell = F.struct(*axes)
    folded = counts.groupBy("category").agg(
        *[F.collect_set(a).alias(a) for a in axes], F.map_from_entries(F.collect_list(F.struct(cell.alias("at"), "n"))).alias("cells")
    )
    grid = reduce(lambda df, a: df.withColumn(a, F.explode(a)), axes, folded)
    n = F.coalesce(F.try_element_at("cells", cell), F.lit(0).cast("bigint"))
    return grid.select("category", *axes[:2], F.nullif("predicted_class", F.lit("")).alias("predicted_class"), n.alias("n"))


def metric_labels(metrics: DataFrame) -> DataFrame:
    """(category, term, class, error_text): ``val, train (n)`` from metrics that carry sample_size."""

    def of(kind: str, column: str) -> Column:
        return F.max(F.when(F.col("data_type") == kind, F.col(column)))

    def text(column: str) -> Column:
        return F.when(F.col(column).isNotNull(), F.format_string("%.2f", F.round(column, 2))).otherwise("NA")

    wide = metrics.groupBy("category", "term", "class").agg(
        *[of(kind, c).alias(f"{c}_{kind}") for c in ("estimate", "sample_size") for kind in ("val", "train")]
    )
    texts = [text(f"estimate_{k}") for k in ("val", "train")]
    n = F.coalesce((F.col("sample_size_val") + F.col("sample_size_train")).cast("string"), F.lit("NA"))
    label = F.concat(texts[0], F.lit(", "), texts[1], F.lit(" ("), n, F.lit(")"))
    return wide.select("category", "term", "class", label.alias("error_text"))


def report_labels(metrics: DataFrame, sizes: DataFrame) -> DataFrame:
    """:func:`metric_labels` of the classes and of all classes together, with class_label and facet_label.

    As on a report's axis, classes outside the display order have no label.
    """
    rows = with_sample_sizes(metrics, sizes).unionByName(overall_metrics(metrics, sizes))
    facet = F.concat(F.initcap("term"), F.lit(": "), F.initcap(F.replace("category", F.lit("_"), F.lit(" "))))
    return metric_labels(rows).withColumns({"class_label": N.display_label("class"), "facet_label": facet})


def class_rank_label(df: DataFrame, col: str = "class") -> DataFrame:
    """Add class_rank and class_label of the fixed report order."""
    return df.select("*", N.display_rank(col).alias("class_rank"), N.display_label(col).alias("class_label"))


# ---- report tables -------------------------------------------------------------------------------------
def _of_site_year(df: DataFrame, site: str | None, year: int | None) -> DataFrame:
    if site is not None:
        df = df.filter(F.col("phenocam_name") == site)
    return df if year is None else df.filter(F.col("year") == year)


WRITERS = 64
PANEL = ("series", "phenocam_name", "year", "date", "category", "class", "probability", "class_rank")


def timeseries_panel(
    obs: DataFrame, final: DataFrame, site: str | None = None, year: int | None = None
) -> DataFrame:
    """Plot-ready rows (series, phenocam_name, year, date, category, class, probability, class_rank).

    ``series`` is ``probability`` (all classes), ``maxprob`` or ``hmm``. The filters stand before the
    means; that on the year is computed from the date, so to read many single years store the panel: :func:`store_panel`.
    """
    keys = ("phenocam_name", "year", "date")
    images = _of_site_year(obs.withColumn("year", F.year("date")), site, year).select("phenocam_name", "date", "file", *S.CATEGORIES)
    # Images are shuffled once, as they are with packed vectors: neither 24 rows for each nor 21 sums and counts. The order asks for
    # every column, so that the rows and the means read one exchange, and a site's rows stand together where they are written.
    images = packed(images).repartitionByRange("phenocam_name", "date")
    none = F.lit(None).cast("double").alias("probability")

    def whole(rows: DataFrame) -> DataFrame:
        return unpacked(rows).withColumn("year", F.year("date"))

    top = maxprob_class(whole(images), (*keys, "file"))
    rows = whole(images.sortWithinPartitions("phenocam_name", "date", "file"))
    parts = [
        rows.select(F.lit("probability").alias("series"), *keys, F.expr(f"inline({long_rows_sql(S.CLASSES)})")),
        top.select(F.lit("maxprob").alias("series"), *keys, "category", F.col("maxprob_class").alias("class"), none),
        final_long(_of_site_year(final, site, year)).select(
            F.lit("hmm").alias("series"), *keys, "category", F.col("hmm_class").alias("class"), none
        ),
    ]
    return reduce(DataFrame.unionByName, parts).withColumn("class_rank", N.display_rank("class"))


def store_panel(panel: DataFrame, path: str) -> None:
    """The panel as a table partitioned by category and year, for reports that look at single years.

    :func:`timeseries_panel` deals images by site range before it unfolds them, so its tasks are written as they come: every
    task writes a file per partition, in which a site's rows stand together. Shuffling or sorting the unfolded rows, 24 of an
    image, would take many times the disk of the images. WRITERS files are open in a task at once; with more partitions than
    that Spark sorts, so no number of years is too large.
    """
    conf = panel.sparkSession.conf
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = conf.get(name, None)
    conf.set(name, str(WRITERS))
    try:
        write_table(panel, path, ("category", "year"))
    finally:
        conf.set(name, before) if before is not None else conf.unset(name)


def read_panel(spark: SparkSession, path: str, site: str | None = None, year: int | None = None, category: str | None = None) -> DataFrame:
    """Rows of a stored panel. Category and year prune folders; the site is pushed to the files, whose statistics skip row groups."""
    rows = read_table(spark, path)
    for column, value in (("category", category), ("year", year), ("phenocam_name", site)):
        if value is not None:
            rows = rows.filter(F.col(column) == value)
    return rows.select(*PANEL)


def site_years(obs: DataFrame, min_days: int = S.SITE_YEAR_MIN_DAYS) -> DataFrame:
    """(phenocam_name, year, n_days) with at least ``min_days`` distinct days."""
    days = obs.select("phenocam_name", "date").distinct()
    counted = days.groupBy("phenocam_name", F.year("date").alias("year")).agg(F.count("*").alias("n_days"))
    return counted.filter(F.col("n_days") >= min_days)


def image_diagnostic(obs: DataFrame, truth: DataFrame, file: str | None = None) -> DataFrame:
    """Class probabilities of annotated images with flags for the highest and the true class.

    (filename, category, class, probability, is_maxprob_class, is_true_class, label_x, class_rank); ``label_x`` places
    the annotation mark beside a long bar or to the right of a short one.
    """
    if file is not None:
        obs, truth = obs.filter(F.col("file") == file), truth.filter(F.col("filename") == file)
    labels = truth.groupBy("filename").agg(
        *[F.max(F.when(F.col("category") == c, F.col("true_class"))).alias(f"_true_{c}") for c in S.CATEGORIES]
    )
    images = image_means(of_images(obs, labels), ("file",)).withColumnRenamed("file", "filename").join(labels, "filename")
    rows = ", ".join(
        f"named_struct('category', '{c}', 'class', {V.quoted(name)}, 'probability', {V.element_sql(c, k)}, "
        f"'is_maxprob_class', {V.first_top_code_sql(c)} = {k}, 'is_true_class', _true_{c} = {V.quoted(name)})"
        for c in S.CATEGORIES
        for k, name in enumerate(S.CLASSES[c])
    )
    x = F.when(F.col("is_true_class"), F.when(F.col("probability") < 0.5, 0.6).otherwise(0.2))
    return images.selectExpr("filename", f"inline(array({rows}))").withColumns(
        {"label_x": x, "class_rank": N.display_rank("class")}
    )


def greenness_vs_status(gcc: DataFrame, final: DataFrame, site: str | None = None, year: int | None = None) -> DataFrame:
    """(phenocam_name, year, doy, day_label, gcc, crop_status): both series on one day axis, missing sides NULL."""
    keys = ("phenocam_name", "year", "doy")

    def on_axis(df: DataFrame) -> DataFrame:
        return _of_site_year(df.withColumn("year", F.year("date")), site, year).withColumn("doy", F.dayofyear("date"))

    green = on_axis(gcc).select(*keys, F.col("smooth_gcc_90").alias("gcc"))
    status = on_axis(final).select(*keys, "crop_status")
    return green.join(status, list(keys), "full").select(*keys, N.day_label("doy").alias("day_label"), "gcc", "crop_status")
