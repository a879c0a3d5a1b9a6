"""Guards as queries: each returns the rows that break a rule, and is empty on sound data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldstate import schema as S
from fieldstate.functions import names as N


def undated_files(pred: DataFrame) -> DataFrame:
    """Images whose file name holds no site or date."""
    return pred.filter(N.file_date("file").isNull()).select("file")


def sequence_violations(df: DataFrame) -> DataFrame:
    """(phenocam_name, date, category, share_missing): days whose values of a category are not all there or all missing,
    and days that occur more than once in a table that should hold one row per day."""
    categories = [c for c in S.CATEGORIES if c in df.columns]

    def missing(category: str) -> str:
        holes = f"size(filter({category}, p -> p IS NULL)) / {S.WIDTHS[category]}"
        return f"avg(CASE WHEN {category} IS NULL THEN 1.0D ELSE {holes} END) AS {category}"

    days = df.groupBy("phenocam_name", "date").agg(F.expr("count(*) AS n"), *[F.expr(missing(c)) for c in categories])
    rows = ", ".join(f"named_struct('category', '{c}', 'share_missing', {c})" for c in categories)
    shares = days.selectExpr("phenocam_name", "date", "n", f"inline(array({rows}))")
    return shares.filter("n > 1 OR share_missing NOT IN (0.0D, 1.0D)").drop("n")


def split_assertions(split: DataFrame, site_regex: str = S.VALIDATION_SITES) -> DataFrame:
    """(rule, violations): held-out sites in the training set, and images that occur more than once in a set."""
    # per image first, so the checks need one shuffle by file and only counts after it
    per_image = split.groupBy("is_validation", "filename").agg(F.count("*").alias("n"))
    site = F.substring_index("filename", "_", 1)
    totals = per_image.agg(
        F.coalesce(F.sum(F.when(~F.col("is_validation") & site.rlike(site_regex), F.col("n"))), F.lit(0)).alias("held_out"),
        F.coalesce(F.sum(F.when(~F.col("is_validation"), F.col("n") - 1)), F.lit(0)).alias("train"),
        F.coalesce(F.sum(F.when(F.col("is_validation"), F.col("n") - 1)), F.lit(0)).alias("val"),
    )
    rules = F.array(
        F.struct(F.lit("holdout_site_in_train").alias("rule"), F.col("held_out").alias("violations")),
        F.struct(F.lit("duplicates_in_train").alias("rule"), F.col("train").alias("violations")),
        F.struct(F.lit("duplicates_in_validation").alias("rule"), F.col("val").alias("violations")),
    )
    return totals.select(F.inline(rules))
