"""Camera tables derived by Spark from the given star-schema tables.

The library's own inputs (images, class probabilities, annotations, greenness, sites) are computed from
``lineitem`` and ``supplier``, so every query grows with those tables. Class probabilities are built directly
in vector form: one row per image, no join with the class dictionary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldstate import schema as S

ARCHIVE = "http://archive.example/data/archive"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per image: site, date, hour, file name and the true class codes (dc, cs, ct)."""
    day = F.expr("DATE '2018-01-01' + CAST((year(l_shipdate) * 365 + dayofyear(l_shipdate)) % 500 AS INT)")
    h0 = F.expr("(l_orderkey * 7919 + l_linenumber * 104729 + l_partkey * 31) % 1000")
    hour = 9 + F.col("h0") % 7
    shots = (
        table(spark, sf_dir, "lineitem")
        .select(F.col("l_suppkey").alias("site_no"), day.alias("date"), h0.alias("h0"))
        .groupBy("site_no", "date", hour.alias("hour"))
        .agg(F.min("h0").alias("h"))
    )
    site = F.concat(F.lit("site"), F.col("site_no").cast("string"))
    # the hour again, from the shot that stays: a filter on file names is then not computed for every row before the shots are united
    shot_hour = 9 + F.col("h") % 7
    stamp = F.concat(
        F.date_format("date", "yyyy_MM_dd"), F.lit("_"), F.lpad(shot_hour.cast("string"), 2, "0"), F.lit("0000.jpg")
    )
    phase = F.col("phase")
    return (
        shots.withColumn("phase", (F.dayofyear("date") + 13 * F.col("site_no")) % 365)
        .withColumn("phenocam_name", site)
        .withColumn("file", F.concat_ws("_", site, stamp))
        .withColumn("dc", F.when(phase < 60, 4).when(phase < 150, 2).when(phase < 180, 3).when(phase < 330, 1).otherwise(2))
        .withColumn(
            "cs",
            F.when(phase < 150, 6).when(phase < 175, 1).when(phase < 230, 2).when(phase < 260, 3)
            .when(phase < 300, 4).when(phase < 330, 5).otherwise(6),
        )
        .withColumn(
            "ct",
            F.when(phase < 150, 7).when(phase < 190, 1)
            .when(phase < 330, (2 + (F.year("date") + F.col("site_no")) % 5).cast("int")).otherwise(7),
        )
        .select("phenocam_name", "site_no", "date", "hour", "h", "phase", "file", "dc", "cs", "ct")
    )


def _probabilities(label: str, width: int) -> str:
    """Vector of class shares, to 4 decimals: a constant for the true class, a varying part, and blur on some images."""
    weights = [f"(IF({label} = {k}, 60, 0) + (h + {37 * k * k + 11 * k}) % 40)" for k in range(width)]
    weights[0] = f"({weights[0]} + IF(h % 29 = 0, 200, 0))"
    total = f"({' + '.join(weights)})"
    return f"array({', '.join(f'floor(CAST({w} AS DOUBLE) / {total} * 10000 + 0.5) / 10000' for w in weights)})"


def scored_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`images` with one vector per category: class shares to 4 decimals."""
    vectors = [f"{_probabilities(label, S.WIDTHS[c])} AS {c}" for c, label in zip(S.CATEGORIES, ("dc", "ct", "cs"))]
    return images(spark, sf_dir).selectExpr("phenocam_name", "date", "file", "h", *vectors)


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class probabilities per image: (filepath, file, dominant_cover, crop_type, crop_status).

    Every fifth image also occurs under the extra-image folder and every third one twice, as in a scoring run
    over overlapping folders.
    """
    folders = (
        "array_compact(array('data/all_images/', IF(h % 5 = 0, 'data/extra_train_images/', NULL), "
        "IF(h % 3 = 0, 'data/train_images/', NULL)))"
    )
    scored = scored_images(spark, sf_dir)
    return scored.selectExpr(f"explode({folders}) AS folder", "file", *S.CATEGORIES).selectExpr(
        "concat(folder, file) AS filepath", "file", *S.CATEGORIES
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class probabilities per image with site and date: (phenocam_name, date, file, 3 vectors)."""
    return scored_images(spark, sf_dir).drop("h")


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    blurry = F.col("h") % 29 == 0

    def code(name: str) -> Column:
        return F.when(blurry, 0).otherwise(F.col(name))

    return (
        images(spark, sf_dir)
        .filter((F.col("hour") == 12) & (F.col("h") % 3 != 0))
        .select(
            "file", code("cs").alias("crop_status"), code("ct").alias("crop_type"),
            code("dc").alias("dominant_cover"), (F.col("h") % 60).cast("int").alias("time"),
        )
    )


def redo(spark: SparkSession, sf_dir: str) -> DataFrame:
    time = F.col("time")
    return (
        annotations(spark, sf_dir)
        .filter(time % 17 != 0)
        .select("file", F.when(time % 11 == 0, 7).when(time % 13 == 0, 0).otherwise(F.col("crop_type")).alias("crop_type"), "time")
    )


def extra(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.concat(F.lit(f"{ARCHIVE}/"), "phenocam_name", F.lit("/"), "file")
    return images(spark, sf_dir).select(url.alias("url"), F.col("file").alias("filename"), "phenocam_name", "date", "hour")


def rois(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, nation = F.col("s_suppkey"), F.col("s_nationkey").cast("double")
    base = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("site"), key.cast("string")).alias("phenocam_name"), nation.alias("lat"), (-nation).alias("lon"),
        F.when(key % 4 == 0, "GR").otherwise("AG").alias("roi_type"),
        F.when(key % 6 == 5, 1001).otherwise(1000).alias("roi_id"),
        (1.5 + (key % 8).cast("double") / 2).alias("site_years"),
        F.when(key % 3 == 0, "LTAR NEON").otherwise("NEON").alias("grp"),
    )
    # the second region of interest of site1: a duplicate name, as real site lists have
    second = spark.range(1).select(
        F.lit("site1").alias("phenocam_name"), F.lit(0.0).alias("lat"), F.lit(0.0).alias("lon"), F.lit("AG").alias("roi_type"),
        F.lit(2000).alias("roi_id"), F.lit(2.5).alias("site_years"), F.lit("NEON").alias("grp"),
    )
    return base.unionByName(second)


def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greenness transition dates per site and growing cycle: (site, direction, gcc_value, transition_10/25/50)."""
    shots = images(spark, sf_dir)
    phases = (160, 175, 200, 270, 300, 330)
    phase = (F.dayofyear("date") + 13 * F.col("site_no")) % 365
    cycle = F.floor((F.dayofyear("date") + 13 * F.col("site_no") + 365 * (F.year("date") - 2018)) / 365.0).cast("int")
    # the day of the year on which a site is in a phase is known, so dates are met by an equi-join
    asked = shots.select("site_no", "phenocam_name").distinct().withColumn("wanted", F.explode(F.array(*[F.lit(p) for p in phases])))
    asked = asked.select("site_no", "phenocam_name", F.pmod(F.col("wanted") - 13 * F.col("site_no"), F.lit(365)).alias("day"))
    observed = shots.select("date").distinct().withColumn("day", (F.dayofyear("date") % 365).cast("long"))
    days = (
        asked.withColumn("day", F.col("day").cast("long")).join(observed, "day")
        .select("phenocam_name", "date", phase.alias("phase"), cycle.alias("cyc"))
    )
    at = {p: F.max(F.when(F.col("phase") == p, F.col("date"))) for p in phases}
    per_cycle = days.groupBy("phenocam_name", "cyc").agg(*[c.alias(f"p{p}") for p, c in at.items()])

    def half(direction: str, p10: int, p25: int, p50: int) -> DataFrame:
        complete = F.col(f"p{p10}").isNotNull() & F.col(f"p{p25}").isNotNull() & F.col(f"p{p50}").isNotNull()
        return per_cycle.filter(complete).select(
            F.col("phenocam_name").alias("site"), F.lit(direction).alias("direction"), F.lit("gcc_90").alias("gcc_value"),
            F.col(f"p{p10}").alias("transition_10"), F.col(f"p{p25}").alias("transition_25"),
            F.col(f"p{p50}").alias("transition_50"),
        )

    return half("rising", 160, 175, 200).unionByName(half("falling", 330, 300, 270))


def greenness(spark: SparkSession, sf_dir: str) -> DataFrame:
    shots = images(spark, sf_dir)
    in_season = F.when(F.min("phase").between(160, 330), 1).otherwise(0)
    return shots.groupBy("phenocam_name", "date").agg(
        F.min("file").alias("midday_filename"),
        F.min(F.when(F.col("dc") == 4, 1).otherwise(0)).alias("snow_flag"),
        F.round(0.30 + 0.15 * in_season + F.min("h").cast("double") / 20000, 5).alias("smooth_gcc_90"),
    )
