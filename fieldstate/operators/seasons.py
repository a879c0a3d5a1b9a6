"""Seasons from greenness transition dates, and the image lists sampled from them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldstate import schema as S
from fieldstate.operators import islands as I

THRESHOLDS = ("transition_10", "transition_25", "transition_50")
SEASON = ("direction", "threshold")


def melt_thresholds(transitions: DataFrame, gcc: str = "gcc_90") -> DataFrame:
    """One row per transition date: (phenocam_name, direction, threshold, date)."""
    return (
        transitions.filter(F.col("gcc_value") == gcc)
        .select(F.col("site").alias("phenocam_name"), "direction", *THRESHOLDS)
        .unpivot(["phenocam_name", "direction"], list(THRESHOLDS), "threshold", "date")
        .filter(F.col("date").isNotNull())
    )


def densify_locf(
    df: DataFrame, keys: tuple[str, ...] = ("phenocam_name",), date: str = "date", order: tuple[str, ...] = ("threshold", "direction")
) -> DataFrame:
    """Daily calendar from first to last date per key, every other column carried forward.

    Each row is repeated until the day before the next row, which is the carried-forward value by construction:
    one shuffle by key and no join with a calendar. Rows that share a date are all kept; the last of them in
    ``order`` is the one carried on. ``original_transition_date`` is true on the input rows, NULL on added days.
    """
    window = I.ordered(list(keys), [date, *order])
    last_day = F.greatest(F.date_sub(F.col("next_date"), 1), F.col(date))
    rest = [c for c in df.columns if c != date]
    return (
        df.withColumn("next_date", F.lead(date).over(window))
        .select(*rest, F.posexplode(F.sequence(date, F.coalesce(last_day, F.col(date)))).alias("step", date))
        .select(*df.columns, F.when(F.col("step") == 0, True).alias("original_transition_date"))
    )


def period_of(direction: Column | str, threshold: Column | str) -> Column:
    """Season name of a transition, NULL for an unknown pair."""
    direction = F.col(direction) if isinstance(direction, str) else direction
    threshold = F.col(threshold) if isinstance(threshold, str) else threshold
    first, *others = [((direction == d) & (threshold == t), p) for d, t, p in S.SEASON_PERIODS]
    return reduce(lambda chain, rule: chain.when(*rule), others, F.when(*first))


def season_period(df: DataFrame) -> DataFrame:
    return df.withColumn("period", period_of("direction", "threshold"))


def asof_season(images: DataFrame, melted: DataFrame) -> DataFrame:
    """Images (phenocam_name, date, ...) with the period of the latest transition on or before their date.

    Transition spans are small and unique per site and date, so they are expanded to days and joined on equality:
    the images are never ordered or grouped by site, and a site that holds most of the images stays splittable.
    Images outside the first..last transition of their site get NULL.
    """
    window = I.ordered(["phenocam_name"], ["date", "threshold", "direction"])
    latest_of_day = melted.withColumn("next_date", F.lead("date").over(window)).filter(
        F.col("next_date").isNull() | (F.col("next_date") > F.col("date"))
    )
    end = F.coalesce(F.date_sub("next_date", 1), F.col("date"))
    days = latest_of_day.select(
        "phenocam_name", F.explode(F.sequence("date", end)).alias("date"), period_of("direction", "threshold").alias("period")
    )
    return images.join(days, ["phenocam_name", "date"], "left")


def attach_midday_image(seasons: DataFrame, gcc: DataFrame) -> DataFrame:
    """Add image_filename and snow_flag of the day's midday image, NULL if there is none."""
    midday = gcc.filter(F.col("midday_filename").rlike(".jpg")).select(
        "phenocam_name", "date", F.col("midday_filename").alias("image_filename"), "snow_flag"
    )
    return seasons.join(midday, ["phenocam_name", "date"], "left")


def present_runs(
    df: DataFrame,
    keys: tuple[str, ...] = ("phenocam_name",),
    order: tuple[str, ...] = ("date", "threshold", "direction"),
    present: str = "image_filename",
) -> DataFrame:
    """Add running_tally (rows since the run began, 0 when absent) and site_seq_id (run number, NULL when absent).

    Runs are over consecutive rows, so several rows of one day each count.
    """
    window = I.ordered(list(keys), list(order))
    has = F.col(present).isNotNull()
    marked = df.withColumn("_start", I.run_start(has, window)).withColumn("_row", F.row_number().over(window))
    started = F.last(F.when(F.col("_start"), F.col("_row")), ignorenulls=True).over(I.running(window))
    return (
        marked.withColumn("running_tally", F.when(has, F.col("_row") - started + 1).otherwise(0).cast("int"))
        .withColumn("site_seq_id", I.run_id(F.col("_start"), has, window).cast("int"))
        .drop("_start", "_row")
    )


def full_image_list(df: DataFrame, present: str = "image_filename") -> DataFrame:
    return df.filter(F.col(present).isNotNull())


def season_image_list(transitions: DataFrame, gcc: DataFrame) -> DataFrame:
    """The whole chain: transition dates and greenness -> one row per day with season, image and run."""
    seasons = season_period(densify_locf(melt_thresholds(transitions)))
    return present_runs(attach_midday_image(seasons, gcc))

