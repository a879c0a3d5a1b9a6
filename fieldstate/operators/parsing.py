"""Columns derived from image file names and addresses. All row-local."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldstate import schema as S
from fieldstate.functions import names as N


def parse_image_file(df: DataFrame, col: str = "file") -> DataFrame:
    """Add phenocam_name, datetime (local, no zone), year and date. Time parts are NULL if the name has none."""
    stamp = N.file_timestamp(col)
    return df.select(
        "*",
        N.file_site(col).alias("phenocam_name"),
        stamp.alias("datetime"),
        F.year(stamp).alias("year"),
        stamp.cast("date").alias("date"),
    )


def parse_site_date(df: DataFrame, col: str = "file") -> DataFrame:
    """Add phenocam_name and date as text, from the first four ``_`` separated parts."""
    parts = F.split(col, "_")
    date = F.concat_ws("-", *[F.get(parts, F.lit(i)) for i in (1, 2, 3)])
    return df.select("*", F.get(parts, F.lit(0)).alias("phenocam_name"), date.alias("date"))


def parse_file_parts(df: DataFrame, col: str = "url") -> DataFrame:
    """Add filename, phenocam_name, year, month, day, hour and date from the last part of an address."""
    file = N.base_name(col)
    year, month, day, hour = (N.file_part(file, g).cast("int") for g in (2, 3, 4, 5))
    return df.select(
        "*",
        file.alias("filename"),
        N.file_part(file, 1).alias("phenocam_name"),
        year.alias("year"),
        month.alias("month"),
        day.alias("day"),
        hour.alias("hour"),
        N.file_timestamp(file).cast("date").alias("date"),
    )


def hour_filter(df: DataFrame, hours: tuple[int, ...] = S.EXTRA_HOURS) -> DataFrame:
    return df.filter(F.col("hour").isin(*hours))
