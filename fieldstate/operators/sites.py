"""Site selection and site tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldstate import schema as S


def select_sites(
    rois: DataFrame,
    exclude: DataFrame | Iterable[str] = S.EXCLUDED_SITES,
    roi_type: str = "AG",
    min_years: float = 2,
    roi_mod: int = 1000,
) -> DataFrame:
    """Regions of one type, with a long enough record, not experimental and not excluded (exact name match).

    ``exclude`` is a list of names, or a table with a phenocam_name column for lists that may grow.
    """
    kept = rois.filter(
        (F.col("roi_type") == roi_type) & (F.col("site_years") > min_years) & (F.col("roi_id") % roi_mod == 0)
    )
    if isinstance(exclude, DataFrame):
        return kept.join(exclude.select("phenocam_name"), "phenocam_name", "left_anti")
    return kept.filter(~F.col("phenocam_name").isin(*exclude))


def site_group_flag(sites: DataFrame, groups: DataFrame, token: str = "LTAR") -> DataFrame:
    """Add is_ltar: the site's group text (phenocam_name, grp) contains the token."""
    members = (
        groups.filter(F.contains("grp", F.lit(token))).select("phenocam_name").distinct().withColumn("is_ltar", F.lit(True))
    )
    return sites.join(members, "phenocam_name", "left").withColumn("is_ltar", F.coalesce("is_ltar", F.lit(False)))


def rows_before(sites: DataFrame, name: str) -> DataFrame:
    """(key, before): for every name, as ``name_key``, the number of rows whose name sorts before it.

    Counts on a tree of prefixes: a name is preceded, at each of its characters, by the rows that share what stands before
    and go on with a smaller character. So every window runs over the branches of one prefix, at most an alphabet.
    """
    names = sites.groupBy(name_key(name).alias("key")).agg(F.count("*").alias("n"))
    steps = names.withColumn("k", F.explode(F.sequence(F.lit(0), F.length("key")))).select(
        "key", "n", F.substring("key", F.lit(1), F.col("k")).alias("prefix"), F.substring("key", F.col("k") + 1, F.lit(1)).alias("branch")
    )
    earlier = Window.partitionBy("prefix").orderBy("branch").rowsBetween(Window.unboundedPreceding, -1)
    branches = steps.groupBy("prefix", "branch").agg(F.sum("n").alias("n"))
    branches = branches.select("prefix", "branch", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("smaller"))
    return steps.join(branches, ["prefix", "branch"]).groupBy("key").agg(F.sum("smaller").alias("before"))


def name_key(name: str) -> Column:
    """The name with a mark in front that puts nulls first."""
    return F.coalesce(F.concat(F.lit("1"), F.col(name)), F.lit("0"))


def site_table(sites: DataFrame, order: tuple[str, ...] = ("phenocam_name", "roi_id")) -> DataFrame:
    """Report table with a yes/no group column, numbered by name and then by the other columns of ``order``.

    Rows are numbered within their name and moved by the rows of smaller names, so no task orders the whole table.
    """
    name, *within = order
    rest = [c for c in sites.columns if c not in ("phenocam_name", "is_ltar")]
    before = rows_before(sites, name)
    inner = F.row_number().over(Window.partitionBy("key").orderBy(*within or ["key"]))
    flag = F.when(F.col("is_ltar"), "yes").otherwise("no")
    placed = sites.withColumn("key", name_key(name)).join(before, "key")
    return placed.select((F.col("before") + inner).cast("int").alias("number"), "phenocam_name", flag.alias("ltar_site"), *rest)


def unique_sites(sites: DataFrame) -> DataFrame:
    """One row per site name: widest record, position of the region with the highest id.

    Site lists may hold several regions per camera; joining by name alone would multiply rows.
    """
    latest = {c: F.max_by(c, "roi_id").alias(c) for c in ("lat", "lon", "roi_type")}
    dates = [f(c).alias(c) for c, f in (("first_date", F.min), ("last_date", F.max)) if c in sites.columns]
    return sites.groupBy("phenocam_name").agg(
        *latest.values(), F.max("roi_id").cast("int").alias("roi_id"), F.max("site_years").alias("site_years"), *dates
    )


def publish_join(final: DataFrame, sites: DataFrame) -> DataFrame:
    """Final table with site metadata, one output row per input row."""
    return final.join(unique_sites(sites), "phenocam_name", "left")
