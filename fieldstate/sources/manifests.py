"""Link extraction and download bookkeeping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldstate.functions import names as N

# fixed values: an archive link to an image
LINK_PATH = "/data/archive*"
LINK_TYPE = "jpg|jpeg"

# What stands in a page, one alternative per state, tried in order at each place: a comment, an element whose content is no
# markup, the attributes of a link (group 2), any other tag. A match consumes its whole construct, so a link inside a comment, a
# script or another tag's attribute is never seen as one. Quoted values may hold ">"; loops are possessive, so that no tag
# backtracks.
ATTRIBUTES = r"""(?:[^"'>]++|"[^"]*+"|'[^']*+')*+"""
TOKENS = (
    r"(?is)<!--.*?(?:-->|\z)"
    rf"|<(script|style|textarea|title|iframe|noembed|noframes|xmp)(?=[\s/>]){ATTRIBUTES}>.*?(?:</\1(?=[\s/>])|\z)"
    rf"|<a(?=[\s/])({ATTRIBUTES})>"
    rf"|</?[a-z!?]{ATTRIBUTES}>"
)
#: Name and value (quoted twice, once, or not at all) of each attribute.
ATTRIBUTE = r"""(?s)([^\s"'>/=][^\s"'>/=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?"""
#: References that occur in addresses, the ampersand last.
REFERENCES = (("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&#38;", "&"), ("&amp;", "&"))


def link_targets(html: Column | str) -> Column:
    """The href of every link of a page, in order: an array, NULL for a NULL page. Links without href give no entry.

    Of a repeated attribute the first counts; names are read in any case; references are decoded and white space around the value is
    dropped.
    """
    html = F.col(html) if isinstance(html, str) else html
    links = F.filter(F.regexp_extract_all(html, F.lit(TOKENS), 2), lambda a: a != "")

    def target(attributes: Column) -> Column:
        names, *values = (F.regexp_extract_all(attributes, F.lit(ATTRIBUTE), k) for k in (1, 2, 3, 4))
        at = F.array_position(F.transform(names, F.lower), "href").cast("int") - 1
        value = F.concat(*[F.get(v, at) for v in values])
        for reference, character in REFERENCES:
            value = F.replace(value, F.lit(reference), F.lit(character))
        return F.when(at >= 0, F.trim(value))

    return F.filter(F.transform(links, target), lambda x: x.isNotNull())


def extract_links(
    pages: DataFrame, prefix: str, html: str = "html", path_pattern: str = LINK_PATH, type_pattern: str = LINK_TYPE
) -> DataFrame:
    """One row per ``a[href]`` that matches both patterns, host prefixed; other columns of the page are kept.

    Links are found by :func:`link_targets`: not in comments, scripts or attributes, quoted or not.
    """
    links = pages.select(*[c for c in pages.columns if c != html], F.explode(link_targets(html)).alias("href"))
    kept = links.filter(F.col("href").rlike(path_pattern) & F.col("href").rlike(type_pattern))
    return kept.withColumn("link", F.concat(F.lit(prefix), "href")).drop("href")


def image_urls(manifest: DataFrame, base: str, site="phenocam_name", date="date", file="file") -> DataFrame:
    return manifest.withColumn("url", N.archive_url(base, site, date, file))


def fetch_audit(manifest: DataFrame, available: DataFrame, file: str = "file") -> DataFrame:
    """Manifest rows whose file is not among the available ones."""
    return manifest.join(available.select(file), file, "left_anti")


def fetch_summary(manifest: DataFrame, available: DataFrame, file: str = "file") -> DataFrame:
    """Counts of expected, present and failed files, in one pass over the manifest."""
    present = available.select(file).distinct().withColumn("present", F.lit(1))
    return manifest.join(present, file, "left").agg(
        F.count("*").alias("expected"),
        F.count("present").alias("present"),
        (F.count("*") - F.count("present")).alias("failed"),
    )
