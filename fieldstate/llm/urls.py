"""URL filters: explicit host and path rules, and a path-template tree with labelled purity for all other pages.

The tree grows per host, level by level: under a parent with many children, a segment that holds few of the pages and whose
share of bad ones does not differ significantly from its siblings' becomes a wildcard. Every node counts its labelled pages.
Walking down a template, a branch whose share of bad pages does not differ significantly from the node above is merged into
it; a template takes the verdict of the last node that stands by itself.
Counts are summed before every shuffle, so a host may hold most pages.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldstate.llm import common as C

#: Rules as (verdict, host and path); the longest that fits wins.
RULES = (
    ("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"),
)
#: A parent with more children than this generalises those that hold less than the share of its pages; one of so many pages or more only if its labels do not tell it from the others.
CHILDREN, SHARE, FEW = 12, 0.05, 5
#: Branches merge below this z value. A template is blocked if its purity, smoothed by so many pages of the mean, is above.
Z, WEIGHT, LIMIT = 2.58, 4.0, 0.5


#: Whether l labelled pages, k of them bad, differ from the other ones of ls and ks: the z test without its divisions.
UNLIKE = (
    f"(l > 0 AND ls > l AND ks > 0 AND ks < ls "
    f"AND pow(k * (ls - l) - (ks - k) * l, 2) * ls >= {Z * Z} * ks * (ls - ks) * l * (ls - l))"
)


def host_of(url: Column) -> Column:
    host = F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit(""))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule for columns host and path; null where none fits."""
    name = verdict = F.lit(None).cast("string")
    for what, rule in sorted(rules, key=lambda r: len(r[1])):
        host, _, path = rule.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith("/" + path)
        name, verdict = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(what)).otherwise(verdict)
    return name, verdict


def templated(pages: DataFrame) -> DataFrame:
    """``pages`` (host, path, bad, ...) with a column ``template``: array of segments, variable ones as "*"."""
    df = pages.withColumn("_segments", F.split("path", "/", -1)).withColumn("template", F.array().cast("array<string>"))
    df = C.written(df.withColumn("_open", F.lit(True)), "tree")
    closed, level = [], 0
    # only rows whose path goes on, below a node of more pages than CHILDREN, reach the next level
    while not (df := df.filter("_open")).isEmpty():
        df = df.withColumn("_segment", F.get("_segments", F.lit(level)))
        keys = ["host", "template", "_segment"]
        counts = df.groupBy(*keys).agg(
            F.count("*").alias("n"), F.count("bad").cast("double").alias("l"), F.coalesce(F.sum("bad"), F.lit(0)).cast("double").alias("k"))
        parents = counts.groupBy("host", "template").agg(
            F.count("*").alias("children"), F.sum("n").alias("total"), F.sum("l").alias("ls"), F.sum("k").alias("ks")).filter(f"children > {CHILDREN}")
        few = F.col("n") < SHARE * F.col("total")
        wild = F.coalesce(few & ((F.col("n") < FEW) | ~F.expr(UNLIKE)), F.lit(False))
        # so few pages have no more children further down, so they keep the rest of their paths
        known = counts.join(parents, ["host", "template"], "left").withColumn("_wild", wild).filter(f"_wild OR n <= {CHILDREN}")
        df = df.join(known.select(*keys, "_wild"), keys, "left")
        left = F.slice("_segments", level + 1, F.size("_segments"))
        step = F.when(F.col("_wild"), F.array(F.lit("*"))).when(~F.col("_wild"), left).otherwise(F.array("_segment"))
        goes_on = F.coalesce("_wild", F.lit(True)) & (F.size("_segments") > level + 1)
        grown = df.withColumn("template", F.concat("template", step)).withColumn("_open", goes_on)
        df = C.written(grown.drop("_segment", "_wild"), f"tree-{level}")
        closed.append(df.filter("NOT _open"))
        level += 1
    return reduce(DataFrame.unionByName, closed, df).drop("_segments", "_open")


def purity(pages: DataFrame) -> DataFrame:
    """(host, template, labelled, bad): counts that decide on a template; ``pages`` has host, template, bad (null: no label)."""
    counts = pages.groupBy("host", "template").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("k"))
    prefixes = F.transform(F.sequence(F.lit(0), F.size("template")), lambda d: F.slice("template", F.lit(1), d))
    lines = counts.select("host", "template", "n", "k", F.posexplode(prefixes).alias("depth", "node"))
    nodes = lines.groupBy("host", "node").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    walks = lines.select("host", "template", "depth", "node").join(nodes, ["host", "node"]).groupBy("host", "template").agg(
        F.sort_array(F.collect_list(F.struct("depth", F.col("n").cast("double").alias("n"), F.col("k").cast("double").alias("k")))).alias("walk"))
    pooled = "((a.k + x.k) / (a.n + x.n))"
    z = f"abs(a.k / a.n - x.k / x.n) / sqrt({pooled} * (1 - {pooled}) * (1 / a.n + 1 / x.n))"
    differs = f"a.n > 0 AND x.n > 0 AND a.k + x.k > 0 AND a.k + x.k < a.n + x.n AND {z} >= {Z}"
    stands = F.expr(f"aggregate(walk, walk[0], (a, x) -> CASE WHEN a.n = 0 OR ({differs}) THEN x ELSE a END)")
    return walks.withColumn("s", stands).select("host", "template", F.col("s.n").alias("labelled"), F.col("s.k").alias("bad"))


def url_verdicts(pages: DataFrame, labels: DataFrame, page_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """(page id, host, path, rule, verdict, template, labelled, bad) of every row.

    ``labels``: (page id, bad 0 or 1); pages without one take no part in purity, several labels of a page count by their
    mean. The longest fitting rule decides; else a template is blocked if (bad + WEIGHT * mean) / (labelled + WEIGHT)
    exceeds LIMIT, the mean being that of all labels. Null urls and urls without :// have empty host and path and are judged
    like a host of that name. Repeated rows stay, each with its verdict; a null id has no label. Empty tables give an empty
    table; without any label all templates are allowed. Other columns are left out.
    """
    mean = labels.agg(F.avg("bad")).first()[0] or 0.0
    one = labels.groupBy(page_col).agg(F.avg("bad").alias("bad"))
    url = F.col(url_col)
    rows = pages.select(page_col, host_of(url).alias("host"), path_of(url).alias("path")).join(one, page_col, "left")
    rows = templated(rows)
    by_template = purity(rows)
    judged = rows.drop("bad").join(by_template, ["host", "template"])
    name, verdict = fitting_rule(rules)
    smoothed = (F.col("bad") + F.lit(WEIGHT * mean)) / (F.col("labelled") + WEIGHT)
    return judged.select(
        page_col, "host", "path", name.alias("rule"),
        F.coalesce(verdict, F.when(smoothed > LIMIT, "block").otherwise("allow")).alias("verdict"),
        F.array_join("template", "/").alias("template"), F.col("labelled").cast("long").alias("labelled"), F.round("bad", 6).alias("bad"),
    )


def page_labels(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(page_id, bad) of pages whose path ends in the id of a labelled document: bad is toxic or of low quality."""
    number = F.regexp_extract(path_of(F.col("url")), "/([0-9]{1,18})(?:\\.html)?/?$", 1)
    ids = pages.select("page_id", F.when(number != "", number).cast("long").alias("doc_id"))
    bad = labels.select("doc_id", F.when((F.col("toxic") == 1) | (F.col("quality") == 0), 1).otherwise(0).alias("bad"))
    return ids.join(bad, "doc_id").select("page_id", "bad")


def digest(pages: DataFrame, labels: DataFrame) -> DataFrame:
    return url_verdicts(pages, page_labels(pages, labels))
