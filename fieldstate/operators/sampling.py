"""Reproducible sampling with exact sizes.

Row order is decided by a key (by default a hash of the row's identity), never by partitioning, so a retried task
draws the same rows. No operator sorts the whole table in one task, and no group is numbered in one task: keys are
counted by prefix, and only what shares a prefix is ever ordered locally.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldstate.functions import keys as K

SEED = 99
DIGITS = (5,)        # hex digits of a radix selection's histograms: of 10**12 rows a cell holds a million
COPIES = 100_000     # equal rows given back by one row


def sample_per_group(
    df: DataFrame, keys: tuple[str, ...], identity: str, n: int, seed: int = SEED
) -> DataFrame:
    """At most ``n`` random rows per group.

    The rank filter lets Spark keep only ``n`` rows per group and task before the shuffle, so a hot group
    costs ``n`` rows per task.
    """
    key = K.sample_key(identity, seed)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("_key", identity))
    return df.withColumn("_key", key).withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_key", "_rank")


def sample_distinct(df: DataFrame, col: str, n: int, seed: int = SEED) -> DataFrame:
    """``n`` random distinct values: a top-n, so each task passes on at most ``n`` values."""
    values = df.select(col).distinct().withColumn("_key", K.sample_key(col, seed))
    return values.orderBy("_key", col).limit(n).select(col)


def _passing(counts: DataFrame, by: list[str]) -> DataFrame:
    """(by..., below, n), one row at most: the first cell where the running count passes ``n``, and the count below it.

    ``counts`` has (by..., taking, below, n), where ``below`` counts what lies before all cells. It has one row per histogram
    cell, so one task orders them.
    """
    upto = F.col("below") + F.sum("taking").over(Window.orderBy(*by))
    over = counts.select(*by, (upto - F.col("taking")).alias("below"), upto.alias("upto"), "n").filter("upto > n")
    first = over.agg(F.min(F.struct(*by, "below", "n")).alias("at")).filter("at IS NOT NULL")
    return first.select("at.*")


def cut_off(df: DataFrame, n: Column, tie: list[str], digits: tuple[int, ...] = DIGITS) -> DataFrame:
    """The ``n``-th smallest (``_key``, tie) among the rows with ``_in``: one row (at: struct of _key and tie, copies), where
    ``copies`` says how many of the rows equal to it belong to the smallest ``n``; no row if there are no more than ``n``.

    Rows that do not take part are counted as none, not filtered away, so that both passes may read one exchange of the caller's.
    Radix select: a histogram over the first ``digits`` of the key finds the cell that holds the place, further numbers of
    digits refine it, and only the distinct keys of the last cell are ordered. Every step is an aggregate with partial
    counts over two or three columns; only histograms are shuffled, and a cell is picked by an equi-join with its one row.
    """
    keys = df.select("_key", "_in", *tie)
    cell = lambda k: F.substring("_key", 1, k)
    cells = keys.groupBy(cell(digits[0]).alias("cell")).agg(F.count("*").alias("rows"), F.count_if("_in").alias("taking"))
    every = Window.partitionBy()  # at most 16 ** digits rows
    totals = cells.withColumns({"all_rows": F.sum("rows").over(every), "all_taking": F.sum("taking").over(every)})
    edge = _passing(totals.select("cell", "taking", F.lit(0).cast("long").alias("below"), n.cast("long").alias("n")), ["cell"])
    for k, finer in zip(digits, [*digits[1:], None]):
        by = {"cell": cell(finer)} if finer else {c: F.col(c) for c in ("_key", *tie)}
        inside = keys.withColumn("_cell", cell(k)).join(F.broadcast(edge.withColumnRenamed("cell", "_cell")), "_cell")
        counts = inside.groupBy("below", "n", *[c.alias(name) for name, c in by.items()]).agg(F.count_if("_in").alias("taking"))
        edge = _passing(counts.filter("taking > 0"), list(by))
    return edge.select(F.struct("_key", *tie).alias("at"), F.greatest(F.col("n") - F.col("below"), F.lit(0)).alias("copies"))


def take_exactly(df: DataFrame, n: Column, key: Column, tie: list[str], flag: str, among: str = "true", digits: tuple[int, ...] = DIGITS) -> DataFrame:
    """Add a boolean ``flag``: true for the ``n`` rows with the smallest (key, tie), for any size of ``n``.

    Only rows that satisfy ``among`` take part; ``n`` is an expression over ``all_rows`` and ``all_taking``, the number
    of rows and of rows that take part. ``key`` is a hex key. Rows are compared with one value, :func:`cut_off`, where they
    are read: no shuffle, no stored copy, no job while the plan is built. Rows equal to the cut-off in key and tie are
    collapsed to one row per content with its number, and that many are given back, so copies of one row are no hot group.
    ``df`` is read four times, without a filter of its own: end a costly one in an exchange by all its columns, and that is read.
    """
    rows = df.withColumns({"_key": key, "_in": F.coalesce(F.expr(among), F.lit(False))})
    # the cut-off comes to every row by a hash join with its one row: named as a subquery it would be planned once per use. Both
    # keys are 0, computed from columns, as the planner would turn a constant key into a nested loop; never NULL, as it would filter
    def one(key_: str) -> Column:
        return F.coalesce(F.length(key_) % 1, F.lit(0)).alias("_one")

    cut = F.broadcast(cut_off(rows, n, tie, digits).select("at", F.col("copies").alias("_copies"), one("at._key")))
    placed = rows.withColumn("_one", one("_key")).join(cut, "_one", "left")
    place = F.struct("_key", *tie)
    equal = F.coalesce(F.col("_in") & (place == F.col("at")), F.lit(False))
    below = F.col("_in") & F.coalesce(place < F.col("at"), F.lit(True))
    outer = placed.filter(~equal).select(*df.columns, below.alias(flag))

    contents = placed.filter(equal).groupBy(*df.columns, "_copies").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy(*df.columns).rowsBetween(Window.unboundedPreceding, -1))
    blocks = contents.withColumn("_before", F.coalesce(before, F.lit(0))).withColumn("_block", F.explode(F.expr(f"sequence(0, (_n - 1) div {COPIES})")))
    copy = F.explode(F.expr(f"sequence(_block * {COPIES} + 1, least((_block + 1) * {COPIES}, _n))"))
    inner = blocks.repartition("_block").withColumn("_copy", copy).select(*df.columns, (F.col("_before") + F.col("_copy") <= F.col("_copies")).alias(flag))
    return outer.unionByName(inner)
