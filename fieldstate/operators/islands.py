"""Gaps and islands: ids for runs of consecutive rows, one helper for all operators.

Every window here is keyed by a series (site, or site and category) whose rows are distinct days, so a group is
bounded by the calendar and not by the number of images.
"""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def ordered(keys: list[str], order: list[str | Column]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order)


def running(window: WindowSpec) -> WindowSpec:
    return window.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def run_start(present: Column, window: WindowSpec) -> Column:
    """True on the first row of each run of present rows."""
    return present & ~F.coalesce(F.lag(present).over(window), F.lit(False))


def run_id(start: Column, present: Column, window: WindowSpec) -> Column:
    """1, 2, ... per run, from a stored start flag; NULL on absent rows."""
    count = F.sum(F.when(start, 1).otherwise(0)).over(running(window))
    return F.when(present, count)
