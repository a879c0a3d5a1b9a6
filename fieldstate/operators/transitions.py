"""Dates at which a field changes state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from fieldstate import schema as S
from fieldstate.functions import vectors as V
from fieldstate.operators import islands as I


def state_transitions(final: DataFrame, signatures: tuple[tuple[str, str, str, str], ...] = S.TRANSITION_SIGNATURES) -> DataFrame:
    """(phenocam_name, year, date, category, class, prior_day_class, transition, doy).

    A transition needs a row for the calendar day before; a previous row further back does not count. Each
    signature is (category, class of the day before, class, name) over the columns of the daily table.
    """
    window = I.ordered(["phenocam_name"], ["date"])
    used = sorted({c for c, *_ in signatures})
    adjacent = F.datediff("date", F.lag("date").over(window)) == 1
    prior = {f"_prior_{c}": F.when(adjacent, F.lag(c).over(window)) for c in used}
    days = final.select("phenocam_name", "date", *used).withColumns(prior)
    hits = ", ".join(
        f"CASE WHEN _prior_{c} = {V.quoted(before)} AND {c} = {V.quoted(after)} THEN named_struct('category', '{c}', "
        f"'class', {V.quoted(after)}, 'prior_day_class', {V.quoted(before)}, 'transition', {V.quoted(name)}) END"
        for c, before, after, name in signatures
    )
    return days.selectExpr(
        "phenocam_name", "year(date) AS year", "date", f"inline(array_compact(array({hits})))"
    ).withColumn("doy", F.dayofyear("date"))


def mean_change(value: Column | str, window: WindowSpec, width: int) -> Column:
    """Mean after the row minus mean before it, over a centred window of odd ``width``; the row itself is left out.

    NULL unless every row of both halves is there and has a value.
    """
    if width < 5 or width % 2 == 0:
        raise ValueError("the window must be odd and at least 5 rows wide")
    half = width // 2
    value = F.col(value) if isinstance(value, str) else value
    first, second = window.rowsBetween(-half, -1), window.rowsBetween(1, half)
    complete = (F.count(value).over(first) == half) & (F.count(value).over(second) == half)
    return F.when(complete, F.avg(value).over(second) - F.avg(value).over(first))


def harvest_detect(
    daily: DataFrame,
    width: int = S.HARVEST_WINDOW,
    vegetation: float = S.HARVEST_VEGETATION,
    soil_residue: float = S.HARVEST_SOIL_RESIDUE,
) -> DataFrame:
    """Add transition_harvest: vegetation falls while soil and residue together rise (rows of a site, by date).

    The window runs over rows; at the ends of a series and beside missing values the answer is false.
    """
    window = I.ordered(["phenocam_name"], ["date"])
    cover = {name: V.element("dominant_cover", S.code("dominant_cover", name)) for name in ("vegetation", "soil", "residue")}
    rows = daily.withColumn("_veg", cover["vegetation"]).withColumn("_bare", cover["soil"] + cover["residue"])
    falls = mean_change("_veg", window, width) <= vegetation
    rises = mean_change("_bare", window, width) >= soil_residue
    return rows.withColumn("transition_harvest", F.coalesce(falls & rises, F.lit(False))).drop("_veg", "_bare")
