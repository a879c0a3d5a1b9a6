"""Scored images to the final daily table in one plan.

The stage operators in :mod:`fieldstate.operators` work on stored tables. Run back to back they would compute the
cleaned series once per consumer and shuffle between stages. Here everything after the daily reduction stays in one
partitioning by site: cleaning, decoding, segments, votes and the final columns add no further exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldstate import schema as S
from fieldstate.functions import vectors as V
from fieldstate.operators import croptype, hmm, series

SITE = "phenocam_name"
VOTES = range(len(croptype.VOTED))
GROWING = tuple(sorted(s for s in S.STATUS_STATES if s != "no_crop"))


def _decoded_days(prepared: DataFrame) -> DataFrame:
    """One row per site and day: both decoded states and the crop-type votes of the day."""
    stacked = series.stack_sequences(prepared, S.CATEGORIES)
    packed = stacked.groupBy(*hmm.KEYS).agg(F.array_sort(F.collect_list(F.struct("date", "probabilities"))).alias("days"))
    voting = "category = 'crop_type'"
    flat = F.expr(f"CASE WHEN {voting} THEN array() ELSE flatten(days.probabilities) END")
    path = f"CASE WHEN {voting} THEN array() ELSE path END AS state"
    votes = f"CASE WHEN {voting} THEN days.probabilities ELSE array() END AS vote"
    decoded = packed.withColumn("path", hmm.sequence_decoder()("category", flat))
    # the packed sequences, a fraction of the days, are what is brought back to one place per site: paths, and votes of crop types.
    # The days of a sequence follow each other, so its ends name them; should they not, they go along.
    first, last = "array_min(days.date)", "array_max(days.date)"
    listed = f"CASE WHEN NOT (days.date <=> sequence({first}, {last})) THEN days.date END AS _listed"
    decoded = decoded.selectExpr(SITE, "category", f"{first} AS _from", f"{last} AS _to", listed, path, votes).repartition(SITE)
    decoded = decoded.selectExpr(SITE, "category", "coalesce(_listed, sequence(_from, _to)) AS date", "state", "vote")
    rows = decoded.selectExpr(SITE, "category", "inline(arrays_zip(date, state, vote))")
    states = [
        F.expr(f"max(state) FILTER (WHERE category = '{c}') AS _{c}") for c in S.HMM_MODELS
    ]
    shares = [F.expr(f"max(get(vote, {k + 1})) AS _v{k}") for k in VOTES]
    return rows.groupBy(SITE, "date").agg(*states, *shares).filter(" OR ".join(f"_{c} IS NOT NULL" for c in S.HMM_MODELS))


def final_table(prepared: DataFrame, max_days: int = S.UNKNOWN_CROP_MAX_DAYS) -> DataFrame:
    """Output of ``prep_for_hmm`` -> (phenocam_name, year, date, dominant_cover, crop_status, crop_type)."""
    names = [f"{V.name_sql(hmm.hmm_spec(c)[0], f'_{c}')} AS {c}" for c in S.HMM_MODELS]
    days = _decoded_days(prepared).selectExpr(SITE, "date", *names, *[f"_v{k}" for k in VOTES])

    # growing segments: crop days without a missing day between them
    crop = "coalesce(crop_status <> 'no_crop', false)"
    previous = f"last(CASE WHEN {crop} THEN date END, true) OVER ({series.BY_DATE} {series.BEFORE})"
    days = days.selectExpr("*", f"CASE WHEN {crop} AND datediff(date, {previous}) <> 1 THEN 1 ELSE 0 END AS _jump")
    days = days.selectExpr("*", f"CASE WHEN {crop} THEN sum(_jump) OVER ({series.BY_DATE} {series.UPTO}) END AS _segment")

    # per segment: total probability per class, days per status
    segment = f"OVER (PARTITION BY {SITE}, _segment)"
    totals = [f"_t{k}" for k in VOTES]
    counts = [f"_c{i}" for i in range(len(GROWING))]
    days = days.selectExpr(
        SITE, "date", *S.HMM_MODELS, "_segment",
        *[f"sum({croptype.exact_sql(f'_v{k}')}) {segment} AS _t{k}" for k in VOTES],
        *[f"count_if(crop_status = '{s}') {segment} AS {c}" for s, c in zip(GROWING, counts)],
    )

    def first_of(values: list[str], names: tuple[str, ...]) -> Column:
        best = f"greatest({', '.join(values)})"
        return F.expr("CASE " + " ".join(f"WHEN {v} = {best} THEN {V.quoted(n)}" for v, n in zip(values, names)) + " END")

    crop_type = F.when(F.col("crop_status") == "no_crop", "no_crop").when(
        F.col("_segment").isNotNull(),
        croptype.resolved_type(
            first_of(totals, croptype.VOTED), first_of(counts, GROWING), F.expr(" + ".join(counts)), max_days
        ),
    )
    return days.select(SITE, F.year("date").alias("year"), "date", "dominant_cover", "crop_status", crop_type.alias("crop_type"))


def field_states(pred: DataFrame, extra_folder: str, **options) -> DataFrame:
    """Scored images (filepath, file, 3 vectors) -> final daily table.

    Images whose name holds no date are left out; ``checks.undated_files`` lists them.
    """
    return final_table(series.prep_for_hmm(pred, extra_folder, **options))
