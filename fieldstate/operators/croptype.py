"""Crop type per growing segment, and the final daily table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldstate import schema as S
from fieldstate.functions import vectors as V
from fieldstate.operators import islands as I

SEGMENT = ["phenocam_name", "crop_sequence_id"]
VOTED = S.CLASSES["crop_type"][2:]  # without blurry and unknown_plant
SCALE = 1 << 40  # probabilities are summed as whole numbers of this part, so the order of summation decides nothing


def pivot_states(hmm: DataFrame) -> DataFrame:
    """(phenocam_name, date, dominant_cover, crop_status) from (…, category, hmm_class) rows."""
    return hmm.groupBy("phenocam_name", "date").pivot("category", list(S.HMM_MODELS)).agg(F.max("hmm_class"))


def crop_segments(hmm: DataFrame) -> DataFrame:
    """(phenocam_name, date, crop_sequence_id, crop_status) of the days with a crop."""
    crop_days = pivot_states(hmm).filter(F.col("crop_status") != "no_crop")
    window = I.ordered(["phenocam_name"], ["date"])
    jump = F.coalesce((F.datediff("date", F.lag("date").over(window)) != 1).cast("int"), F.lit(0))
    return (
        crop_days.withColumn("_jump", jump)
        .withColumn("crop_sequence_id", F.sum("_jump").over(I.running(window)))
        .select("phenocam_name", "date", "crop_sequence_id", "crop_status")
    )


def exact_sql(p: str) -> str:
    """A probability as a whole number."""
    return f"cast(round({p} * {SCALE}) as bigint)"


def segment_class_votes(type_probs: DataFrame, segments: DataFrame) -> DataFrame:
    """Total probability per segment and class, unknown_plant left out."""
    sums = [F.expr(f"sum({exact_sql(f'get(probabilities, {i + 1})')}) / {SCALE}.0D AS `{name}`") for i, name in enumerate(VOTED)]
    totals = (
        type_probs.select("phenocam_name", "date", "probabilities")
        .join(segments.select("phenocam_name", "date", "crop_sequence_id"), ["phenocam_name", "date"])
        .groupBy(*SEGMENT)
        .agg(*sums)
    )
    classes = ", ".join(f"named_struct('crop_class', {V.quoted(n)}, 'total_probability', `{n}`)" for n in VOTED)
    return totals.selectExpr(*SEGMENT, f"inline(array({classes}))")


def vote_crop_type(type_probs: DataFrame, segments: DataFrame) -> DataFrame:
    """The class with the highest total per segment, the lowest class code on a tie.

    ``type_probs`` has a row per site and day with ``probabilities`` (crop types without blurry).
    """
    votes = segment_class_votes(type_probs, segments)
    rank = F.array_position(F.array(*[F.lit(n) for n in VOTED]), F.col("crop_class"))
    best = F.max(F.struct("total_probability", (-rank).alias("rank"), "crop_class")).alias("best")
    return votes.groupBy(*SEGMENT).agg(best).select(*SEGMENT, "best.crop_class", "best.total_probability")


def vote_uniqueness_check(type_probs: DataFrame, segments: DataFrame) -> DataFrame:
    """Segments whose highest total is shared by several classes: (…, n)."""
    votes = segment_class_votes(type_probs, segments)
    rank = F.rank().over(Window.partitionBy(*SEGMENT).orderBy(F.desc("total_probability")))
    top = votes.withColumn("_rank", rank).filter(F.col("_rank") == 1)
    return top.groupBy(*SEGMENT).agg(F.count("*").alias("n")).filter(F.col("n") > 1)


def segment_mode_status(segments: DataFrame) -> DataFrame:
    """(…, most_common_status, n_days); the alphabetically first status on a tie."""
    return segments.groupBy(*SEGMENT).agg(
        F.mode("crop_status", deterministic=True).alias("most_common_status"), F.count("*").alias("n_days")
    )


def resolved_type(voted: Column, status: Column, days: Column, max_days: int) -> Column:
    unknown = ((status == "emergence") & (days <= max_days)) | (voted == "no_crop")
    return F.when(voted.isNotNull(), F.when(unknown, "unknown_plant").otherwise(voted))


def unknown_rules(votes: DataFrame, modes: DataFrame, max_days: int = S.UNKNOWN_CROP_MAX_DAYS) -> DataFrame:
    """Votes with unknown_plant for short emergence-dominated segments and for segments voted no_crop."""
    crop_class = resolved_type(F.col("crop_class"), F.col("most_common_status"), F.col("n_days"), max_days)
    return votes.join(modes, SEGMENT, "left").select(*SEGMENT, crop_class.alias("crop_class"), "total_probability")


def final_predictions(hmm: DataFrame, segments: DataFrame, votes: DataFrame) -> DataFrame:
    """(phenocam_name, year, date, dominant_cover, crop_status, crop_type) from stored stage tables.

    ``votes`` are the votes after :func:`unknown_rules`.
    """
    types = segments.join(votes, SEGMENT, "left").select("phenocam_name", "date", "crop_class")
    days = pivot_states(hmm).join(types, ["phenocam_name", "date"], "left")
    crop_type = F.when(F.col("crop_status") == "no_crop", "no_crop").otherwise(F.col("crop_class"))
    return days.select(
        "phenocam_name", F.year("date").alias("year"), "date", "dominant_cover", "crop_status", crop_type.alias("crop_type")
    )
