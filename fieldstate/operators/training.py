"""Training-set preparation: labels, splits, weights, resampling and targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldstate import schema as S
from fieldstate.functions import keys as K
from fieldstate.operators import sampling

LABELS = ("dominant_cover", "crop_type", "crop_status")
BUCKET_DIGITS = 3    # hex digits: 4,096 parts of a label combination
SLOTS = 4096         # position slots of a combination
DRAWS = 100_000      # draws made by one row


def _combo(cols: tuple[str, ...]) -> Column:
    """A label combination as one text; NULL differs from every code."""
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in cols])


def _per_combo(counts: DataFrame, cols: tuple[str, ...], value: str) -> Column:
    """Value of a row's label combination, from one map with an entry per combination.

    Combinations are bounded by the class dictionary (a few hundred), so the map is small however many images there are,
    and images are not shuffled by a key of which a few values hold most rows.
    """
    table = counts.agg(F.map_from_entries(F.collect_list(F.struct(_combo(cols).alias("combo"), F.col(value).alias("value")))).alias("m"))
    return F.try_element_at(table.scalar(), _combo(cols))


def merge_annotations(session: DataFrame, redo: DataFrame) -> DataFrame:
    """Combine the first annotation session with the redone crop types, resolving disagreements.

    The rules are tried in order. An annotated growth stage with a redone "no crop" becomes an unknown plant; a
    first-session blurry or no-crop status decides the type; an old no-crop type beats a redone blurry one.
    """
    status, old, new = F.col("crop_status"), F.col("crop_type"), F.col("crop_type_new")
    stages = [S.code("crop_status", c) for c in ("emergence", "growth", "flowers", "senescing", "senesced")]
    no_crop = S.code("crop_type", "no_crop")
    old_no_crop = 6  # fixed value: code of "no crop" in the first session, which had one class less
    merged = (
        F.when(status.isin(*stages) & (new == no_crop), S.code("crop_type", "unknown_plant"))
        .when(status == S.code("crop_status", "blurry"), S.code("crop_type", "blurry"))
        .when(status == S.code("crop_status", "no_crop"), no_crop)
        .when((old == old_no_crop) & (new == S.code("crop_type", "blurry")), no_crop)
        .otherwise(new)
    )
    redone = redo.select("file", F.col("crop_type").alias("crop_type_new"))
    return session.join(redone, "file", "left").select("file", "crop_status", merged.alias("crop_type"), "dominant_cover", "time")


def drop_annotated_extras(extra: DataFrame, annotated: DataFrame) -> DataFrame:
    return extra.join(annotated.select(F.col("file").alias("filename")), "filename", "left_anti")


def keep_available_extras(extra: DataFrame, files: DataFrame) -> DataFrame:
    return extra.join(files.select(F.col("file").alias("filename")), "filename", "left_semi")


def drop_rare_combos(df: DataFrame, cols: tuple[str, ...] = LABELS, min_n: int = S.MIN_COMBO_IMAGES) -> DataFrame:
    """Keep rows whose label combination occurs at least ``min_n`` times.

    Counted by partial aggregation, so a combination that holds most rows is no hot task.
    """
    return df.filter(_per_combo(df.groupBy(*cols).count(), cols, "count") >= min_n)


def propagate_labels(annotated: DataFrame, extra: DataFrame) -> DataFrame:
    """Give extra images the labels of their site and day, and unite them with the annotated images.

    Both inputs have (filename, phenocam_name, date). A day with two annotations gives two rows per extra image.
    Rows without a cover label are dropped from the extra images only.
    """
    day = ("phenocam_name", "date")
    labels = annotated.filter(F.col("dominant_cover").isNotNull()).select(*day, *LABELS)
    columns = ("filename", *day, *LABELS)
    return annotated.select(*columns).unionByName(extra.select("filename", *day).join(labels, list(day)).select(*columns))


def holdout_split(
    df: DataFrame,
    site_regex: str = S.VALIDATION_SITES,
    fraction: float = S.VALIDATION_FRACTION,
    seed: int = sampling.SEED,
) -> DataFrame:
    """Add ``is_validation``: all images of held-out sites, filled up at random to ``int(rows * fraction)``.

    ``site_regex`` is searched anywhere in the site name. Rows are split, not names: of an image listed twice one row may
    be on either side.
    """
    held = df.withColumn("_held", F.coalesce(F.col("phenocam_name").rlike(site_regex), F.lit(False)))
    # rows that do not take part are the held-out ones, which count against the wanted number
    wanted = F.floor(F.col("all_rows") * F.lit(fraction)) - (F.col("all_rows") - F.col("all_taking"))
    drawn = sampling.take_exactly(held, wanted, K.sample_key("filename", seed), ["filename"], "_drawn", among="NOT _held")
    return drawn.withColumn("is_validation", F.col("_held") | F.col("_drawn")).drop("_held", "_drawn")


def balanced_weights(df: DataFrame, cols: tuple[str, ...] = LABELS) -> DataFrame:
    """Add sample_weight = rows / (combinations * rows of this combination)."""
    counts = df.groupBy(*cols).agg(F.count("*").alias("n"))
    every = Window.partitionBy()  # one row per label combination
    weight = F.sum("n").over(every) / (F.count("*").over(every) * F.col("n"))
    return df.withColumn("sample_weight", _per_combo(counts.withColumn("sample_weight", weight), cols, "sample_weight"))


def resample_balanced(
    df: DataFrame,
    cols: tuple[str, ...] = LABELS,
    n: int = S.RESAMPLE_SIZE,
    seed: int = sampling.SEED,
    identity: str = "filename",
) -> DataFrame:
    """``n`` rows drawn with replacement so that every label combination is equally likely: + ``draw`` (0..n-1).

    A draw picks a combination and a position in it from its own hash. Rows are shuffled once, by combination and key
    prefix; that exchange serves the counts per prefix, which say where each prefix begins within its combination, and the
    numbering of rows inside a prefix. Positions find their prefix by an equi-join on slots of fixed width, so neither rows nor
    draws of a combination ever meet in one task.
    """
    cols, names = list(cols), df.columns
    shuffled = df.withColumns({"_combo": _combo(cols), "_bucket": F.substring(K.sample_key(identity, seed), 1, BUCKET_DIGITS)})
    shuffled = shuffled.repartition("_combo", "_bucket")
    # the checksum reads every column: the counts then need the same exchange as the rows, which is computed once
    counts = shuffled.groupBy("_combo", "_bucket").agg(
        F.count("*").alias("rows"), F.min(F.struct(*cols)).alias("labels"), F.bit_xor(F.xxhash64(*names)).alias("checksum")
    )
    counts = counts.filter("checksum IS NOT NULL")
    # at most 16 ** BUCKET_DIGITS rows per combination from here on; combinations are bounded by the class dictionary
    per_combo = Window.partitionBy("_combo")
    upto, width = F.sum("rows").over(per_combo.orderBy("_bucket")), F.expr(f"n_rows div {SLOTS} + 1")
    spans = counts.select("_combo", "_bucket", (upto - F.col("rows")).alias("first"), upto.alias("end"), F.sum("rows").over(per_combo).alias("n_rows"))
    spans = spans.withColumn("width", width)
    combos = counts.groupBy("_combo").agg(F.sum("rows").alias("n_rows"), F.min("labels").alias("labels")).withColumn("width", width)
    slots = F.explode(F.expr("sequence(first div width, (end - 1) div width)"))

    # one row with all combinations, in order, gives the draws in blocks
    every = combos.agg(F.array_sort(F.collect_list(F.struct("labels", "_combo", "n_rows", "width"))).alias("combos")).filter("size(combos) > 0")
    blocks = every.withColumn("block", F.explode(F.expr(f"sequence(0, {(n - 1) // DRAWS})"))).repartition("block") if n > 0 else every.limit(0).withColumn("block", F.lit(0))
    draw_key = K.sample_key("draw", seed)
    draws = (
        blocks.withColumn("draw", F.explode(F.expr(f"sequence(block * {DRAWS}L, least((block + 1) * {DRAWS}L, {n}L) - 1)")))
        .withColumn("c", F.get("combos", (K.hex_int(draw_key, 1, 8) % F.size("combos")).cast("int")))
        .select("draw", "c._combo", "c.width", (K.hex_int(draw_key, 9, 13) % F.col("c.n_rows")).alias("position"))
        .withColumn("slot", F.expr("position div width"))
    )
    placed = (
        draws.join(spans.select("_combo", "_bucket", "first", "end", slots.alias("slot")), ["_combo", "slot"])
        .filter("position >= first AND position < end")
        .select("_combo", "_bucket", (F.col("position") - F.col("first")).alias("_local"), "draw")
    )
    inside = Window.partitionBy("_combo", "_bucket").orderBy(K.sample_key(identity, seed), identity)
    rows = shuffled.withColumn("_local", (F.row_number().over(inside) - 1).cast("bigint"))
    return rows.join(placed, ["_combo", "_bucket", "_local"]).select(*names, "draw")


def one_hot_targets(df: DataFrame, widths: dict[str, int] = S.WIDTHS) -> DataFrame:
    """Add ``target``: the one-hot codes of all categories, end to end."""
    bits = [(F.col(c) == k).cast("int") for c, width in widths.items() for k in range(width)]
    return df.withColumn("target", F.array(*bits))


def split_targets(df: DataFrame, widths: dict[str, int] = S.WIDTHS) -> DataFrame:
    """Cut ``target`` back into one array per category, named ``<category>_target``."""
    start, parts = 1, []
    for category, width in widths.items():
        parts.append(F.slice("target", start, width).alias(f"{category}_target"))
        start += width
    return df.select("*", *parts)


def _cutoffs(height_cutoff: float) -> list[float]:
    """Share of the image cut away from the top, relaxed in steps of 0.1 until nothing is cut."""
    share, steps = 1 - height_cutoff, []
    while True:
        steps.append(share)
        if share <= 0:
            return steps
        share -= 0.1


def _trim(crop_dim: int, height_cutoff: float) -> Column:
    height = F.col("height")
    cuts = [F.greatest(F.floor(height * F.lit(c)).cast("int"), F.lit(0)) for c in _cutoffs(height_cutoff)]
    return F.coalesce(*[F.when(height - cut >= crop_dim, cut) for cut in cuts])


def _crop_room(crop_dim: int, height_cutoff: float) -> tuple[Column, Column, Column]:
    trim = _trim(crop_dim, height_cutoff)
    # origins are drawn from 1 up to, not including, size - crop_dim
    return trim, F.col("height") - trim - crop_dim - 1, F.col("width") - crop_dim - 1


def crop_plan(
    meta: DataFrame, n: int, crop_dim: int, height_cutoff: float = 0.5, seed: int = sampling.SEED
) -> DataFrame:
    """``n`` random square boxes per image (file, height, width, labels...) from its lower part: + i, y0, x0.

    ``y0`` counts from the top of the whole image. Images without room for a box are left out here and
    returned by :func:`crop_plan_violations`.
    """
    if not 0 < height_cutoff <= 1:
        raise ValueError("height_cutoff must be above 0 and at most 1")
    trim, room_y, room_x = _crop_room(crop_dim, height_cutoff)
    key = K.sample_key(F.concat_ws("#", "file", F.col("i").cast("string")), seed)
    return (
        meta.withColumn("_trim", trim).withColumn("_y", room_y).withColumn("_x", room_x)
        .filter((F.col("_y") > 0) & (F.col("_x") > 0))
        .withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        .withColumn("y0", (F.col("_trim") + 1 + K.hex_int(key, 1, 8) % F.col("_y")).cast("int"))
        .withColumn("x0", (1 + K.hex_int(key, 9, 8) % F.col("_x")).cast("int"))
        .drop("_trim", "_y", "_x")
    )


def crop_plan_violations(meta: DataFrame, crop_dim: int, height_cutoff: float = 0.5) -> DataFrame:
    _, room_y, room_x = _crop_room(crop_dim, height_cutoff)
    return meta.filter(~F.coalesce((room_y > 0) & (room_x > 0), F.lit(False)))
