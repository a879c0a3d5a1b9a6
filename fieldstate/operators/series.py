"""Cleaning of class-probability series.

Input is wide: (phenocam_name, date, [file,] dominant_cover, crop_type, crop_status) with one probability vector per
category. Masks and renormalisation touch one row at a time. Operators that look along time come in two forms:

* ``*_daily``: one row per site and day. Windows are keyed by site; a site has one row per calendar day, so the group
  is bounded by the length of the calendar and not by the number of images. Used by the pipelines, one shuffle by site.
* general: any number of images per day. Images are grouped by (site, day) only, and what must be carried from day to
  day goes through a per-day summary, so a site that holds most of the images is spread over its days.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldstate import schema as S
from fieldstate.functions import names as N
from fieldstate.functions import vectors as V
from fieldstate.operators import islands as I

SITE = "phenocam_name"
CROP = ("crop_type", "crop_status")

# windows along a site's calendar
BY_DATE = f"PARTITION BY {SITE} ORDER BY date"
BY_DATE_DESC = f"{BY_DATE} DESC"
BEFORE = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
UPTO = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"


# ---- exchange forms ------------------------------------------------------------------------------------
def from_class_columns(df: DataFrame) -> DataFrame:
    """Flat form (one column per class) -> vectors; a category without any value becomes NULL."""
    flat = {c: [F.col(f"`{name}`") for name in S.class_columns(c)] for c in S.CATEGORIES}
    rest = [c for c in df.columns if c not in {n for k in S.CATEGORIES for n in S.class_columns(k)}]
    vectors = [F.when(F.coalesce(*flat[c]).isNotNull(), F.array(*flat[c])).alias(c) for c in S.CATEGORIES]
    return df.select(*[F.col(f"`{c}`") for c in rest], *vectors)


def to_class_columns(df: DataFrame, categories: Iterable[str] = S.CATEGORIES) -> DataFrame:
    """Vectors -> flat form with columns named ``category-class``."""
    categories = list(categories)
    flat = [V.element(c, k).alias(name) for c in categories for k, name in enumerate(S.class_columns(c))]
    return df.select(*[c for c in df.columns if c not in categories], *flat)


def long_rows_sql(classes: dict[str, tuple[str, ...]]) -> str:
    """Array of (category, class, probability) structs of a wide row."""
    structs = [
        f"named_struct('category', '{c}', 'class', {V.quoted(name)}, 'probability', {V.element_sql(c, k)})"
        for c, names in classes.items()
        for k, name in enumerate(names)
    ]
    return f"array({', '.join(structs)})"


def wide_to_long(df: DataFrame, classes: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """One row per class: (..., category, class, probability). ``classes`` names the vector elements."""
    classes = classes or S.CLASSES
    rest = [c for c in df.columns if c not in classes]
    return df.selectExpr(*rest, f"inline({long_rows_sql(classes)})")


def long_to_wide(obs: DataFrame, keys: list[str]) -> DataFrame:
    """Long rows -> one row per key with vectors."""
    flat = [
        F.expr(f"max(probability) FILTER (WHERE category = '{c}' AND class = {V.quoted(name)})").alias(f"{c}-{name}")
        for c in S.CATEGORIES
        for name in S.CLASSES[c]
    ]
    return from_class_columns(obs.groupBy(*keys).agg(*flat))


# ---- narrow form for shuffles --------------------------------------------------------------------------
CODES, KEPT = "_codes", "_kept"


def _vectors(df: DataFrame) -> list[str]:
    return [c for c in S.CATEGORIES if c in df.columns]


def packed(df: DataFrame) -> DataFrame:
    """The vectors as 16-bit codes, half of a row or less; rows with values of more digits keep their vectors besides.

    Nothing is lost, and ``CODES, KEPT`` order rows as the vectors do. All vectors share a column, so uses of different
    categories ask one exchange for the same rows.
    """
    vectors = _vectors(df)
    if not vectors:
        return df
    rest = [c for c in df.columns if c not in vectors]
    even = df.select("*", *[F.expr(V.even_codes_sql(c)).alias(f"_e_{c}") for c in vectors])
    exact = " AND ".join(f"({V.decoded_sql(f'_e_{c}')} <=> {c})" for c in vectors)
    # the rest of the way is taken by rows with other values only
    coded = even.select("*", F.expr(exact).alias("_exact"))
    coded = coded.select("*", *[F.expr(f"CASE WHEN NOT _exact THEN {V.codes_sql(c)} END AS _c_{c}") for c in vectors])
    odd = coded.select("*", *[F.expr(V.first_odd_sql(f"_c_{c}")).alias(f"_o_{c}") for c in vectors])
    cases = [f"WHEN _exact THEN array({', '.join(f'_e_{c}' for c in vectors)})"]
    for i, c in enumerate(vectors):
        upto = ", ".join([*(f"_c_{v}" for v in vectors[:i]), f"slice(_c_{c}, 1, _o_{c})"])
        cases.append(f"WHEN _o_{c} > 0 THEN array({upto})")
    codes = f"CASE {' '.join(cases)} ELSE array({', '.join(f'_c_{c}' for c in vectors)}) END AS {CODES}"
    kept = f"CASE WHEN {' OR '.join(f'_o_{c} > 0' for c in vectors)} THEN array({', '.join(vectors)}) END AS {KEPT}"
    return odd.select(*[F.col(f"`{c}`") for c in rest], F.expr(codes), F.expr(kept))


def unpacked(df: DataFrame, vectors: Iterable[str] = S.CATEGORIES) -> DataFrame:
    """The rows of :func:`packed` with their vectors."""
    if CODES not in df.columns:
        return df
    back = [
        F.expr(f"CASE WHEN {KEPT} IS NOT NULL THEN get({KEPT}, {i}) ELSE {V.decoded_sql(f'get({CODES}, {i})')} END AS {c}")
        for i, c in enumerate(vectors)
    ]
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in (CODES, KEPT)], *back)


def unpacked_class(df: DataFrame, category: str, k: int, vectors: tuple[str, ...] = S.CATEGORIES) -> DataFrame:
    """The rows of :func:`packed` with one class only: a vector of one element."""
    i = vectors.index(category)
    code, kept = (V.element_sql(f"get({column}, {i})", k) for column in (CODES, KEPT))
    value = f"CASE WHEN {KEPT} IS NOT NULL THEN {kept} ELSE {V.decoded_one_sql(code)} END"
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in (CODES, KEPT)], F.expr(f"array({value})").alias(category))


# ---- selection of images -------------------------------------------------------------------------------
def drop_extra_and_dups(pred: DataFrame, folder: str) -> DataFrame:
    """Drop images of the extra folder, blank the path, drop rows that are then equal."""
    return pred.filter(~F.contains("filepath", F.lit(folder))).withColumn("filepath", F.lit("")).distinct()


def first_image_per_day(df: DataFrame) -> DataFrame:
    """One image per site and day: the first by file name.

    The rank filter is applied per task before the shuffle, so a day's images are cut down where they are read. Rows are
    sorted and shuffled with packed vectors.
    """
    return unpacked(_first_of_day(packed(df)), _vectors(df)).select(*df.columns)


def _first_of_day(rows: DataFrame) -> DataFrame:
    order = ["file", *[c for c in (CODES, KEPT) if c in rows.columns]]
    rank = F.row_number().over(Window.partitionBy(SITE, "date").orderBy(*order))
    return rows.withColumn("_rank", rank).filter(F.col("_rank") == 1).drop("_rank")


# ---- masks ---------------------------------------------------------------------------------------------
def _cover_is(name: str) -> Column:
    """The image's top cover is ``name``."""
    return V.top_is("dominant_cover", S.WIDTHS["dominant_cover"], S.code("dominant_cover", name))


def _day_cover_is(name: str) -> Column:
    """The highest cover probability among all images of the day belongs to ``name``."""
    day = f"OVER (PARTITION BY {SITE}, date)"
    own = V.element_sql("dominant_cover", S.code("dominant_cover", name))
    best = ", ".join(V.elements_sql("dominant_cover", S.WIDTHS["dominant_cover"]))
    return F.expr(f"coalesce(max({own}) {day} >= max(greatest({best})) {day}, false)")


def _masked(df: DataFrame, hit: Column, categories: Iterable[str]) -> DataFrame:
    return df.withColumns({c: F.when(~hit, F.col(c)) for c in categories})


def mask_snow_days(df: DataFrame) -> DataFrame:
    """NULL crop_type and crop_status on days whose top cover is snow (ties count)."""
    return _masked(df.withColumn("_hit", _day_cover_is("snow")), F.col("_hit"), CROP).drop("_hit")


def mask_snow_daily(df: DataFrame) -> DataFrame:
    """:func:`mask_snow_days` for one row per day: row-local."""
    return _masked(df, _cover_is("snow"), CROP)


def mask_blurry_days(df: DataFrame) -> DataFrame:
    """NULL all categories on days whose top cover is blurry (ties count)."""
    return _masked(df.withColumn("_hit", _day_cover_is("blurry")), F.col("_hit"), S.CATEGORIES).drop("_hit")


def mask_blurry_daily(df: DataFrame) -> DataFrame:
    """:func:`mask_blurry_days` for one row per day: row-local."""
    return _masked(df, _cover_is("blurry"), S.CATEGORIES)


def drop_blurry_renorm(df: DataFrame) -> DataFrame:
    """Remove the blurry element and scale the others to sum 1; NULL if the sum is 0 or an element is NULL."""
    totals = df.withColumns({f"_total_{c}": F.expr(V.total_sql(c, width, 1)) for c, width in S.WIDTHS.items()})
    scaled = {c: V.renormalised(c, width, 1, f"_total_{c}") for c, width in S.WIDTHS.items()}
    return totals.select(*[scaled[c].alias(c) if c in scaled else F.col(f"`{c}`") for c in df.columns])


# ---- calendar ------------------------------------------------------------------------------------------
def fill_calendar(df: DataFrame) -> DataFrame:
    """Add a row for every missing day between a site's first and last image; its other columns are NULL.

    Only the distinct days are shuffled; the rows themselves stay where they are.
    """
    days = df.select(SITE, "date").distinct()
    following = F.lead("date").over(I.ordered([SITE], ["date"]))
    missing = (
        days.withColumn("_next", following)
        .filter(F.datediff("_next", "date") > 1)
        .select(SITE, F.explode(F.sequence(F.date_add("date", 1), F.date_sub("_next", 1))).alias("date"))
    )
    return df.unionByName(missing, allowMissingColumns=True).withColumn("year", F.year("date"))


def fill_calendar_daily(df: DataFrame) -> DataFrame:
    """:func:`fill_calendar` for one row per day: each row also emits the empty days up to the next one."""
    rest = [c for c in df.columns if c not in (SITE, "date", "year")]
    next_date = f"lead(date) OVER ({BY_DATE})"
    days = df.selectExpr(SITE, *rest, "date AS _from", f"coalesce(date_sub({next_date}, 1), date) AS _to")
    return days.selectExpr(*days.columns, "explode(sequence(_from, _to)) AS date").selectExpr(
        SITE, "date", "year(date) AS year", *[f"CASE WHEN date = _from THEN {c} END AS {c}" for c in rest]
    )


# ---- interpolation -------------------------------------------------------------------------------------
def _mark(c: str, at: str) -> str:
    """Position and vector of a present value, NULL otherwise."""
    return f"CASE WHEN {c} IS NOT NULL THEN named_struct('at', {at}, 'v', {c}) END"


def _last(value: str, window: str) -> str:
    """Last non-NULL value before the row, by a running frame."""
    return f"last({value}, true) OVER ({window} {BEFORE})"


def _next(value: str, window: str) -> str:
    """First non-NULL value after the row. It reads the order of :func:`_last`, so one sort serves both directions."""
    return f"lead({value}) IGNORE NULLS OVER ({window})"


def _bound(c: str, at: str, window: str) -> str:
    """The mark before the row, kept on gap rows only: what follows then moves narrow rows."""
    return f"CASE WHEN {c} IS NULL THEN {_last(_mark(c, at), window)} END"


def _bound_after(c: str, at: str, window: str) -> str:
    """The mark after the row, kept on gap rows only."""
    return f"CASE WHEN {c} IS NULL THEN {_next(_mark(c, at), window)} END"


def interpolate_daily(df: DataFrame, max_gap: int, by: str = "row") -> DataFrame:
    """Fill gaps of at most ``max_gap`` NULL vectors per category, one row per site and day.

    Distance is counted in rows (``by="row"``) or days (``by="date"``). Gaps at the ends stay NULL. The next value is an
    offset that skips NULLs, as a frame over following rows is recomputed per row, and one in reverse order sorts all rows again.
    """
    vectors = [c for c in S.CATEGORIES if c in df.columns]
    position = f"row_number() OVER ({BY_DATE})" if by == "row" else "unix_date(date)"
    rows = df.selectExpr("*", f"{position} AS _at")
    bounds = [f"{bound(c, '_at', BY_DATE)} AS _{s}_{c}" for c in vectors for s, bound in (("p", _bound), ("n", _bound_after))]
    rows = rows.selectExpr("*", *bounds)
    filled = {c: V.between(c, "_at", f"_p_{c}", f"_n_{c}", max_gap) for c in vectors}
    return rows.select(*[filled[c].alias(c) if c in filled else c for c in df.columns])


def interpolate_gaps(df: DataFrame, max_gap: int, by: str = "row", order: str = "file") -> DataFrame:
    """:func:`interpolate_daily` for any number of rows per day, ordered by date and ``order`` within the day.

    A segmented scan: rows are shuffled once, by (site, day), and each day is reduced to a one-row summary (row count, first
    and last vector), which is carried along the site's calendar and joined back. No task holds all images of a site.
    """
    return _segmented(df, max_gap, by, order)


def _segmented(df: DataFrame, max_gap: int, by: str = "row", order: str = "file", profile: bool = False) -> DataFrame:
    """Gap filling over days of several rows. With ``profile``, days missing from a site's calendar get a row first (which is a
    gap), and days whose top cover is blurry lose their values; both follow from the same summary of each day.
    """
    vectors = [c for c in S.CATEGORIES if c in df.columns]
    day = [SITE, "date"]
    in_day, in_day_desc = (f"PARTITION BY {SITE}, date ORDER BY {order}{d}" for d in ("", " DESC"))
    by_row = by == "row"
    # stated here, not only inferred from the join, so that summary and rows read one exchange
    rows = df.filter(f"{SITE} IS NOT NULL AND date IS NOT NULL").selectExpr("*", f"row_number() OVER ({in_day}) AS _row")

    # a day's first and last present row, as (row, vector)
    edges = [
        f"{f}_by({_mark(c, '_row')}, CASE WHEN {c} IS NOT NULL THEN _row END) AS _{name}_{c}"
        for c in vectors
        for f, name in (("min", "first"), ("max", "last"))
    ]
    cover = "dominant_cover"
    own, best = V.element_sql(cover, S.code(cover, "blurry")), ", ".join(V.elements_sql(cover, S.WIDTHS[cover]))
    blurry = f"coalesce(max({own}) >= max(greatest({best})), false) AS _blurry" if profile else "false AS _blurry"
    # the checksum reads every column, and the filter keeps it: the summary then needs the same exchange as the rows
    summary = rows.groupBy(*day).agg(
        F.expr("count(*) AS _rows"), *[F.expr(e) for e in edges], F.expr(blurry), F.bit_xor(F.xxhash64(*df.columns)).alias("_all")
    ).filter("_all IS NOT NULL")

    if profile:
        # days between this one and the next have a row of their own, counted before the next day's rows
        missing = f"coalesce(datediff(lead(date) OVER ({BY_DATE}), date) - 1, 0) AS _missing"
        summary = summary.selectExpr("*", missing)
        kept = [f"CASE WHEN NOT _blurry THEN _{name}_{c} END AS _{name}_{c}" for c in vectors for name in ("first", "last")]
        summary = summary.selectExpr(*day, "_rows", "_blurry", "_missing", *kept)
    offset = f"coalesce(sum(_rows{' + _missing' if profile else ''}) OVER ({BY_DATE} {BEFORE}), 0)" if by_row else "unix_date(date)"

    def placed(mark: str, at: str) -> str:
        """A mark at its position within the site instead of within the day."""
        return f"CASE WHEN {mark} IS NOT NULL THEN named_struct('at', {at}, 'v', {mark}.v) END"

    def in_site(mark: str) -> str:
        return placed(mark, f"_offset + {mark}.at" if by_row else "_offset")

    carried = summary.selectExpr("*", f"CAST({offset} AS BIGINT) AS _offset")
    carried = carried.selectExpr("*", *[f"{_last(in_site(f'_last_{c}'), BY_DATE)} AS _dp_{c}" for c in vectors])
    carried = carried.selectExpr("*", *[f"{_last(in_site(f'_first_{c}'), BY_DATE_DESC)} AS _dn_{c}" for c in vectors])

    mine = {c: c for c in vectors}
    if profile:
        rows = rows.join(carried.select(*day, "_blurry", "_offset", *[f"_d{s}_{c}" for s in "pn" for c in vectors]), day)
        rows = rows.selectExpr(*[f"CASE WHEN NOT _blurry THEN {c} END AS {c}" if c in mine else c for c in rows.columns])
    rows = rows.selectExpr("*", *[f"{_bound(c, '_row', in_day)} AS _lp_{c}" for c in vectors])
    rows = rows.selectExpr("*", *[f"{_bound(c, '_row', in_day_desc)} AS _ln_{c}" for c in vectors])
    if not profile:
        rows = rows.join(carried.select(*day, "_offset", *[f"_d{s}_{c}" for s in "pn" for c in vectors]), day)
    bounds = [f"coalesce({in_site(f'_l{s}_{c}')}, _d{s}_{c}) AS _{s}_{c}" for s in "pn" for c in vectors]
    rows = rows.selectExpr(*df.columns, f"_offset + {'_row' if by_row else '0'} AS _at", *bounds)
    if profile:
        # a missing day lies after all rows of the day before it: its previous value is that day's last, or an earlier one
        nulls = [f"CAST(NULL AS {t}) AS {c}" for c, t in df.dtypes if c not in day]
        step = "posexplode(sequence(date_add(date, 1), date_add(date, _missing))) AS (_k, _day)"
        held = [f"coalesce({in_site(f'_last_{c}')}, _dp_{c}) AS _p_{c}" for c in vectors] + [f"_dn_{c} AS _n_{c}" for c in vectors]
        empty = carried.filter("_missing > 0").selectExpr(SITE, "_offset", "_rows", *held, step)
        at = "_offset + _rows + _k + 1" if by_row else "CAST(unix_date(_day) AS BIGINT)"
        bound_names = [f"_{s}_{c}" for s in "pn" for c in vectors]
        rows = rows.unionByName(empty.selectExpr(SITE, "_day AS date", *nulls, f"{at} AS _at", *bound_names))
    filled = {c: V.between(c, "_at", f"_p_{c}", f"_n_{c}", max_gap) for c in vectors}
    return rows.select(*[filled[c].alias(c) if c in filled else c for c in df.columns])


def interpolate_long(obs: DataFrame, max_gap: int, keys: tuple[str, ...] = (SITE, "category", "class")) -> DataFrame:
    """Gap filling on long rows (one row per key and day), for series whose classes are missing independently."""
    series = f"PARTITION BY {', '.join(keys)} ORDER BY date"
    mark = _mark("probability", "_at")
    rows = obs.selectExpr("*", f"row_number() OVER ({series}) AS _at")
    rows = rows.selectExpr("*", f"{_last(mark, series)} AS _p", f"{_next(mark, series)} AS _n")
    span = "(_n.at - _p.at)"
    filled = (
        f"CASE WHEN probability IS NOT NULL THEN probability WHEN {span} - 1 <= {max_gap} "
        f"THEN _p.v + (_n.v - _p.v) * ((_at - _p.at) / {span}) END AS probability"
    )
    return rows.selectExpr(*[filled if c == "probability" else c for c in obs.columns])


# ---- sequences -----------------------------------------------------------------------------------------
def sequence_ids(df: DataFrame, categories: tuple[str, ...] | None = None) -> DataFrame:
    """Add ``<category>_seq`` (1, 2, ... per run of present days, else NULL) and ``<category>_days`` (its length).

    Needs one row per day of a filled calendar; :func:`fieldstate.operators.checks.sequence_violations` tests that.
    """
    categories = categories or tuple(c for c in S.CATEGORIES if c in df.columns)

    def edge(c: str, neighbour: str) -> str:
        return f"{c} IS NOT NULL AND coalesce({neighbour}({c} IS NULL) OVER ({BY_DATE}), true)"

    rows = df.selectExpr(
        "*", *[f"{edge(c, 'lag')} AS _s_{c}" for c in categories], *[f"{edge(c, 'lead')} AS _e_{c}" for c in categories]
    )
    rows = rows.selectExpr(
        "*",
        *[f"sum(CAST(_s_{c} AS INT)) OVER ({BY_DATE} {UPTO}) AS _id_{c}" for c in categories],
        *[f"last(CASE WHEN _s_{c} THEN date END, true) OVER ({BY_DATE} {UPTO}) AS _b_{c}" for c in categories],
    )
    end = {c: f"CASE WHEN _e_{c} THEN date END" for c in categories}
    rows = rows.selectExpr("*", *[f"coalesce({end[c]}, {_next(end[c], BY_DATE)}) AS _f_{c}" for c in categories])
    ids = [
        text
        for c in categories
        for text in (
            f"CASE WHEN {c} IS NOT NULL THEN _id_{c} END AS {c}_seq",
            f"CASE WHEN {c} IS NOT NULL THEN datediff(_f_{c}, _b_{c}) + 1 END AS {c}_days",
        )
    ]
    return rows.selectExpr(*df.columns, *ids)


def min_sequence(df: DataFrame, min_len: int = S.MIN_SEQUENCE_DAYS) -> DataFrame:
    """Keep only sequences longer than ``min_len`` days: shorter ones become NULL, empty rows are dropped."""
    categories = [c for c in S.CATEGORIES if f"{c}_seq" in df.columns]
    own = {c: c for c in categories} | {f"{c}_seq": c for c in categories}
    kept = df.filter(" OR ".join(f"{c}_days > {min_len}" for c in categories))
    return kept.selectExpr(
        *[
            f"CASE WHEN {own[c]}_days > {min_len} THEN {c} END AS {c}" if c in own else c
            for c in df.columns
            if c not in {f"{k}_days" for k in categories}
        ]
    )


def stack_sequences(df: DataFrame, categories: tuple[str, ...]) -> DataFrame:
    """One row per site, day and category: (phenocam_name, year, date, category, site_sequence_id, probabilities)."""
    rows = ", ".join(
        f"named_struct('category', '{c}', 'site_sequence_id', {c}_seq, 'probabilities', {c})" for c in categories
    )
    return df.selectExpr(SITE, "year", "date", f"inline(array({rows}))").filter("site_sequence_id IS NOT NULL")


def sequence_table(df: DataFrame, category: str) -> DataFrame:
    """The hand-over table of one category: a DOUBLE column per class (without blurry), named by class."""
    flat = [f"{V.element_sql(category, k)} AS `{name}`" for k, name in enumerate(S.CLASSES[category][1:])]
    return df.filter(f"{category}_seq IS NOT NULL").selectExpr(
        SITE, "year", "date", f"'{category}' AS category", f"{category}_seq AS site_sequence_id", *flat
    )


# ---- whole chains --------------------------------------------------------------------------------------
def with_site_and_date(pred: DataFrame) -> DataFrame:
    """Site and date from the file name; rows whose name holds no date are kept out by the caller's checks."""
    return pred.withColumns({SITE: N.file_site("file"), "date": N.file_date("file")})


def clean_daily(daily: DataFrame, snow_gap: int = S.SNOW_GAP_ROWS, gap: int = S.BLUR_GAP_DAYS) -> DataFrame:
    """Daily images -> gap-filled daily series. The order is fixed: snow mask and its gaps first, blur mask after."""
    masked = interpolate_daily(mask_snow_daily(daily), snow_gap)
    calendar = fill_calendar_daily(drop_blurry_renorm(mask_blurry_daily(masked)))
    return interpolate_daily(calendar, gap)


def prep_for_hmm(
    pred: DataFrame,
    extra_folder: str,
    snow_gap: int = S.SNOW_GAP_ROWS,
    gap: int = S.BLUR_GAP_DAYS,
    min_len: int = S.MIN_SEQUENCE_DAYS,
    deal_images: bool = False,
) -> DataFrame:
    """Scored images (filepath, file, 3 vectors) -> clean daily series with sequence ids per category.

    Two shuffles, both of packed vectors: by (site, day) to pick a day's first image, then by site for everything along time.
    Picking the first file makes a separate ``distinct`` unnecessary. Images whose name holds no date have no place in a series and are
    left out; ``checks.undated_files`` lists them.

    ``deal_images``: for images that are scored in the task that makes them, from rows many times narrower. Such a task is as
    large as its narrow rows allow, and sorting its images to cut down each day would take memory accordingly; dealt first, images
    are sorted once, in tasks whose size follows the images.
    """
    images = pred.filter(~F.contains("filepath", F.lit(extra_folder))).select("file", *S.CATEGORIES)
    dated = packed(with_site_and_date(images).filter(F.col("date").isNotNull()))
    first = _first_of_day(dated.repartition(SITE, "date") if deal_images else dated).drop("file")
    daily = unpacked(first.repartition(SITE))
    return min_sequence(sequence_ids(clean_daily(daily, snow_gap, gap)), min_len)


def prep_profile_simple(images: DataFrame, gap: int = S.PROFILE_GAP_ROWS) -> DataFrame:
    """The lighter profile: calendar, blur mask, then gaps; all images of a day are kept, blurry stays a class.

    Equal to ``interpolate_gaps(mask_blurry_days(fill_calendar(images)), gap)``, from one summary per day: its rows, whether
    its top cover is blurry, its first and last values.
    """
    return _segmented(images, gap, profile=True).withColumn("year", F.year("date"))
