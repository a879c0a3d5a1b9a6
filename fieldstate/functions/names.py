"""Column expressions for image file names, archive addresses and display labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldstate import schema as S
from fieldstate.functions.vectors import quoted

# fixed value: image files are named site_YYYY_MM_DD_HHMMSS.jpg
IMAGE_FILE = r"^([^_]+)_(\d{4})_(\d{2})_(\d{2})_(\d{2})(\d{2})(\d{2})\.jpg$"


def base_name(path: Column | str) -> Column:
    return F.substring_index(path, "/", -1)


def file_part(file: Column | str, group: int) -> Column:
    """A group of the image-file pattern, NULL when the name does not match."""
    part = F.regexp_extract(file, IMAGE_FILE, group)
    return F.when(part != "", part)


def file_site(file: Column | str) -> Column:
    return F.substring_index(file, "_", 1)


def file_timestamp(file: Column | str) -> Column:
    """Local time of the image, without zone; NULL when the name holds no valid time."""
    return F.try_make_timestamp_ntz(*[file_part(file, g).cast("int") for g in range(2, 8)])


def file_date(file: Column | str) -> Column:
    """Date part only; one parse, cheaper than :func:`file_timestamp` where the time is not needed."""
    file = F.col(file) if isinstance(file, str) else file
    stamp = F.substr(file, F.length(file_site(file)) + 2, F.lit(17))
    return F.try_to_timestamp(stamp, F.lit("yyyy_MM_dd_HHmmss")).cast("date")


def archive_url(base: str, site: Column | str, date: Column | str, file: Column | str) -> Column:
    return F.concat_ws(
        "/", F.lit(base.rstrip("/")), site, F.year(date).cast("string"), F.date_format(date, "MM"), file
    )


def browse_url(base: str, site: Column | str, date: Column | str) -> Column:
    return F.concat_ws("/", F.lit(base.rstrip("/")), site, F.date_format(date, "yyyy/MM/dd"))


def transition_file_name(path: Column | str) -> Column:
    """Name of the transition-date file that belongs to a daily greenness file."""
    path = F.col(path) if isinstance(path, str) else path
    return F.regexp_replace(path, "^(.*?)_1day", "$1_1day_transition_dates")


def display_rank(name: str) -> Column:
    """Position of a class in the report order (INT, NULL for an unknown class)."""
    order = ", ".join(quoted(n) for n in S.DISPLAY_ORDER)
    return F.expr(f"CAST(nullif(array_position(array({order}), {name}), 0) AS INT)")


def display_label(name: str) -> Column:
    cases = " ".join(f"WHEN {quoted(n)} THEN {quoted(S.class_label(n))}" for n in S.DISPLAY_ORDER)
    return F.expr(f"CASE {name} {cases} END")


def day_label(day_of_year: Column | str) -> Column:
    """``Mon dd`` label of a day number, in a year without leap day."""
    day_of_year = F.col(day_of_year) if isinstance(day_of_year, str) else day_of_year
    return F.date_format(F.date_add(F.lit("2018-01-01").cast("date"), day_of_year - 1), "MMM dd")
