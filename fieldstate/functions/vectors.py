"""Expressions over probability vectors (``ARRAY<DOUBLE>`` of known width).

Elements that are needed on every row are addressed one by one instead of through lambda functions, so the
expressions stay inside whole-stage code generation. They are written as SQL text: a wide expression is one call to
the JVM instead of hundreds. Functions named ``*_sql`` return text, the others a Column.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldstate import schema as S


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def element_sql(vector: str, k: int) -> str:
    return f"get({vector}, {k})"


def element(vector: str, k: int) -> Column:
    return F.expr(element_sql(vector, k))


def elements_sql(vector: str, width: int, start: int = 0) -> list[str]:
    return [element_sql(vector, k) for k in range(start, width)]


def top_is(vector: str, width: int, k: int) -> Column:
    """True where class ``k`` has the highest probability; a tie counts, a NULL vector does not."""
    best = ", ".join(elements_sql(vector, width))
    return F.expr(f"coalesce({element_sql(vector, k)} >= greatest({best}), false)")


def total_sql(vector: str, width: int, start: int) -> str:
    """Sum of elements ``start..width-1``; NULL if one of them is NULL."""
    return "(" + " + ".join(elements_sql(vector, width, start)) + ")"


def renormalised(vector: str, width: int, start: int, total: str | None = None) -> Column:
    """Elements ``start..width-1`` scaled to sum 1; NULL if one of them is NULL or the sum is 0.

    The division is a lambda function: written out for every element of three vectors, the generated method is larger than the
    JVM compiles, and all rows run through its interpreter. A lambda function is interpreted itself, for every element, so
    on many rows the sum is better a column of its own: ``total`` names one that holds :func:`total_sql`.
    """
    total = total or total_sql(vector, width, start)
    return F.expr(f"CASE WHEN {total} <> 0 THEN transform(slice({vector}, {start + 1}, {width - start}), p -> p / {total}) END")


def between(vector: str, position: str, previous: str, following: str, max_gap: int) -> Column:
    """The stored vector, or the straight line between its bounding marks (structs ``at``, ``v``) over a short gap.

    The line is a lambda function on purpose: it is evaluated on gap rows only, and writing it out per element makes
    generated methods too large for the JVM to compile.
    """
    span = f"({following}.at - {previous}.at)"
    line = f"zip_with({previous}.v, {following}.v, (a, b) -> a + (b - a) * (({position} - {previous}.at) / {span}))"
    return F.expr(f"CASE WHEN {vector} IS NOT NULL THEN {vector} WHEN {span} - 1 <= {max_gap} THEN {line} END")


# ---- narrow form for shuffles --------------------------------------------------------------------------
# Scores are exchanged with S.SCORE_DIGITS decimals. A value k / STEPS with such a k becomes the 16-bit code 2k; a value between
# two of them, or outside, becomes the odd code between (null stays null), and its row keeps the vectors as they are besides. Codes
# stop at the first odd one, so codes and kept vectors together order rows exactly as the vectors do, whatever the values. A zero
# loses its sign.
STEPS = 10**S.SCORE_DIGITS
LAST = (1 << 14) - 1


def even_codes_sql(vector: str) -> str:
    """The codes, if all values are on the grid: :func:`decoded_sql` then gives the vector. NULL for values outside the codes."""
    inside = f"array_min({vector}) >= 0 AND array_max({vector}) <= {LAST} / {STEPS}D"
    return f"CASE WHEN {inside} THEN transform({vector}, x -> CAST(x * {2 * STEPS}D + 0.5D AS SMALLINT)) END"


def codes_sql(vector: str) -> str:
    """The code of every element, for all values."""
    near = f"floor(x * {STEPS}D + 0.5D)"
    return (
        f"transform({vector}, x -> CAST(CASE WHEN x < 0 THEN -1 WHEN x > {LAST} / {STEPS}D THEN {2 * LAST + 1} "
        f"ELSE 2 * {near} + CAST(sign(x - {near} / {STEPS}D) AS INT) END AS SMALLINT))"
    )


def first_odd_sql(codes: str) -> str:
    """Position of the first code that does not stand for its value alone; 0 without one."""
    return f"coalesce(CAST(array_position(transform({codes}, k -> k % 2 <> 0), true) AS INT), 0)"


def decoded_sql(codes: str) -> str:
    return f"transform({codes}, k -> {decoded_one_sql('k')})"


def decoded_one_sql(code: str) -> str:
    return f"shiftright({code}, 1) / {STEPS}D"


def first_top_code_sql(vector: str) -> str:
    return f"CAST(array_position({vector}, array_max({vector})) - 1 AS INT)"


def first_top_code(vector: str) -> Column:
    """Class code of the highest probability, the lowest code on a tie."""
    return F.expr(first_top_code_sql(vector))


def name_sql(names: tuple[str, ...], position: str) -> str:
    """Name at a 0-based position, NULL outside the list."""
    return f"get(array({', '.join(quoted(n) for n in names)}), {position})"


def class_name(category: str, code: str) -> Column:
    return F.expr(name_sql(S.CLASSES[category], code))
