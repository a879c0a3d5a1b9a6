"""Independent SQL for every registered query, run by DuckDB over the same tables.

Written in long form (one row per class) and with joins, where the library works on vectors and windows, so the two
share no logic. They share fixed values (class names, weights, signatures, labels) from ``fieldstate.schema``.
"""

from oracle.queries import QUERIES

__all__ = ["QUERIES"]
