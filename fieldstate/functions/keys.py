"""Stable pseudo-random keys for sampling.

A key depends only on the row's identity and a seed, never on partitioning, so a sample is the same after a
retry, on another cluster size and in another engine. md5 is used because it is uniform (no hot key) and
spelled the same everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sample_key(identity: Column | str, seed: int) -> Column:
    """32 hex digits; order by them to shuffle, take a prefix to get equal-sized buckets."""
    identity = F.col(identity) if isinstance(identity, str) else identity
    return F.md5(F.concat_ws("|", F.lit(str(seed)), identity.cast("string")))


def hex_int(key: Column, start: int, digits: int) -> Column:
    """``digits`` hex digits of a key, from 1-based position ``start``, as BIGINT."""
    return F.conv(F.substring(key, start, digits), 16, 10).cast("bigint")
