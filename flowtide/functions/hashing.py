"""Portable deterministic randomness: md5 of ``seed|part|part``, the same in any SQL engine and in any partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_BITS = 60


def _text(seed, parts) -> Column:
    def as_text(p):
        return p.cast("string") if isinstance(p, Column) else F.lit(str(p))

    return F.concat_ws("|", as_text(seed), *[as_text(p) for p in parts])


def _hex_prefix(seed, parts, digits: int) -> Column:
    return F.conv(F.substring(F.md5(_text(seed, parts)), 1, digits), 16, 10).cast("bigint")


def uniform(seed, *parts) -> Column:
    """Uniform double in [0, 1) from the first 32 bits of the hash."""
    return _hex_prefix(seed, parts, 8) / F.lit(4294967296.0)


def hash60(seed, *parts) -> Column:
    """Uniform 60-bit integer, for deterministic orders and samples."""
    return _hex_prefix(seed, parts, HASH_BITS // 4)


def uniform_int(seed, low: int, high: int, *parts) -> Column:
    """Uniform integer in [low, high]."""
    return F.floor(uniform(seed, *parts) * F.lit(float(high - low + 1))).cast("bigint") + F.lit(low)
