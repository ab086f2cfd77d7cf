"""Repeatable pseudo-random numbers from key columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_HASH_RANGE = 2**32


def _hash32(keys: Sequence[str], salt: str) -> Column:
    key = F.concat_ws("|", F.lit(salt), *[F.col(k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint")


def unit_interval(keys: Sequence[str], salt: str) -> Column:
    """A number in [0, 1) that depends on the key values and the salt only.

    The same row gets the same number under any partitioning, on any engine with md5.
    """
    return _hash32(keys, salt) / F.lit(float(_HASH_RANGE))


def bucket_of(keys: Sequence[str], buckets: int, salt: str) -> Column:
    """A bucket number 0 .. buckets-1 from the same kind of hash."""
    return (_hash32(keys, salt) % F.lit(buckets)).cast("int")
