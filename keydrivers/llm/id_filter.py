"""Rows of given ids from a table of long texts, without a shuffle of the others.

The ids set bits of a Bloom filter, and rows that it passes are joined exactly. Only hashes of ids go
through Python, never texts. The filter has 16 bits for each id, between 2 MB and 32 MB: up to 16
million ids it passes some 1.4 percent of the other rows; with more ids it passes more rows, never
other results.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import boxed, on_executors

LEAST_BITS, MOST_BITS = 24, 28


def filter_bits(n_ids: int) -> int:
    """The logarithm of the filter's size."""
    return min(max((16 * n_ids).bit_length(), LEAST_BITS), MOST_BITS)


def _bitmap(ids: DataFrame, bits: int) -> np.ndarray:
    mask = (1 << bits) - 1
    h = F.xxhash64("id")
    places = F.array(h.bitwiseAND(mask), F.shiftrightunsigned(h, bits).bitwiseAND(mask))
    set_bits = ids.select(F.explode(places).alias("p")).select(
        F.shiftright("p", 6).alias("word"), F.expr("shiftleft(1L, cast(p & 63 as int))").alias("bit")
    )
    # At most 2**22 rows.
    words = set_bits.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    found = np.zeros(1 << (bits - 6), np.int64)
    found[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return found.view(np.uint64)


def id_test(ids: DataFrame) -> Callable[[Column], Column]:
    """A test of id columns: false only if an id is not among ``ids`` (column id, bigint; stored)."""
    spark = ids.sparkSession
    on_executors(spark)
    bits = filter_bits(ids.count())
    bitmap = spark.sparkContext.broadcast(_bitmap(ids, bits))

    @F.arrow_udf("boolean")
    def may_be(hashes: pa.Array) -> pa.Array:
        words, mask = bitmap.value, np.uint64((1 << bits) - 1)
        h = hashes.to_numpy(zero_copy_only=False).view(np.uint64)
        maybe = np.ones(len(h), bool)
        for p in (h & mask, (h >> np.uint64(bits)) & mask):
            bit = words[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))
            maybe &= (bit & np.uint64(1)).astype(bool)
        return pa.array(maybe)

    return lambda own: may_be(F.xxhash64(own.cast("bigint")))


def _joined(docs: DataFrame, ids: DataFrame, id_col: str, how: str) -> DataFrame:
    wanted = ids.select(F.col("id").alias("wanted"))
    rows = boxed(docs, own=id_col)
    return rows.join(wanted, F.col("own") == F.col("wanted"), how).select("row.*")


def only_ids(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows whose id is among ``ids`` (column id; stored)."""
    some = docs.where(id_test(ids)(F.col(f"`{id_col}`")))
    return _joined(some, ids, id_col, "left_semi")


def without_ids(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows whose id is not among ``ids`` (column id; stored), or null."""
    maybe = id_test(ids)(F.col(f"`{id_col}`"))
    return docs.where(~maybe).unionByName(_joined(docs.where(maybe), ids, id_col, "left_anti"))
