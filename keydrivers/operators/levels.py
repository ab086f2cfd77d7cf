"""Categories of any number as tables: their index, their slots, and lookups by level.

Nothing here lists categories on the driver or in column metadata, so a category may have millions.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import VECTOR_INFIX
from ..sources import checkpointed
from ..spec import FeatureSpec
from .features import INDEX_SUFFIX, named_categories

# Levels of a category, the most frequent ones, that every executor gets.
HOT_LEVELS = 10_000
SPREAD = 1 << 20


def level_index(df: DataFrame, column: str) -> DataFrame:
    """(category, index, n): categories by falling count, ties by name, numbered from 0; missing ones have no row.

    Counts are dealt by range, every part numbers its own, and the sizes of the parts before are added: one number
    for each part, never a category, is gathered.
    """
    counts = named_categories(df.select(column), [column]).where(F.col(column).isNotNull())
    counts = counts.groupBy(F.col(column).alias("category")).agg(F.count("*").alias("n"))
    order = [F.desc("n"), F.asc("category")]
    parts = checkpointed(counts.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    sizes = parts.groupBy("part").agg(F.count("*").alias("size"))
    before = F.sum("size").over(Window.orderBy("part")) - F.col("size")
    offsets = F.broadcast(sizes.select("part", before.alias("before")))
    place = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    return parts.join(offsets, "part").select(
        "category", (F.col("before") + place).cast("double").alias("index"), "n"
    )


def joined_levels(
    rows: DataFrame, field: str, hot: DataFrame, cold: DataFrame | None, values: Sequence[str], row_hash: Column
) -> DataFrame:
    """``rows`` with the columns ``values`` of their level, null where it has none.

    ``hot`` and ``cold`` are (level, values); ``hot`` holds all levels with more than 1 / HOT_LEVELS of the rows
    and is broadcast. Rows of other levels are dealt by their level, all the rest, missing levels
    included, by ``row_hash``, so that no task gets a hot level.
    """
    names = {v: f"__cold_{k}" for k, v in enumerate(values)}
    joined = rows.join(F.broadcast(hot.withColumnRenamed("level", "__hot")), F.col(field) == F.col("__hot"), "left")
    if cold is None:
        return joined.drop("__hot")
    cold = cold.withColumnsRenamed(names).withColumnRenamed("level", "__cold").withColumn("__dealt", F.lit(-1))
    done = F.col("__hot").isNotNull() | F.col(field).isNull()
    spread = F.when(done, F.pmod(row_hash, F.lit(SPREAD)).cast("int")).otherwise(-1)
    keyed = joined.withColumns({"__spread": spread, "__level": F.when(~done, F.col(field)).otherwise("")})
    same = (F.col("__spread") == F.col("__dealt")) & (F.col("__level") == F.col("__cold"))
    both = keyed.join(cold, same, "left").withColumns({v: F.coalesce(v, c) for v, c in names.items()})
    return both.drop("__hot", "__cold", "__dealt", "__spread", "__level", *names.values())


def with_level_index(df: DataFrame, column: str, index: DataFrame) -> DataFrame:
    """The rows with ``<column>_idx`` from a table of ``level_index``; missing and unseen categories share the
    next index, as Spark's indexer gives them under ``keep``."""
    table = checkpointed(index)
    rest = table.count()
    levels = table.select(F.col("category").alias("level"), F.col("index").alias("__index"))
    hot = levels.where(F.col("__index") < HOT_LEVELS)
    cold = levels.where(F.col("__index") >= HOT_LEVELS) if rest > HOT_LEVELS else None
    rows = df.select(F.struct(*df.columns).alias("__row"), F.col(column).alias("__field"))
    rows = named_categories(rows, ["__field"])
    found = joined_levels(rows, "__field", hot, cold, ["__index"], F.xxhash64("__row"))
    number = F.coalesce(F.col("__index"), F.lit(float(rest))).alias(column + INDEX_SUFFIX)
    return found.select("__row.*", number)


def slot_frame(df: DataFrame, spec: FeatureSpec) -> DataFrame:
    """(idx, slot, field, category) of the whole design: the levels of each category in order, then the numbers."""
    spec.validate(df)
    parts, before = [], 0
    for field in spec.categorical:
        index = checkpointed(level_index(df, field))
        parts.append(
            index.select(
                (F.col("index") + before).cast("bigint").alias("idx"),
                F.concat(F.lit(field + VECTOR_INFIX), F.col("category")).alias("slot"),
                F.lit(field).alias("field"),
                "category",
            )
        )
        before += index.count()
    spark = df.sparkSession
    for k, name in enumerate(spec.numeric):
        parts.append(
            spark.range(before + k, before + k + 1).select(
                F.col("id").alias("idx"), F.lit(name).alias("slot"), F.lit(name).alias("field"), F.lit(None).cast("string").alias("category")
            )
        )
    return reduce(DataFrame.unionByName, parts)
