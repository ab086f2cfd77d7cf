"""Profiles of categories and nulls."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _one_row_to_many(structs: Iterable[Column]) -> Column:
    return F.inline(F.array(*structs))


def category_cardinality(df: DataFrame, cols: Iterable[str], approx: bool = False) -> DataFrame:
    """(column, n_values) for all columns in one job; null counts as one value.

    Exact counts shuffle the distinct values only, after a map-side de-duplication. ``approx``
    keeps one fixed-size sketch for each column and shuffles nothing but these.
    """
    cols = list(cols)
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, n_values bigint")
    counter = F.approx_count_distinct if approx else F.count_distinct
    counted = df.agg(
        *[counter(F.col(c)).alias(f"d{i}") for i, c in enumerate(cols)],
        *[F.max(F.col(c).isNull().cast("int")).alias(f"z{i}") for i, c in enumerate(cols)],
    )
    return counted.select(
        _one_row_to_many(
            F.struct(
                F.lit(c).alias("column"),
                (F.col(f"d{i}") + F.coalesce(F.col(f"z{i}"), F.lit(0))).alias("n_values"),
            )
            for i, c in enumerate(cols)
        )
    )


def category_values(df: DataFrame, col: str) -> DataFrame:
    """(value, n) for each distinct value of one category, sorted by the value."""
    return df.groupBy(F.col(col).alias("value")).agg(F.count("*").alias("n")).orderBy("value")


def null_profile(df: DataFrame) -> DataFrame:
    """(column, type, n, n_non_null, n_null, null_fraction) for every column, in one pass."""
    fields = df.schema.fields
    counted = df.agg(
        F.count("*").alias("n"),
        *[F.count(F.col(f"`{f.name}`")).alias(f"c{i}") for i, f in enumerate(fields)],
    )
    return counted.select(
        _one_row_to_many(
            F.struct(
                F.lit(f.name).alias("column"),
                F.lit(f.dataType.simpleString()).alias("type"),
                F.col("n").alias("n"),
                F.col(f"c{i}").alias("n_non_null"),
                (F.col("n") - F.col(f"c{i}")).alias("n_null"),
                F.try_divide((F.col("n") - F.col(f"c{i}")).cast("double"), F.col("n")).alias(
                    "null_fraction"
                ),
            )
            for i, f in enumerate(fields)
        )
    )


def null_fractions(df: DataFrame) -> dict[str, float | None]:
    """Share of nulls by column name, on the driver: one number for each column."""
    return {r["column"]: r["null_fraction"] for r in null_profile(df).collect()}
