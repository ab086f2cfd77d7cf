"""Top rows of a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame


def top_k(df: DataFrame, order: Sequence[Column | str] | Column | str, k: int = 20) -> DataFrame:
    """The first ``k`` rows in the given order; each task keeps only its own best ``k``."""
    order = [order] if isinstance(order, (str, Column)) else list(order)
    return df.orderBy(*order).limit(k)
