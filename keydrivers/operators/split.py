"""Repeatable train/test splits and folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import bucket_of, unit_interval

# Different salts, so that fold numbers do not follow from the side of the split.
SPLIT_SALT = "42"
FOLD_SALT = "fold-42"

FOLD = "fold"


def split(
    df: DataFrame,
    keys: Sequence[str] | None = None,
    weights: Sequence[float] = (0.8, 0.2),
    salt: str = SPLIT_SALT,
) -> list[DataFrame]:
    """Split by a hash of the key columns (all columns without a key).

    The side of a row depends on its key alone: not on partitions, order or a retried task. Rows
    with the same key land on the same side, so give a key that is unique for each row where a
    few keys hold much of the table. No shuffle: every part is a filter over the same scan.
    """
    keyed = df.withColumn("__u", unit_interval(list(keys or df.columns), salt))
    total = float(sum(weights))
    parts, lower = [], 0.0
    for i, weight in enumerate(weights):
        upper = lower + weight / total
        inside = F.col("__u") >= F.lit(lower)
        if i < len(weights) - 1:
            inside = inside & (F.col("__u") < F.lit(upper))
        parts.append(keyed.where(inside).drop("__u"))
        lower = upper
    return parts


def mark_split(
    df: DataFrame,
    keys: Sequence[str] | None = None,
    train: float = 0.8,
    salt: str = SPLIT_SALT,
    col: str = "split",
) -> DataFrame:
    """The same rule as ``split`` for two parts, as a column 'train' / 'test'."""
    u = unit_interval(list(keys or df.columns), salt)
    return df.withColumn(col, F.when(u < F.lit(train), "train").otherwise("test"))


def random_split(
    df: DataFrame, weights: Sequence[float] = (0.8, 0.2), seed: int = 42
) -> list[DataFrame]:
    """Spark's own split; its result changes with the partitioning of ``df``."""
    return df.randomSplit(list(weights), seed=seed)


def assign_folds(
    df: DataFrame,
    keys: Sequence[str] | None = None,
    k: int = 5,
    salt: str = FOLD_SALT,
    col: str = FOLD,
) -> DataFrame:
    """Add a fold number 0 .. k-1 from a hash of the key columns (all columns without a key)."""
    return df.withColumn(col, bucket_of(list(keys or df.columns), k, salt))
