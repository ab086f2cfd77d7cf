"""Standard column names, clean categories, dropped columns."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import normalized
from .profile import null_fractions


def standardize_columns(
    df: DataFrame, mapping: Mapping[str, str], strict: bool = True
) -> DataFrame:
    """Rename columns in one projection. ``strict`` refuses a name that is not there."""
    if strict:
        missing = [c for c in mapping if c not in df.columns]
        if missing:
            raise ValueError(f"columns to rename are not in the table: {missing}")
    return df.withColumnsRenamed(dict(mapping))


def normalize_category(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Replace dirty category texts by their normal form, see ``functions.normalized``."""
    return df.withColumns({c: normalized(F.col(c)) for c in cols})


def drop_columns(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Drop named columns; case does not matter and missing names are ignored."""
    return df.drop(*cols)


def drop_sparse_columns(
    df: DataFrame, max_null_fraction: float = 0.7, keep: Iterable[str] = ()
) -> DataFrame:
    """Drop every column whose share of nulls is above the threshold (one pass over the data)."""
    keep = set(keep)
    sparse = [
        c
        for c, fraction in null_fractions(df).items()
        if fraction is not None and fraction > max_null_fraction and c not in keep
    ]
    return df.drop(*sparse)
