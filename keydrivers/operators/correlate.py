"""Pearson correlation of numeric columns, each pair over its own non-null rows."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..spec import FeatureSpec
from .products import COMPILED_WIDTH, column_stats, pair_moments, product_sums


def correlation(x: Column, y: Column) -> Column:
    """Aggregate: Pearson's r over rows where both are set; null if either is constant."""
    spread = F.sqrt(F.regr_sxx(y, x) * F.regr_syy(y, x))
    return F.try_divide(F.regr_sxy(y, x), spread)


def _doubles(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """The columns as doubles, with NaN as null: both mean that there is no value."""
    floating = {f.name for f in df.schema.fields if f.dataType.typeName() in ("float", "double")}
    return df.select(
        *[
            (
                F.nullif(F.col(c).cast("double"), F.lit(float("nan")))
                if c in floating
                else F.col(c).cast("double")
            ).alias(c)
            for c in cols
        ]
    )


def _direct(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """(a, b, r) of the pairs, each from the central moments of its own rows, in one pass."""
    if not pairs:
        return df.sparkSession.createDataFrame([], "a string, b string, r double")
    row = df.agg(
        *[correlation(F.col(a), F.col(b)).alias(f"r{k}") for k, (a, b) in enumerate(pairs)]
    )
    cells = [
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{k}").alias("r"))
        for k, (a, b) in enumerate(pairs)
    ]
    return row.select(F.inline(F.array(*cells)))


def _from_products(df: DataFrame, cols: Sequence[str], compiled_width: int) -> DataFrame:
    """(a, b, r) of all pairs of columns in their order, a column with itself included."""
    if len(cols) > compiled_width:
        # Matrix products of one read serve complete columns too.
        return _from_moments(df, cols)
    stats = column_stats(df, cols)
    if not stats.complete:
        return _from_moments(df, cols)
    sums = product_sums(df, cols, stats, compiled_width=compiled_width)
    cxy = F.col("sxy") - F.try_divide(F.col("sx") * F.col("sy"), F.col("n"))
    cxx = F.col("sxx") - F.try_divide(F.col("sx") * F.col("sx"), F.col("n"))
    cyy = F.col("syy") - F.try_divide(F.col("sy") * F.col("sy"), F.col("n"))
    flat = F.array(*[F.lit(c in stats.flat) for c in cols])
    i, j = F.col("i"), F.col("j")
    spread = ~flat[i] & ~flat[j]
    r = F.when(spread, F.when(i == j, F.lit(1.0)).otherwise(F.try_divide(cxy, F.sqrt(cxx * cyy))))
    names = F.array(*[F.lit(c) for c in cols])
    return sums.select(names[i].alias("a"), names[j].alias("b"), r.alias("r"))


def _from_moments(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """The same for columns with gaps, each pair around the means of its own rows."""
    found = pair_moments(df, cols)
    names = F.array(*[F.lit(c) for c in cols])
    i, j, n = F.col("i"), F.col("j"), F.col("n")

    def spread(square: str, mean: str) -> Column:
        # Less than doubles resolve around the mean is no spread.
        return F.sqrt(F.col(square)) > F.sqrt(n) * F.abs(F.col(mean)) * F.lit(4e-15)

    both = (n > 1) & spread("cxx", "mx") & spread("cyy", "my")
    pair = F.try_divide(F.col("cxy"), F.sqrt(F.col("cxx")) * F.sqrt(F.col("cyy")))
    r = F.when(both, F.when(i == j, F.lit(1.0)).otherwise(pair))
    return found.select(names[i].alias("a"), names[j].alias("b"), r.alias("r"))


def correlation_matrix(
    df: DataFrame, cols: Iterable[str], compiled_width: int = COMPILED_WIDTH
) -> DataFrame:
    """Long form (a, b, r) of the full symmetric matrix, in two passes over the data, or one for wide tables.

    The first pass gives means and null counts; the second sums products around the means, or,
    where values are missing, merges means and centred products of every pair over its own rows. More than
    ``compiled_width`` columns take the latter alone, gaps or not. A
    column or pair without spread has no correlation: null, also with itself.
    """
    cols = list(cols)
    upper = _from_products(_doubles(df, cols), cols, compiled_width)
    one_way = F.struct(F.col("a"), F.col("b"))
    other_way = F.struct(F.col("b").alias("a"), F.col("a").alias("b"))
    ways = F.when(F.col("a") == F.col("b"), F.array(one_way)).otherwise(
        F.array(one_way, other_way)
    )
    return upper.select("r", F.explode(ways).alias("p")).select("p.a", "p.b", "r")


def correlation_wide(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Matrix form: ``feature`` and one column for each of ``cols``."""
    cols = list(cols)
    return (
        correlation_matrix(df, cols)
        .groupBy(F.col("a").alias("feature"))
        .pivot("b", cols)
        .agg(F.first("r"))
    )


def correlations_with(df: DataFrame, column: str, others: Iterable[str]) -> DataFrame:
    """(feature, r, abs_r) of one column with each of the others, strongest first."""
    others = list(others)
    pairs = _direct(_doubles(df, [*others, column]), [(c, column) for c in others])
    return (
        pairs.select(F.col("a").alias("feature"), "r", F.abs("r").alias("abs_r"))
        .orderBy(F.desc_nulls_last("abs_r"), "feature")
    )


def target_correlation(df: DataFrame, spec: FeatureSpec) -> DataFrame:
    """Numeric predictors ranked by the strength of their correlation with the target."""
    spec.validate(df)
    return correlations_with(df, spec.target, spec.numeric)


def collinear_with(
    df: DataFrame, spec: FeatureSpec, column: str, min_abs_r: float = 0.75
) -> DataFrame:
    """Numeric predictors that carry much the same information as ``column``."""
    spec.validate(df)
    others = [c for c in spec.numeric if c != column]
    return correlations_with(df, column, others).where(F.col("abs_r") >= min_abs_r)
