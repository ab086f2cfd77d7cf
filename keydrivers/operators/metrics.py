"""Regression metrics of scored rows."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quantiles import seen_value


def regression_metrics(
    scored: DataFrame,
    label: str,
    prediction: str = "prediction",
    by: Sequence[str] | str = (),
) -> DataFrame:
    """(n, rmse, mae, r2), one row or one row for each value of ``by``, in one pass.

    R² is measured against the mean label of the scored rows; it is null for a constant label.
    Rows without label or prediction, NaN included, are left out.
    """
    by = [by] if isinstance(by, str) else list(by)
    y = seen_value(label)
    error = y - seen_value(prediction)
    # Squared deviation of the same rows that have an error.
    y_scored = F.when(error.isNotNull(), y)
    return (
        scored.groupBy(*by)
        .agg(
            F.count(error).alias("n"),
            F.sqrt(F.avg(error * error)).alias("rmse"),
            F.avg(F.abs(error)).alias("mae"),
            F.avg(error * error).alias("__mse"),
            F.var_pop(y_scored).alias("__var"),
        )
        .select(
            *by,
            "n",
            "rmse",
            "mae",
            (F.lit(1.0) - F.try_divide(F.col("__mse"), F.col("__var"))).alias("r2"),
        )
    )


def stacked(tables: Iterable[DataFrame]) -> DataFrame:
    """Small result tables with the same columns as one table."""
    return reduce(DataFrame.unionByName, tables)


def leaderboard(results: Iterable[DataFrame]) -> DataFrame:
    """One table (model, split, n, rmse, mae, r2) of several metric tables, best first."""
    columns = ["model", "split", "n", "rmse", "mae", "r2"]
    rows = stacked(r.select(*columns) for r in results)
    return rows.orderBy("split", F.desc_nulls_last("r2"), "model")


def metrics_of_all(
    scored: DataFrame, targets: Mapping[str, str], by: Sequence[str] | str = ()
) -> DataFrame:
    """(by, model, n, rmse, mae, r2) for each column of predictions, in one aggregate.

    ``targets`` names the label of each column of predictions. Rows as in ``regression_metrics``.
    """
    by = [by] if isinstance(by, str) else list(by)
    sums, cells = [], []
    for k, (prediction, label) in enumerate(targets.items()):
        y = seen_value(label)
        error = y - seen_value(prediction)
        sums += [
            F.count(error).alias(f"__n{k}"),
            F.avg(error * error).alias(f"__mse{k}"),
            F.avg(F.abs(error)).alias(f"__mae{k}"),
            F.var_pop(F.when(error.isNotNull(), y)).alias(f"__var{k}"),
        ]
        mse = F.col(f"__mse{k}")
        cells.append(
            F.struct(
                F.lit(prediction).alias("model"),
                F.col(f"__n{k}").alias("n"),
                F.sqrt(mse).alias("rmse"),
                F.col(f"__mae{k}").alias("mae"),
                (F.lit(1.0) - F.try_divide(mse, F.col(f"__var{k}"))).alias("r2"),
            )
        )
    return scored.groupBy(*by).agg(*sums).select(*by, F.inline(F.array(*cells)))
