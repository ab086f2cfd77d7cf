"""Coefficients, field rollups, importances and residuals as tables."""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import result_schema, rows_to_frame
from .metrics import metrics_of_all, regression_metrics
from .models import PREDICTION, FittedRegression, LinearFit, score, score_all

INTERCEPT = "(intercept)"

_TEXT, _NUMBER, _WHOLE = T.StringType(), T.DoubleType(), T.IntegerType()
_COEFFICIENTS = result_schema(
    feature=_TEXT,
    field=_TEXT,
    category=_TEXT,
    coefficient=_NUMBER,
    abs_coefficient=_NUMBER,
    std_coefficient=_NUMBER,
)
_IMPORTANCES = result_schema(feature=_TEXT, field=_TEXT, importance=_NUMBER, rank=_WHOLE)
_SLOTS = result_schema(idx=_WHOLE, slot=_TEXT, field=_TEXT, category=_TEXT)


def slot_table(spark: SparkSession, model: LinearFit | FittedRegression) -> DataFrame:
    """(idx, slot, field, category): what each position of the feature vector stands for."""
    rows = [(s.idx, s.name, s.field, s.category) for s in model.slots]
    return rows_to_frame(spark, rows, _SLOTS)


def effects(model: LinearFit | FittedRegression) -> tuple[float, np.ndarray]:
    """Intercept and one coefficient for each slot.

    Where reference levels were left out of the fit, the levels of such a field are given as
    differences from the mean over its levels, so that no level is special.
    """
    if isinstance(model, LinearFit):
        return model.intercept, model.coefficients
    full = np.zeros(len(model.slots))
    full[list(model.used)] = model.regressor.coefficients.toArray()
    intercept = float(model.regressor.intercept)
    for field in {s.field for s in model.slots if s.idx not in set(model.used)}:
        levels = [s.idx for s in model.slots if s.field == field]
        centre = float(full[levels].mean())
        full[levels] -= centre
        intercept += centre
    return intercept, full


def coefficient_table(
    spark: SparkSession,
    model: LinearFit | FittedRegression,
    intercept: bool = False,
) -> DataFrame:
    """Named coefficients of a linear model, strongest first.

    ``std_coefficient`` compares predictors of different units: it is the coefficient times the
    spread of the slot over the spread of the target, both in the training rows.
    """
    constant, beta = effects(model)
    spread = model.spread
    rows = []
    for s in model.slots:
        b = float(beta[s.idx])
        std = b * float(spread[s.idx] / spread[-1]) if spread[-1] > 0 else None
        rows.append((s.name, s.field, s.category, b, abs(b), std))
    if intercept:
        rows.append((INTERCEPT, INTERCEPT, None, constant, abs(constant), None))
    return rows_to_frame(spark, rows, _COEFFICIENTS).orderBy(F.desc("abs_coefficient"), "feature")


def field_rollup(coefficients: DataFrame) -> DataFrame:
    """(field, avg, sum and median of the absolute coefficients), strongest mean first."""
    strength = F.col("abs_coefficient")
    return (
        coefficients.where(F.col("feature") != INTERCEPT)
        .groupBy("field")
        .agg(
            F.avg(strength).alias("avg_abs_coefficient"),
            F.sum(strength).alias("sum_abs_coefficient"),
            F.median(strength).alias("median_abs_coefficient"),
        )
        .orderBy(F.desc("avg_abs_coefficient"), "field")
    )


def feature_importance(spark: SparkSession, model: FittedRegression) -> DataFrame:
    """(feature, field, importance, rank) of a forest, strongest first; every slot by its name."""
    importance = model.regressor.featureImportances.toArray()
    ranked = sorted(model.slots, key=lambda s: (-importance[s.idx], s.name))
    rows = [
        (s.name, s.field, float(importance[s.idx]), rank) for rank, s in enumerate(ranked, start=1)
    ]
    return rows_to_frame(spark, rows, _IMPORTANCES).orderBy("rank")


def importance_by_field(importances: DataFrame) -> DataFrame:
    """(field, importance): summed over the slots of each source column, strongest first."""
    return (
        importances.groupBy("field")
        .agg(F.sum("importance").alias("importance"))
        .orderBy(F.desc("importance"), "field")
    )


def residual_table(scored: DataFrame, label: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, actual, prediction, residual) for each scored row."""
    y = F.col(label).cast("double")
    return scored.select(
        *keys, y.alias("actual"), PREDICTION, (y - F.col(PREDICTION)).alias("residual")
    )


def model_metrics(
    model: LinearFit | FittedRegression, rows: DataFrame, name: str, split: str
) -> DataFrame:
    """(model, split, n, rmse, mae, r2) of one model on one set of rows."""
    return regression_metrics(score(model, rows), model.spec.target).select(
        F.lit(name).alias("model"), F.lit(split).alias("split"), "n", "rmse", "mae", "r2"
    )


def overfit_report(
    model: LinearFit | FittedRegression,
    marked: DataFrame,
    name: str = "model",
    split: str = "split",
) -> DataFrame:
    """Training against test metrics, from one pass over rows marked 'train' / 'test'."""
    return regression_metrics(score(model, marked), model.spec.target, by=split).select(
        F.lit(name).alias("model"), F.col(split).alias("split"), "n", "rmse", "mae", "r2"
    )


def overfit_reports(
    models: Mapping[str, LinearFit | FittedRegression], marked: DataFrame, split: str = "split"
) -> DataFrame:
    """``overfit_report`` of many models from one read of the rows and one aggregate."""
    # Numbered, so that a model may have the name of a column.
    columns = {f"__model{k}": name for k, name in enumerate(models)}
    scored = score_all({c: models[name] for c, name in columns.items()}, marked)
    targets = {c: models[name].spec.target for c, name in columns.items()}
    found = metrics_of_all(scored, targets, by=split)
    names = F.element_at(F.create_map(*[F.lit(x) for pair in columns.items() for x in pair]), F.col("model"))
    return found.select(names.alias("model"), F.col(split).alias("split"), "n", "rmse", "mae", "r2")
