"""The whole analysis of one table: profile, correlate, tune, compare and explain."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from .. import operators as ops
from ..sources import kept, write_table
from ..spec import FeatureSpec


@dataclass(frozen=True)
class DriverAnalysis:
    """Result tables of one analysis. Only ``residuals``, by model, grow with the number of rows."""

    nulls: DataFrame
    cardinality: DataFrame
    values: dict[str, DataFrame]
    correlation: DataFrame
    target_correlation: DataFrame
    collinear: DataFrame
    distribution: dict[str, DataFrame]
    box: DataFrame
    cv: DataFrame
    best: DataFrame
    leaderboard: DataFrame
    coefficients: dict[str, DataFrame]
    rollups: dict[str, DataFrame]
    importance: DataFrame
    field_importance: DataFrame
    residuals: dict[str, DataFrame]
    models: dict[str, ops.LinearFit | ops.FittedRegression]


def analyse_drivers(
    df: DataFrame,
    spec: FeatureSpec,
    strong: FeatureSpec | None = None,
    keys: Sequence[str] | None = None,
    ridge_grid: Sequence[float] = ops.RIDGE_GRID,
    forest_grid: Mapping[str, Sequence[float]] | None = None,
    folds: int = ops.FOLDS,
    parallelism: int = 2,
    profiled: Sequence[str] = (),
) -> DriverAnalysis:
    """Tune, compare and explain ridge models and a forest on one table.

    Models: ``numeric`` (ridge on the numeric predictors), ``full`` (ridge on all predictors),
    ``strong`` (ridge on the predictors of ``strong``, if given) and ``forest`` (all predictors).
    Rows are split 80/20 by a hash of ``keys``; penalties and forest parameters are chosen by
    cross-validation on the training part. ``profiled`` are categories to count and list besides the
    predictors. Collinear predictors are those that resemble the one closest to the target.
    """
    spark = df.sparkSession
    spec.validate(df)
    ridge_specs = {"numeric": FeatureSpec(spec.numeric, (), spec.target), "full": spec}
    if strong is not None:
        ridge_specs["strong"] = strong
    used = list(dict.fromkeys([*spec.columns, *(strong.columns if strong else ())]))
    keys = list(keys or used)
    reserved = {"split", "fold"} & {*used, *keys}
    if reserved:
        raise ValueError(f"columns with reserved names: {sorted(reserved)}")
    marked = ops.mark_split(df.select(*dict.fromkeys([*keys, *used])), keys)
    marked = ops.assign_folds(marked, keys, folds)
    with kept(marked) as rows:
        train = rows.where("split = 'train'")
        results = {
            name: ops.ridge_cv(train, s, ridge_grid, metrics=("r2", "rmse"), model=name)
            for name, s in ridge_specs.items()
        }
        results["forest"] = ops.forest_cv(train, spec, forest_grid, parallelism=parallelism)
        models = {name: r.fitted for name, r in results.items()}
        coefficients = {
            name: ops.coefficient_table(spark, models[name], intercept=True)
            for name in ridge_specs
        }
    categories = list(dict.fromkeys([*spec.categorical, *profiled]))
    ranked = ops.target_correlation(df, spec)
    strongest = ranked.select("feature").first()
    importance = ops.feature_importance(spark, models["forest"])
    return DriverAnalysis(
        nulls=ops.null_profile(df),
        cardinality=ops.category_cardinality(df, categories),
        values={c: ops.category_values(df, c) for c in categories},
        correlation=ops.correlation_wide(df, spec.measures),
        target_correlation=ranked,
        collinear=ops.collinear_with(df, spec, strongest[0]) if strongest else ranked.limit(0),
        distribution={c: ops.distribution_by(df, c, spec.target) for c in spec.categorical},
        box=ops.box_stats(df, spec.target),
        cv=ops.stacked(ops.cv_report(spark, r) for r in results.values()),
        best=ops.stacked(ops.best_params(spark, r) for r in results.values()),
        leaderboard=ops.leaderboard([ops.overfit_reports(models, marked)]),
        coefficients=coefficients,
        rollups={name: ops.field_rollup(c) for name, c in coefficients.items()},
        importance=importance,
        field_importance=ops.importance_by_field(importance),
        residuals={
            name: ops.residual_table(ops.score(model, marked), spec.target, (*keys, "split"))
            for name, model in models.items()
        },
        models=models,
    )


def write_results(analysis: DriverAnalysis, folder: str) -> dict[str, str]:
    """The tables for an outside chart tool, one CSV each; returns the paths."""
    folder = folder.rstrip("/")
    tables = {
        "coefficients": analysis.coefficients["full"],
        "importances": analysis.importance,
        "correlation": analysis.correlation,
    }
    return {
        name: write_table(df, f"{folder}/{name}", single_file=True) for name, df in tables.items()
    }
