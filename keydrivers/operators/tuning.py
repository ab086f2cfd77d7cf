"""Parameter grids and cross-validation."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from contextlib import ExitStack, contextmanager
from dataclasses import dataclass
from itertools import product
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.base import Estimator
from pyspark import inheritable_thread_target
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import kept, result_schema, rows_to_frame
from ..spec import FeatureSpec
from .features import FEATURES, Slot, feature_pipeline, feature_slots, prepared
from .forest_path import NESTED, forest_arrays, scores_of_arrays
from .metrics import regression_metrics
from .models import (
    FittedRegression,
    LinearFit,
    fit_linear_pipeline,
    for_trees,
    forest_regressor,
    forests_at_once,
    linear_from_moments,
    linear_regressor,
)
from .moments import design_moments, held_out_metrics, ridge_path
from .split import FOLD

# The tuning grids.
RIDGE_GRID = (0.0, 0.01, 0.05, 0.1, 0.3, 0.5, 0.7, 1.0, 1.5)
FOREST_GRID = {"numTrees": (25, 50), "maxDepth": (9, 12), "minInfoGain": (0.01,)}
FOLDS = 5

_TEXT, _NUMBER = T.StringType(), T.DoubleType()
_CV_SCHEMA = result_schema(
    model=_TEXT,
    point=T.IntegerType(),
    param=_TEXT,
    value=_NUMBER,
    metric=_TEXT,
    mean=_NUMBER,
    std=_NUMBER,
)
_BEST_SCHEMA = result_schema(model=_TEXT, param=_TEXT, value=_NUMBER)

_HIGHER_IS_BETTER = {"r2": True, "rmse": False, "mae": False}


@dataclass(frozen=True)
class CvPoint:
    """Scores of one grid point over the folds."""

    params: Mapping[str, float]
    metric: str
    mean: float
    std: float


@dataclass(frozen=True)
class CvResult:
    """All grid points, the best one, and the model refitted with it on all rows."""

    model: str
    points: tuple[CvPoint, ...]
    best: Mapping[str, float]
    fitted: LinearFit | FittedRegression


def param_grid(estimator: Estimator, values: Mapping[str, Sequence[float]]) -> list[dict]:
    """Every combination of the values, as parameter maps for ``estimator``."""
    grid = ParamGridBuilder()
    for name, options in values.items():
        grid = grid.addGrid(getattr(estimator, name), list(options))
    return grid.build()


def combinations_of(values: Mapping[str, Sequence[float]]) -> list[dict[str, float]]:
    """The same combinations in the same order, as plain dictionaries."""
    return [dict(zip(values, point)) for point in product(*values.values())]


def _best(points: Sequence[CvPoint]) -> CvPoint:
    sign = 1.0 if _HIGHER_IS_BETTER[points[0].metric] else -1.0
    return max(points, key=lambda p: sign * p.mean)


def _summarised(
    params: Mapping[str, float], metric: str, scores: Sequence[float | None]
) -> CvPoint:
    """Folds without a score (a constant target has no R²) are left out."""
    known = [s for s in scores if s is not None]
    mean = float(np.mean(known)) if known else float("nan")
    std = float(np.std(known)) if known else float("nan")
    return CvPoint(params, metric, mean, std)


def ridge_cv(
    df: DataFrame,
    spec: FeatureSpec,
    grid: Sequence[float] = RIDGE_GRID,
    fold: str = FOLD,
    metrics: Sequence[str] = ("r2",),
    model: str = "ridge",
    invalid: str = "error",
    method: str = "moments",
    parallelism: int = 2,
) -> CvResult:
    """Cross-validate ridge penalties; the first of ``metrics`` picks the best one.

    ``method="moments"``: the training moments of a fold are the sum over all other folds, and the
    best model comes from the sum over all, so two passes over the data serve any number of penalties
    and folds. Metrics are 'r2' and 'rmse'; the driver holds folds x slots² numbers.
    ``method="pipeline"``: one Spark fit for each fold and penalty, for designs of very many slots.
    The feature stages are fitted once on all rows in both.
    """
    if method not in ("moments", "pipeline"):
        raise ValueError(f"method must be 'moments' or 'pipeline', not {method!r}")
    if invalid == "keep":
        raise ValueError("a linear model has no use for missing numbers: 'error' or 'skip'")
    grid = tuple(grid)
    if method == "pipeline":
        return cross_validate(
            df, spec, linear_regressor(spec), {"regParam": grid}, fold, metrics, model, parallelism, invalid
        )
    unknown = set(metrics) - {"r2", "rmse"}
    if unknown:
        raise ValueError(f"metrics from moments are 'r2' and 'rmse', not {sorted(unknown)}")
    moments = design_moments(df.select(*spec.columns, fold), spec, fold, invalid)
    scores = {name: [[] for _ in grid] for name in ("r2", "rmse")}
    for held_out, test in sorted(moments.by_fold.items()):
        for i, (intercept, beta) in enumerate(ridge_path(moments.total(held_out), grid)):
            r2, rmse = held_out_metrics(test, intercept, beta)
            scores["r2"][i].append(r2)
            scores["rmse"][i].append(rmse)
    points = tuple(
        _summarised({"regParam": penalty}, name, scores[name][i])
        for name in metrics
        for i, penalty in enumerate(grid)
    )
    best = _best([p for p in points if p.metric == metrics[0]]).params
    fitted = linear_from_moments(moments, spec, best["regParam"], invalid)
    return CvResult(model, points, best, fitted)


@contextmanager
def _vectors(
    df: DataFrame, spec: FeatureSpec, fold: str, invalid: str, trees: bool
) -> Iterator[tuple[PipelineModel, tuple[Slot, ...], DataFrame]]:
    """(feature stages, slots, kept vectors). ``df`` is computed once for all that read it.

    For ``trees`` the rows of a partition lie in the order of their predictors. A pass adds every row to the sums
    of one node of each tree; neighbours then meet the same nodes, whose sums the processor still has at hand.
    """
    with ExitStack() as stack:
        with kept(prepared(df.select(*spec.columns, fold), spec, invalid)) as rows:
            features = feature_pipeline(spec, invalid).fit(rows)
            if trees:
                rows = for_trees(rows, rows.count()).sortWithinPartitions(*spec.predictors)
            with_features = features.transform(rows)
            slots = tuple(feature_slots(with_features, spec))
            vectors = stack.enter_context(kept(with_features.select(FEATURES, spec.target, fold)))
            vectors.count()  # from here on the vectors stand for the rows
        yield features, slots, vectors


def cross_validate(
    df: DataFrame,
    spec: FeatureSpec,
    regressor: Estimator,
    grid: Mapping[str, Sequence[float]],
    fold: str = FOLD,
    metrics: Sequence[str] = ("r2",),
    model: str = "model",
    parallelism: int = 2,
    invalid: str = "error",
) -> CvResult:
    """Cross-validate any regressor over a grid, then refit the best point on all rows.

    The feature stages are fitted once and the vectors are kept; only the regressor is fitted again,
    ``parallelism`` fits at a time. One aggregate gives all ``metrics`` of a fit; the first picks the
    best point. ``fold`` holds fold numbers, as ``assign_folds`` gives. Linear regressors are refitted
    by ``fit_linear``'s pipeline, so that without a penalty their levels are centred too.
    """
    maps = param_grid(regressor, grid)
    trees = isinstance(regressor, RandomForestRegressor)
    with _vectors(df, spec, fold, invalid, trees) as (features, slots, vectors):
        sizes = {r[0]: r["count"] for r in vectors.groupBy(fold).count().collect()}
        folds, n = sorted(sizes), sum(sizes.values())

        def fit_and_score(task: tuple[int, int]) -> dict[str, float | None]:
            held_out, i = task
            fitted = regressor.fit(for_trees(vectors.where(F.col(fold) != held_out), n), maps[i])
            scored = fitted.transform(vectors.where(F.col(fold) == held_out))
            return regression_metrics(scored, spec.target).first().asDict()

        tasks = list(product(folds, range(len(maps))))
        with ThreadPool(forests_at_once(vectors, n, parallelism) if trees else parallelism) as pool:
            found = dict(zip(tasks, pool.map(inheritable_thread_target(df.sparkSession)(fit_and_score), tasks)))
        points = tuple(
            _summarised(params, metric, [found[f, i][metric] for f in folds])
            for metric in metrics
            for i, params in enumerate(combinations_of(grid))
        )
        best = _best([p for p in points if p.metric == metrics[0]]).params
        if isinstance(regressor, LinearRegression):
            fitted = fit_linear_pipeline(df, spec, best["regParam"], invalid)
        else:
            chosen = maps[combinations_of(grid).index(best)]
            stages = [*features.stages, regressor.fit(for_trees(vectors, n), chosen)]
            used = tuple(s.idx for s in slots)
            fitted = FittedRegression(spec, PipelineModel(stages), slots, used, invalid)
    return CvResult(model, points, best, fitted)


def forest_cv(
    df: DataFrame,
    spec: FeatureSpec,
    grid: Mapping[str, Sequence[float]] | None = None,
    fold: str = FOLD,
    metrics: Sequence[str] = ("r2",),
    parallelism: int = 2,
    invalid: str = "error",
    model: str = "forest",
    method: str = "nested",
    **options,
) -> CvResult:
    """Cross-validate a random forest, then refit the best point on all rows.

    ``method="nested"``: one forest for each fold, of the most trees, the greatest depth and the least
    gain of the grid. A point with fewer trees is its first ones, one with less depth or a higher
    gain is the same trees cut; so points differ by their parameters alone, not by other samples of rows. All
    points of all folds are scored in one scan. Parameters other than ``numTrees``, ``maxDepth`` and
    ``minInfoGain`` get forests of their own, as does a single tree, which Spark grows differently.
    ``method="refit"``: every point of every fold is fitted by itself, on its own samples.
    ``parallelism`` fits run at a time, fewer where their rows would not fit side by side.
    ``options`` are further parameters of Spark's regressor.
    """
    if method not in ("nested", "refit"):
        raise ValueError(f"method must be 'nested' or 'refit', not {method!r}")
    grid = dict(grid or FOREST_GRID)
    regressor = forest_regressor(spec, **options)
    if method == "refit":
        return cross_validate(df, spec, regressor, grid, fold, metrics, model, parallelism, invalid)
    points = combinations_of(grid)
    scores: dict[tuple, list] = {}
    with _vectors(df, spec, fold, invalid, trees=True) as (features, slots, vectors):
        sizes = {r[0]: r["count"] for r in vectors.groupBy(fold).count().collect()}
        folds, n = sorted(sizes), sum(sizes.values())
        for others, axes in _nested_groups(regressor, points):
            largest = others | {
                "numTrees": max(axes["numTrees"]), "maxDepth": max(axes["maxDepth"]), "minInfoGain": min(axes["minInfoGain"]),
            }
            (params,) = param_grid(regressor, {name: (value,) for name, value in largest.items()})

            def fit(held_out: int) -> dict[str, np.ndarray]:
                # As arrays at once: the driver's JVM holds the forests that are being fitted, not those of all folds.
                return forest_arrays(regressor.fit(for_trees(vectors.where(F.col(fold) != held_out), n), params))  # noqa: B023

            with ThreadPool(forests_at_once(vectors, n, parallelism)) as pool:
                fitted = pool.map(inheritable_thread_target(df.sparkSession)(fit), folds, chunksize=1)
            found = scores_of_arrays(
                for_trees(vectors, n), dict(zip(folds, fitted, strict=True)), spec.target, fold,
                axes["numTrees"], axes["maxDepth"], axes["minInfoGain"],
            )
            for row in found.orderBy("fold").collect():
                point = others | {
                    "numTrees": row["trees"], "maxDepth": row["depth"], "minInfoGain": axes["minInfoGain"][row["least"]],
                }
                scores.setdefault(_key_of(point), []).append(row)
        best_of = tuple(
            _summarised(point, metric, [row[metric] for row in scores[_key_of(_full(regressor, point))]])
            for metric in metrics
            for point in points
        )
        best = _best([p for p in best_of if p.metric == metrics[0]]).params
        (chosen,) = param_grid(regressor, {name: (value,) for name, value in best.items()})
        stages = [*features.stages, regressor.fit(for_trees(vectors, n), chosen)]
    used = tuple(s.idx for s in slots)
    return CvResult(model, best_of, best, FittedRegression(spec, PipelineModel(stages), slots, used, invalid))


def _full(regressor: Estimator, point: Mapping[str, float]) -> dict[str, float]:
    """A grid point with the nested parameters that the grid leaves out."""
    return {name: regressor.getOrDefault(name) for name in NESTED} | dict(point)


def _key_of(point: Mapping[str, float]) -> tuple:
    return tuple(sorted(point.items()))


def _nested_groups(regressor: Estimator, points: Sequence[Mapping[str, float]]) -> list[tuple[dict, dict]]:
    """(parameters that need forests of their own, values of the nested ones) for all points."""
    groups: dict[tuple, tuple[dict, dict]] = {}
    for point in points:
        full = _full(regressor, point)
        others = {name: value for name, value in full.items() if name not in NESTED}
        own, axes = groups.setdefault((_key_of(others), full["numTrees"] == 1), (others, {n: set() for n in NESTED}))
        for name in NESTED:
            axes[name].add(full[name])
    return [(own, {n: sorted(v) for n, v in axes.items()}) for own, axes in groups.values()]


def cv_report(spark: SparkSession, result: CvResult) -> DataFrame:
    """(model, point, param, value, metric, mean, std): one row for each parameter of each grid point
    and metric; points are numbered from 0 in the order of the grid."""
    numbers: dict[tuple, int] = {}
    rows = []
    for p in result.points:
        point = numbers.setdefault(tuple(p.params.items()), len(numbers))
        for param, value in p.params.items():
            rows.append((result.model, point, param, float(value), p.metric, p.mean, p.std))
    return rows_to_frame(spark, rows, _CV_SCHEMA)


def best_params(spark: SparkSession, result: CvResult) -> DataFrame:
    """(model, param, value) of the grid point with the best mean score."""
    rows = [(result.model, name, float(value)) for name, value in result.best.items()]
    return rows_to_frame(spark, rows, _BEST_SCHEMA)
