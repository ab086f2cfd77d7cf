"""Linear, ridge and random-forest regression on a feature spec."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.base import Estimator, Model
from pyspark.ml.feature import VectorSlicer
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import result_schema, rows_to_frame
from ..spec import FeatureSpec
from . import levels
from .features import (
    FEATURES,
    Slot,
    feature_pipeline,
    feature_slots,
    named_categories,
    prepared,
    require_values,
)
from .gradient import gradient_path
from .moments import DesignMoments, design_moments, ridge_path

PREDICTION = "prediction"
FULL_FEATURES = "all_features"

FOREST_SEED = 42
ROWS_A_PARTITION = 1_000_000


@dataclass(frozen=True)
class LinearFit:
    """A linear or ridge model as numbers: one coefficient for each slot.

    Without a penalty, the levels of a category that every row has are given as differences from
    the mean over the levels, as their common level cannot be told from the intercept.
    """

    spec: FeatureSpec
    slots: tuple[Slot, ...]
    reg_param: float
    intercept: float
    coefficients: np.ndarray
    # Standard deviation of each slot and, last, of the target in the training rows.
    spread: np.ndarray
    invalid: str = "error"


@dataclass(frozen=True)
class FittedRegression:
    """A fitted Spark pipeline with the names that belong to it."""

    spec: FeatureSpec
    pipeline: PipelineModel
    slots: tuple[Slot, ...]
    # Slots that the regressor saw; fewer than ``slots`` where reference levels were left out.
    used: tuple[int, ...]
    invalid: str = "error"
    # As in ``LinearFit``; None for models without coefficients.
    spread: np.ndarray | None = None

    @property
    def regressor(self) -> Model:
        return self.pipeline.stages[-1]


def model_pipeline(spec: FeatureSpec, regressor: Estimator, invalid: str = "error") -> Pipeline:
    """The feature stages and a regressor as one pipeline."""
    return Pipeline(stages=[*feature_pipeline(spec, invalid).getStages(), regressor])


def linear_regressor(spec: FeatureSpec, reg_param: float = 0.0) -> LinearRegression:
    """Ordinary least squares, or ridge (L2) for ``reg_param`` above 0."""
    return LinearRegression(
        featuresCol=FEATURES,
        labelCol=spec.target,
        predictionCol=PREDICTION,
        regParam=reg_param,
        elasticNetParam=0.0,
    )


def forest_regressor(
    spec: FeatureSpec,
    num_trees: int = 25,
    max_depth: int = 9,
    min_info_gain: float = 0.01,
    seed: int = FOREST_SEED,
    **options,
) -> RandomForestRegressor:
    """``options`` are further parameters of Spark's regressor, such as ``bootstrap``."""
    return RandomForestRegressor(
        featuresCol=FEATURES,
        labelCol=spec.target,
        predictionCol=PREDICTION,
        numTrees=num_trees,
        maxDepth=max_depth,
        minInfoGain=min_info_gain,
        seed=seed,
        # Each pass finds the nodes of a row where the last one left them; the trees are the same.
        **{"cacheNodeIds": True, **options},
    )


def for_trees(rows: DataFrame, n: int) -> DataFrame:
    """``n`` rows in as few partitions as keep all cores busy, none much larger than a task holds.

    In every pass each partition sends sums for all open nodes of all trees, however few its rows: what is
    shuffled grows with the partitions. They are a multiple of the cores, so that none waits for the last ones.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.coalesce(cores * max(1, -(-n // (cores * ROWS_A_PARTITION))))


def forests_at_once(rows: DataFrame, n: int, most: int) -> int:
    """How many forests of ``n`` rows to fit at a time: ``most``, or as many as have no more rows than full partitions.

    Each fit keeps its rows with a count and a node for each tree; beyond memory, these go to disk and back in every pass.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return max(1, min(most, cores * ROWS_A_PARTITION // max(n, 1)))


def linear_from_moments(
    moments: DesignMoments, spec: FeatureSpec, reg_param: float, invalid: str = "error"
) -> LinearFit:
    """The linear or ridge model of the rows behind the moments; no row is read."""
    train, slots = moments.total(), moments.slots
    ((intercept, beta),) = ridge_path(train, (reg_param,))
    if reg_param == 0.0:
        intercept = _centred(beta, intercept, spec, slots, moments.never_missing)
    spread = np.sqrt(np.clip(np.diag(train.scatter), 0.0, None) / max(train.n - 1.0, 1.0))
    return LinearFit(spec, slots, reg_param, intercept, beta, spread, invalid)


def _centred(
    beta: np.ndarray, intercept: float, spec: FeatureSpec, slots: Sequence[Slot], never_missing: frozenset[str]
) -> float:
    """Levels as differences from their mean, in place; returns the intercept that goes with them."""
    for field in spec.categorical:
        own = [s.idx for s in slots if s.field == field]
        # Rows without a level hold the intercept apart from the levels.
        if own and field in never_missing:
            centre = float(beta[own].mean())
            beta[own] -= centre
            intercept += centre
    return intercept


def linear_path(
    df: DataFrame, spec: FeatureSpec, grid: Sequence[float], invalid: str = "error"
) -> list[LinearFit]:
    """A fit for each penalty by conjugate gradients, all from the same passes; see ``fit_linear``."""
    slots, fits, spread, full = gradient_path(df, spec, grid, _no_gaps(invalid))
    found = []
    for penalty, (intercept, beta) in zip(grid, fits, strict=True):
        if penalty == 0.0:
            intercept = _centred(beta, intercept, spec, slots, full)
        found.append(LinearFit(spec, slots, penalty, intercept, beta, spread, invalid))
    return found


def fit_linear(
    df: DataFrame,
    spec: FeatureSpec,
    reg_param: float = 0.0,
    invalid: str = "error",
    method: str = "moments",
) -> LinearFit | FittedRegression:
    """Fit least squares (``reg_param`` 0) or ridge on the predictors of ``spec``.

    The model equals that of Spark's ``LinearRegression``, its penalty on standardised predictors
    and target included. ``method="moments"`` solves it from two aggregates over the rows, without
    building vectors; the driver holds slots² numbers. ``method="pipeline"`` is
    ``fit_linear_pipeline``, for models to be served by Spark ML. ``method="gradient"`` is for designs of
    very many slots: the driver holds a few numbers for each, and every step of the solver is one
    aggregate over the rows. The caller chooses; tables and scores of each are the same.
    """
    if method == "pipeline":
        return fit_linear_pipeline(df, spec, reg_param, invalid)
    if method == "gradient":
        return linear_path(df, spec, (reg_param,), invalid)[0]
    if method != "moments":
        raise ValueError(f"method must be 'moments', 'pipeline' or 'gradient', not {method!r}")
    moments = design_moments(df, spec, invalid=_no_gaps(invalid))
    return linear_from_moments(moments, spec, reg_param, invalid)


def _no_gaps(invalid: str) -> str:
    if invalid == "keep":
        raise ValueError("a linear model has no use for missing numbers: 'error' or 'skip'")
    return invalid


def _reference_slots(df: DataFrame, spec: FeatureSpec, slots: list[Slot]) -> set[int]:
    """The first slot of every field without missing values.

    All slots of such a field add up to the intercept. Without a penalty that leaves no unique
    solution, and Spark would iterate over the data many times instead of solving once.
    """
    missing = df.agg(
        *[F.max(F.col(c).isNull().cast("int")).alias(c) for c in spec.categorical]
    ).first()
    first = {}
    for s in slots:
        if s.category is not None and not missing[s.field]:
            first.setdefault(s.field, s.idx)
    return set(first.values())


def fit_linear_pipeline(
    df: DataFrame, spec: FeatureSpec, reg_param: float = 0.0, invalid: str = "error"
) -> FittedRegression:
    """The same fit as a Spark ML pipeline, which can be saved and served as such.

    Without a penalty the most frequent level of each category is the reference level;
    predictions equal those of the design with all levels.
    """
    rows = prepared(df, spec, _no_gaps(invalid))
    features = feature_pipeline(spec, invalid).fit(rows)
    with_features = features.transform(rows)
    slots = feature_slots(with_features, spec)
    left_out = set()
    if reg_param == 0.0 and spec.categorical:
        left_out = _reference_slots(rows, spec, slots)
    used = tuple(s.idx for s in slots if s.idx not in left_out)
    stages = list(features.stages)
    if left_out:
        stages[-1] = stages[-1].copy().setOutputCol(FULL_FEATURES)
        stages.append(
            VectorSlicer(inputCol=FULL_FEATURES, outputCol=FEATURES, indices=list(used))
        )
        with_features = PipelineModel(stages).transform(rows)
    vector = FULL_FEATURES if left_out else FEATURES
    spread = _spreads(with_features, vector, spec.target)
    regressor = linear_regressor(spec, reg_param).fit(with_features)
    return FittedRegression(
        spec, PipelineModel([*stages, regressor]), tuple(slots), used, invalid, spread
    )


def _spreads(rows: DataFrame, vector: str, target: str) -> np.ndarray:
    """Standard deviation of each slot and of the target: one pass, one row to the driver."""
    row = rows.select(
        Summarizer.metrics("variance").summary(F.col(vector)).alias("slots"),
        F.var_samp(F.col(target).cast("double")).alias("target"),
    ).first()
    return np.sqrt(np.append(row["slots"]["variance"].toArray(), row["target"] or 0.0))


def fit_forest(
    df: DataFrame,
    spec: FeatureSpec,
    num_trees: int = 25,
    max_depth: int = 9,
    min_info_gain: float = 0.01,
    seed: int = FOREST_SEED,
    invalid: str = "error",
    **options,
) -> FittedRegression:
    """Fit a random forest on the predictors of ``spec``; see ``forest_regressor``."""
    rows = prepared(df, spec, invalid)
    features = feature_pipeline(spec, invalid).fit(rows)
    with_features = features.transform(rows)
    slots = feature_slots(with_features, spec)
    regressor = forest_regressor(spec, num_trees, max_depth, min_info_gain, seed, **options)
    forest = regressor.fit(for_trees(with_features.select(FEATURES, spec.target), rows.count()))
    return FittedRegression(
        spec,
        PipelineModel([*features.stages, forest]),
        tuple(slots),
        tuple(s.idx for s in slots),
        invalid,
    )


def score(model: LinearFit | FittedRegression, df: DataFrame) -> DataFrame:
    """The rows as they are, with a ``prediction`` column; no shuffle of a hot level, and no target needed."""
    return score_all({PREDICTION: model}, df)


def score_all(models: Mapping[str, LinearFit | FittedRegression], df: DataFrame) -> DataFrame:
    """The rows as they are, with a column of predictions for each model, by its name, from one read.

    Linear models share one lookup for each category field, whose rows hold the effects in all of
    them. A row that a model skips (``invalid="skip"``) is left out for all.
    """
    for model in models.values():
        missing = [c for c in model.spec.predictors if c not in df.columns]
        if missing:
            raise ValueError(f"columns not in the table: {missing}")
    rows = df.select(F.struct(*df.columns).alias("__row"))
    linear = {name: m for name, m in models.items() if isinstance(m, LinearFit)}
    if linear:
        rows = _score_linear(linear, rows)
    for name, model in models.items():
        if name not in linear:
            spec = model.spec
            # The pipeline adds columns of its own; what is known so far waits in a struct.
            held = rows.select(F.struct(*rows.columns).alias("__held"))
            flat = held.select("__held", *[F.col(f"__held.__row.`{c}`").alias(c) for c in spec.predictors])
            flat = require_values(named_categories(flat, spec.categorical), spec.numeric, model.invalid)
            scored = model.pipeline.transform(flat)
            rows = scored.select("__held.*", F.col(PREDICTION).alias(name))
    return rows.select("__row.*", *models)


def _score_linear(models: Mapping[str, LinearFit], rows: DataFrame) -> DataFrame:
    """Coefficients times numbers, plus the effect of each level from a lookup table.

    A missing or unseen category adds nothing.
    """
    specs = [m.spec for m in models.values()]
    categorical = list(dict.fromkeys(c for spec in specs for c in spec.categorical))
    numeric = list(dict.fromkeys(c for spec in specs for c in spec.numeric))
    flat = rows.select(*rows.columns, *[F.col(f"__row.`{c}`").alias(c) for c in [*categorical, *numeric]])
    flat = named_categories(flat, categorical)
    for model in models.values():
        flat = require_values(flat, model.spec.numeric, model.invalid)
    predictions = {name: F.lit(float(m.intercept)) for name, m in models.items()}
    for i, field in enumerate(categorical):
        effects: dict[str, dict[str, float]] = {}
        for name, model in models.items():
            for s in model.slots:
                if s.field == field and s.category is not None:
                    effects.setdefault(s.category, {})[name] = float(model.coefficients[s.idx])
        flat = _with_effects(flat, field, i, effects, list(models))
        for k, name in enumerate(models):
            if field in models[name].spec.categorical:
                predictions[name] = predictions[name] + F.coalesce(F.col(f"__effect{i}_{k}"), F.lit(0.0))
    for name, model in models.items():
        for s in model.slots:
            if s.category is None:
                predictions[name] = predictions[name] + F.col(s.name) * F.lit(float(model.coefficients[s.idx]))
    return flat.select(*rows.columns, *[p.alias(name) for name, p in predictions.items()])


def _with_effects(
    rows: DataFrame, field: str, i: int, effects: Mapping[str, Mapping[str, float]], names: Sequence[str]
) -> DataFrame:
    """Columns __effect<i>_<k>: the effect of the row's level of ``field`` in each model.

    Levels come by falling frequency, so the first ones hold every level with more than its share.
    """
    columns = [f"__effect{i}_{k}" for k in range(len(names))]
    schema = result_schema(level=T.StringType(), **{c: T.DoubleType() for c in columns})
    listed = [(level, *[by.get(name) for name in names]) for level, by in effects.items()]
    hot = rows_to_frame(rows.sparkSession, listed[: levels.HOT_LEVELS], schema)
    rest = listed[levels.HOT_LEVELS :]
    cold = rows_to_frame(rows.sparkSession, rest, schema) if rest else None
    return levels.joined_levels(rows, field, hot, cold, columns, F.xxhash64("__row"))
