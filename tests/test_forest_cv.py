import gc
import uuid
import weakref

import pytest
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from keydrivers import FeatureSpec
from keydrivers import operators as ops
from keydrivers.operators import models

SPEC = FeatureSpec(numeric=("x", "z"), categorical=("kind",), target="y")
GRID = {"numTrees": (2, 3), "maxDepth": (1, 2), "minInfoGain": (0.0,)}


def table(spark, parts: int):
    mixed = F.xxhash64("id") % 97
    return spark.range(0, 600, 1, parts).select(
        (F.col("id") % 3).cast("int").alias("fold"),
        mixed.cast("double").alias("x"),
        (F.col("id") * 31 % 17).cast("double").alias("z"),
        F.when(F.col("id") % 5 == 0, None).otherwise((F.col("id") * 7 % 4).cast("string")).alias("kind"),
        (mixed * 3 + F.col("id") * 7 % 4).cast("double").alias("y"),
    )


@pytest.mark.parametrize("method", ["nested", "refit"])
def test_rows_are_computed_once(spark, tmp_path, method):
    folder = str(tmp_path)

    def watched(batches):
        open(f"{folder}/{uuid.uuid4()}", "w").close()
        yield from batches

    rows = table(spark, 2)
    ops.forest_cv(rows.mapInArrow(watched, rows.schema), SPEC, GRID, method=method)
    assert len(list(tmp_path.iterdir())) == 2


@pytest.mark.parametrize("method", ["nested", "refit"])
def test_trees_meet_rows_in_the_order_of_their_predictors(spark, monkeypatch, method):
    seen = []
    fit = RandomForestRegressor.fit

    def watched(self, rows, params=None):
        seen.append([[tuple(r.features.toArray()) for r in part] for part in rows.rdd.glom().collect()])
        return fit(self, rows, params)

    monkeypatch.setattr(RandomForestRegressor, "fit", watched)
    ops.forest_cv(table(spark, 3), SPEC, GRID, method=method)
    # Categories come as slots: within one category the numbers must rise, and each category must be one run.
    for parts in seen:
        for part in parts:
            runs = [p[:-2] for i, p in enumerate(part) if i == 0 or p[:-2] != part[i - 1][:-2]]
            assert len(runs) == len(set(runs))
            assert all(a[-2:] <= b[-2:] for a, b in zip(part, part[1:]) if a[:-2] == b[:-2])
    assert sum(len(part) for part in seen[-1]) == 600


def test_forests_of_the_folds_are_not_held_in_the_driver(spark, monkeypatch):
    alive, most = [], []
    fit = RandomForestRegressor.fit

    def watched(self, rows, params=None):
        gc.collect()
        most.append(sum(ref() is not None for ref in alive))
        model = fit(self, rows, params)
        alive.append(weakref.ref(model))
        return model

    monkeypatch.setattr(RandomForestRegressor, "fit", watched)
    ops.forest_cv(table(spark, 1), SPEC, GRID, parallelism=1)
    assert len(most) == 4
    assert max(most) <= 1


def test_partitions_and_fits_by_size(spark, monkeypatch):
    monkeypatch.setattr(models, "ROWS_A_PARTITION", 10)
    cores = spark.sparkContext.defaultParallelism
    rows = spark.range(0, 600, 1, 4 * cores)
    found = {n: models.for_trees(rows, n).rdd.getNumPartitions() for n in (0, 10 * cores, 10 * cores + 1, 20 * cores + 1)}
    assert list(found.values()) == [cores, cores, 2 * cores, 3 * cores]
    assert [models.forests_at_once(rows, n, 4) for n in (0, cores, 5 * cores, 10 * cores, 100 * cores)] == [4, 4, 2, 1, 1]
