from __future__ import annotations

import re
from pathlib import Path

import numpy as np
import pytest
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

import keydrivers
from keydrivers import operators as ops
from keydrivers.operators.forest_path import forest_nodes, nested_scores
from keydrivers.operators.moments import Moments, ridge_path
from keydrivers.plans import (
    STRONG_SPEC,
    VEHICLE_SPEC,
    analyse_vehicles,
    write_results,
)
from keydrivers.sources import read_table
from workload.fixtures import NUMERIC_SPEC, ORDER_KEY, ORDER_SPEC, PRIORITY_SPEC
from workload.queries import QUERIES

GRID = (0.5, 1.5, 20_000.0)


@pytest.fixture(scope="module")
def folded(orders):
    return ops.assign_folds(orders, ["o_orderkey"], 3).persist()


@pytest.mark.parametrize("metric, tolerance", [("r2", 1e-9), ("rmse", 1e-9)])
@pytest.mark.parametrize("spec", [NUMERIC_SPEC, ORDER_SPEC], ids=["numeric", "full"])
def test_moments_give_the_scores_of_refitting(folded, spec, metric, tolerance):
    ours = ops.ridge_cv(folded, spec, GRID, metrics=(metric,))
    theirs = ops.cross_validate(
        folded, spec, ops.linear_regressor(spec), {"regParam": GRID}, metrics=(metric,), parallelism=4
    )
    for a, b in zip(ours.points, theirs.points):
        assert a.params == b.params
        assert a.mean == pytest.approx(b.mean, rel=tolerance)
        assert a.std == pytest.approx(b.std, rel=1e-6)
    assert ours.best == theirs.best


def test_missing_categories_and_absent_levels(folded):
    holes = folded.withColumn(
        "o_orderpriority",
        F.when(F.col("o_orderpriority") == "5-LOW", None)
        # A level that only one fold has.
        .when((F.col("fold") == 1) & (F.col("o_orderkey") % 7 == 0), "rare")
        .otherwise(F.col("o_orderpriority")),
    )
    ours = ops.ridge_cv(holes, PRIORITY_SPEC, GRID)
    theirs = ops.cross_validate(
        holes, PRIORITY_SPEC, ops.linear_regressor(PRIORITY_SPEC), {"regParam": GRID}, parallelism=4
    )
    for a, b in zip(ours.points, theirs.points):
        assert a.mean == pytest.approx(b.mean, rel=1e-9)


def test_moments_of_parts_add_up():
    rng = np.random.default_rng(0)
    rows = rng.normal(50, 3, (40, 4))

    def moments(x):
        return Moments(len(x), x.mean(0), (x - x.mean(0)).T @ (x - x.mean(0)))

    total = moments(rows[:13]) + moments(rows[13:])
    assert total.n == 40
    assert total.mean == pytest.approx(moments(rows).mean)
    assert total.scatter == pytest.approx(moments(rows).scatter)


def test_path_with_repeated_and_constant_slots():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 2))
    y = x @ [2.0, -1.0] + 5
    rows = np.column_stack([x, x[:, 0], np.full(200, 3.0), y])
    train = Moments(200, rows.mean(0), (rows - rows.mean(0)).T @ (rows - rows.mean(0)))
    ((intercept, beta),) = ridge_path(train, (0.0,))
    assert intercept + rows[:, :-1] @ beta == pytest.approx(y)
    assert beta[3] == 0.0


def test_jobs_do_not_grow_with_the_grid(spark, folded):
    def jobs(grid, group):
        spark.sparkContext.setJobGroup(group, group)
        ops.ridge_cv(folded, ORDER_SPEC, grid)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    folded.count()
    few, many = jobs((0.1,), "one-penalty"), jobs(tuple(range(1, 40)), "many-penalties")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < few == many


def test_both_methods_give_the_same(spark, folded):
    how = {"grid": (0.0, 1.5, 20_000.0), "metrics": ("r2", "rmse")}
    ours = ops.ridge_cv(folded, PRIORITY_SPEC, **how)
    theirs = ops.ridge_cv(folded, PRIORITY_SPEC, **how, method="pipeline", parallelism=4)
    assert len(theirs.points) == 6
    for a, b in zip(ours.points, theirs.points):
        assert (a.params, a.metric) == (b.params, b.metric)
        assert (a.mean, a.std) == pytest.approx((b.mean, b.std), rel=1e-6)
    assert theirs.best == ours.best
    one, two = (
        ops.coefficient_table(spark, r.fitted, intercept=True).orderBy("feature").toPandas()
        for r in (ours, theirs)
    )
    for c in ("coefficient", "std_coefficient"):
        assert one[c].tolist() == pytest.approx(two[c].tolist(), rel=1e-5, abs=1e-3, nan_ok=True)


def test_arguments_are_checked(folded):
    with pytest.raises(ValueError, match="mae"):
        ops.ridge_cv(folded, PRIORITY_SPEC, metrics=("mae",))
    with pytest.raises(ValueError, match="missing numbers"):
        ops.ridge_cv(folded, PRIORITY_SPEC, invalid="keep")
    holes = folded.withColumn("n_lines", F.when(F.col("n_lines") > 1, F.col("n_lines")))
    with pytest.raises(Exception, match="no number in column 'n_lines'"):
        ops.ridge_cv(holes, PRIORITY_SPEC)


def test_cv_report_and_best(spark, folded):
    result = ops.ridge_cv(folded, PRIORITY_SPEC, GRID, metrics=("rmse", "r2"))
    rows = ops.cv_report(spark, result).collect()
    assert len(rows) == 2 * len(GRID)
    assert {r["metric"] for r in rows} == {"r2", "rmse"}
    least = min((r for r in rows if r["metric"] == "rmse"), key=lambda r: r["mean"])
    assert ops.best_params(spark, result).first()["value"] == least["value"]


def test_forest_grid(spark, folded):
    grid = {"numTrees": (3, 5), "maxDepth": (2,), "minInfoGain": (0.01,)}
    result = ops.forest_cv(folded, PRIORITY_SPEC, grid, parallelism=4)
    rows = ops.cv_report(spark, result).collect()
    assert [(r["point"], r["param"], r["value"]) for r in rows] == [
        (0, "numTrees", 3.0),
        (0, "maxDepth", 2.0),
        (0, "minInfoGain", 0.01),
        (1, "numTrees", 5.0),
        (1, "maxDepth", 2.0),
        (1, "minInfoGain", 0.01),
    ]
    best = {r["param"]: r["value"] for r in ops.best_params(spark, result).collect()}
    forest = result.fitted.regressor
    assert (forest.getNumTrees, forest.getMaxDepth()) == (best["numTrees"], best["maxDepth"])
    assert ops.score(result.fitted, folded).count() == folded.count()


def test_points_of_a_nested_forest_are_its_cuts(spark, orders):
    """Scores of the largest point are Spark's own; fewer trees, less depth and more gain cut the same trees."""
    rows = ops.assign_folds(orders, ORDER_KEY, 2).persist()
    grid = {"numTrees": (2, 5), "maxDepth": (0, 2, 4), "minInfoGain": (0.0, 1e8)}
    found = ops.forest_cv(rows, ORDER_SPEC, grid, metrics=("r2", "rmse", "mae"))
    means = {(*p.params.values(), p.metric): p.mean for p in found.points}
    assert len(means) == 36
    refitted = ops.forest_cv(
        rows, ORDER_SPEC, {"numTrees": (5,), "maxDepth": (4,), "minInfoGain": (0.0,)}, metrics=("r2", "rmse", "mae"), method="refit"
    )
    for p in refitted.points:
        assert means[5, 4, 0.0, p.metric] == pytest.approx(p.mean, rel=1e-9)
    # Depth 0 is the mean of each tree's sample; more depth explains more.
    assert abs(means[5, 0, 0.0, "r2"]) < 0.02
    assert means[5, 2, 0.0, "r2"] < means[5, 4, 0.0, "r2"]
    assert means[2, 4, 1e8, "r2"] != means[2, 4, 0.0, "r2"]
    assert found.best in [p.params for p in found.points]
    assert found.fitted.regressor.getNumTrees == found.best["numTrees"]
    with pytest.raises(ValueError, match="nested"):
        ops.forest_cv(rows, ORDER_SPEC, grid, method="other")


def test_cuts_by_hand(spark, orders):
    """A point below the largest one equals a walk over the nodes of the saved forest."""
    rows = ops.assign_folds(orders, ORDER_KEY, 2).persist()
    model = ops.fit_forest(rows, ORDER_SPEC, num_trees=3, max_depth=4, min_info_gain=0.0)
    vectors = model.pipeline.transform(ops.prepared(rows, ORDER_SPEC)).select("features", "target", "fold")
    nodes = {(r.tree, r.node): r for r in forest_nodes(model.regressor).collect()}

    def cut(x, trees, depth, gain):
        total = 0.0
        for t in range(trees):
            node = nodes[t, 0]
            for _ in range(depth):
                if node.left < 0 or node.gain < gain:
                    break
                left = x[node.feature] in node.categories if node.threshold is None else x[node.feature] <= node.threshold
                node = nodes[t, node.left if left else node.right]
            total += node.prediction
        return total / trees

    scores = nested_scores(vectors, {0: model.regressor, 1: model.regressor}, "target", "fold", (1, 3), (1, 3), (0.0, 1e9))
    found = {(r.fold, r.trees, r.depth, r.least): r for r in scores.collect()}
    data = vectors.collect()
    for fold, trees, depth, least in found:
        own = [(r.target, cut(r.features.toArray(), trees, depth, (0.0, 1e9)[least])) for r in data if r.fold == fold]
        errors = [y - p for y, p in own]
        row = found[fold, trees, depth, least]
        assert row.n == len(own)
        assert row.mae == pytest.approx(sum(map(abs, errors)) / len(errors))
        assert row.rmse == pytest.approx((sum(e * e for e in errors) / len(errors)) ** 0.5)
    assert len(found) == 16


def test_whole_vehicle_analysis(spark, vehicles, tmp_path):
    grid = {"numTrees": (5,), "maxDepth": (4,), "minInfoGain": (0.01,)}
    found = analyse_vehicles(vehicles, forest_grid=grid, folds=3, parallelism=4)
    board = found.leaderboard.collect()
    assert {(r["model"], r["split"]) for r in board} == {
        (m, s) for m in ("numeric", "full", "strong", "forest") for s in ("train", "test")
    }
    assert all(r["r2"] > 0.5 for r in board)
    assert found.cv.count() == 3 * 2 * len(ops.RIDGE_GRID) + 3
    assert {r["column"] for r in found.nulls.collect()} == set(vehicles.columns) - {
        "CO2_rating",
        "smog_rating",
    }
    assert found.cardinality.count() == len(found.values) == len(VEHICLE_SPEC.categorical) + 1
    assert found.values["model"].count() > 0
    assert found.collinear.where("abs_r < 0.75").count() == 0
    assert found.box.first()["n"] == found.distribution["make"].agg({"n": "sum"}).first()[0]
    assert abs(found.field_importance.agg({"importance": "sum"}).first()[0] - 1) < 1e-9
    assert found.residuals["full"].where("residual is null").count() == 0
    assert found.rollups["strong"].count() == len(STRONG_SPEC.predictors)
    paths = write_results(found, str(tmp_path))
    matrix = read_table(spark, paths["correlation"])
    assert matrix.columns == ["feature", *VEHICLE_SPEC.measures]
    assert matrix.count() == len(VEHICLE_SPEC.measures)


def test_no_rows_are_collected_in_the_library():
    """Driver-side results are bounded by columns, slots or groups, in these files only."""
    allowed = {"profile.py": 1, "quantiles.py": 1, "moments.py": 1, "tuning.py": 3}
    root = Path(keydrivers.__file__).parent
    for path in root.rglob("*.py"):
        if path.parent.name == "llm":
            continue
        text = path.read_text()
        assert not re.search(r"toPandas|localCheckpoint|crossJoin|toLocalIterator|\.rdd\b", text), path
        assert len(re.findall(r"\.collect\(\)", text)) == allowed.get(path.name, 0), path


def test_forests_are_fitted_on_few_partitions(spark, folded, monkeypatch):
    """Each partition sends sums for all nodes in every pass, so small rows must not come in many."""
    seen = []
    fit = RandomForestRegressor.fit

    def watched(self, rows, params=None):
        seen.append(rows.rdd.getNumPartitions())
        return fit(self, rows, params)

    monkeypatch.setattr(RandomForestRegressor, "fit", watched)
    cores = spark.sparkContext.defaultParallelism
    rows = folded.repartition(cores + 30)
    grid = {"numTrees": (2,), "maxDepth": (1,), "minInfoGain": (0.0,)}
    for method in ("nested", "refit"):
        ops.forest_cv(rows, PRIORITY_SPEC, grid, method=method)
    ops.fit_forest(rows, PRIORITY_SPEC, num_trees=2, max_depth=1)
    assert len(seen) == 9
    assert max(seen) <= cores


@pytest.mark.parametrize("name", ["forest_overfit", "leaderboard"])
def test_reports_of_forests_join_no_rows_again(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).inputFiles() == []
