from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.sql import functions as F
from vehicle_data import SLOPES

from keydrivers import FeatureSpec
from keydrivers import operators as ops
from keydrivers.operators.explain import INTERCEPT, effects
from keydrivers.plans import STRONG_SPEC, VEHICLE_SPEC
from workload.fixtures import NUMERIC_SPEC, ORDER_SPEC, PRIORITY_SPEC


def test_metrics_equal_spark_evaluator(orders):
    model = ops.fit_linear(orders, NUMERIC_SPEC)
    scored = ops.score(model, orders)
    found = ops.regression_metrics(scored, "target").first()
    for name in ("rmse", "mae", "r2"):
        evaluator = RegressionEvaluator(labelCol="target", metricName=name)
        assert found[name] == pytest.approx(evaluator.evaluate(scored), rel=1e-10)
    assert found["n"] == orders.count()


def test_metrics_of_a_constant_target_have_no_r2(spark):
    df = spark.createDataFrame([(1.0, 1.5), (1.0, 0.5), (None, 3.0)], "y double, prediction double")
    found = ops.regression_metrics(df, "y").first()
    assert (found["n"], found["rmse"], found["mae"], found["r2"]) == (2, 0.5, 0.5, None)


@pytest.mark.parametrize("penalty", [0.0, 1.5, 20_000.0])
def test_numeric_fit_equals_closed_form(orders, penalty):
    model = ops.fit_linear(orders, NUMERIC_SPEC, penalty)
    pdf = orders.select(*NUMERIC_SPEC.columns).toPandas().astype("float64")
    x, y = pdf[list(NUMERIC_SPEC.numeric)].to_numpy(), pdf["target"].to_numpy()
    cov = np.cov(x.T, bias=True)
    left = cov + np.diag(np.diag(cov)) * penalty / y.std()
    right = ((x - x.mean(0)) * (y - y.mean())[:, None]).mean(0)
    expected = np.linalg.solve(left, right)
    assert model.coefficients == pytest.approx(expected, rel=1e-7)
    pipeline = ops.fit_linear_pipeline(orders, NUMERIC_SPEC, penalty)
    assert pipeline.regressor.coefficients.toArray() == pytest.approx(expected, rel=1e-6)


def test_common_slope_with_own_level_by_group(orders):
    model = ops.fit_linear(orders, PRIORITY_SPEC)
    pdf = orders.select(*PRIORITY_SPEC.columns).toPandas()
    groups = pdf.groupby("o_orderpriority")
    dx = pdf["n_lines"] - groups["n_lines"].transform("mean")
    dy = pdf["target"] - groups["target"].transform("mean")
    slope = (dx * dy).sum() / (dx * dx).sum()
    intercept, beta = effects(model)
    by_slot = {s.name: beta[s.idx] for s in model.slots}
    assert by_slot["n_lines"] == pytest.approx(slope, rel=1e-9)
    levels = groups["target"].mean() - slope * groups["n_lines"].mean()
    assert intercept == pytest.approx(levels.mean(), rel=1e-6)
    for level, value in levels.items():
        found = by_slot[f"o_orderpriority_vec_{level}"]
        assert found == pytest.approx(value - levels.mean(), abs=1e-5)


@pytest.mark.parametrize("penalty", [0.0, 20_000.0])
def test_moments_and_pipeline_give_the_same_model(orders, penalty):
    holes = orders.withColumn(
        "c_mktsegment", F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment"))
    )
    ours = ops.fit_linear(holes, ORDER_SPEC, penalty)
    theirs = ops.fit_linear_pipeline(holes, ORDER_SPEC, penalty)
    assert ours.slots == theirs.slots
    spark = orders.sparkSession
    a = ops.coefficient_table(spark, ours, intercept=True).orderBy("feature").collect()
    b = ops.coefficient_table(spark, theirs, intercept=True).orderBy("feature").collect()
    for x, y in zip(a, b):
        assert x["coefficient"] == pytest.approx(y["coefficient"], rel=1e-6, abs=1e-3)
        if x["feature"] != INTERCEPT:
            assert x["std_coefficient"] == pytest.approx(y["std_coefficient"], abs=1e-9)
    both = (
        ops.score(ours, holes)
        .select("o_orderkey", F.col("prediction").alias("a"))
        .join(ops.score(theirs, holes).select("o_orderkey", "prediction"), "o_orderkey")
    )
    assert both.count() == holes.count()
    assert both.agg(F.max(F.abs(F.col("a") - F.col("prediction")))).first()[0] < 1e-3


def test_wide_design_gives_the_same_with_and_without_vectors(orders):
    """More measures than one compiled aggregate takes."""
    extra = {f"x{i}": F.sin(F.col("o_orderkey") * (i + 1)) for i in range(14)}
    wide = orders.withColumns(extra)
    spec = FeatureSpec(("n_lines", *extra), ("o_orderpriority",), "target")
    ours = ops.fit_linear(wide, spec, 1.5).coefficients
    theirs = ops.fit_linear_pipeline(wide, spec, 1.5).regressor.coefficients.toArray()
    assert ours == pytest.approx(theirs, rel=1e-6, abs=1e-4)


@pytest.mark.parametrize("levels", [2_001, 2_100])
def test_many_levels(spark, levels):
    """The slope is exact within levels, and each level has its own effect."""
    rows = spark.range(4 * levels).select(
        (F.col("id") % levels).cast("string").alias("c"),
        (F.col("id") % 11).cast("double").alias("x"),
        ((F.col("id") % levels) * 0.5 + (F.col("id") % 11) * 3.0).alias("y"),
    )
    spec = FeatureSpec(("x",), ("c",), "y")
    model = ops.fit_linear(rows, spec)
    table = ops.coefficient_table(spark, model).toPandas().set_index("feature")
    assert len(table) == levels + 1
    assert table.coefficient["x"] == pytest.approx(3.0)
    assert table.coefficient["c_vec_10"] - table.coefficient["c_vec_0"] == pytest.approx(5.0)
    assert table.std_coefficient.notna().all()
    scored = ops.score(model, rows)
    assert scored.agg(F.max(F.abs(F.col("y") - F.col("prediction")))).first()[0] < 1e-6


def test_small_units_keep_their_coefficient(spark):
    rows = spark.range(500).select(
        (F.rand(1) * 1e-11).alias("x"), F.rand(2).alias("z")
    ).withColumn("y", F.col("x") * 3e11 + F.col("z"))
    model = ops.fit_linear(rows.persist(), FeatureSpec(("x", "z"), (), "y"))
    assert model.coefficients == pytest.approx([3e11, 1.0], rel=1e-6)


def test_a_category_called_empty_is_not_the_empty_text(spark):
    rows = spark.createDataFrame([("", 1.0), ("(empty)", 2.0), ("((empty))", 3.0)] * 5, "c string, y double")
    model = ops.fit_linear(rows, FeatureSpec((), ("c",), "y"), 0.0)
    assert sorted(s.category for s in model.slots) == ["(((empty)))", "((empty))", "(empty)"]
    assert {(r.c, round(r.prediction, 6)) for r in ops.score(model, rows).collect()} == {("", 1.0), ("(empty)", 2.0), ("((empty))", 3.0)}


def test_unpenalised_fit_is_one_solve_not_many_iterations(orders):
    model = ops.fit_linear_pipeline(orders, ORDER_SPEC)
    assert len(model.used) == len(model.slots) - len(ORDER_SPEC.categorical)
    assert model.regressor.summary.totalIterations <= 1


def test_predictions_equal_those_of_the_design_with_all_levels(orders):
    ours = ops.score(ops.fit_linear(orders, ORDER_SPEC), orders)
    rows = ops.prepared(orders, ORDER_SPEC)
    regressor = ops.linear_regressor(ORDER_SPEC).setTol(1e-12)
    theirs = ops.model_pipeline(ORDER_SPEC, regressor).fit(rows).transform(rows)
    both = ours.select("o_orderkey", F.col("prediction").alias("a")).join(
        theirs.select("o_orderkey", F.col("prediction").alias("b")), "o_orderkey"
    )
    assert both.agg(F.max(F.abs(F.col("a") - F.col("b")))).first()[0] < 1.0


def test_missing_category_is_a_level_of_its_own(orders):
    holes = orders.withColumn(
        "o_orderpriority", F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority"))
    )
    model = ops.fit_linear_pipeline(holes, PRIORITY_SPEC)
    # Rows without a level carry the intercept, so no level has to be left out.
    assert len(model.used) == len(model.slots) == 5
    whole = ops.fit_linear(orders, PRIORITY_SPEC)
    a = ops.regression_metrics(ops.score(model, holes), "target").first()["r2"]
    b = ops.regression_metrics(ops.score(whole, orders), "target").first()["r2"]
    assert a == pytest.approx(b, rel=1e-9)


def test_richer_model_fits_the_training_rows_no_worse(vehicles):
    def r2(spec):
        return ops.model_metrics(ops.fit_linear(vehicles, spec), vehicles, "m", "train").first()["r2"]

    strong, full = r2(STRONG_SPEC), r2(VEHICLE_SPEC)
    assert 0.9 < strong <= full


def test_norm_of_standardised_coefficients_falls_with_the_penalty(orders):
    norms = []
    for penalty in (0.0, 20_000.0, 200_000.0):
        model = ops.fit_linear(orders, NUMERIC_SPEC, penalty)
        table = ops.coefficient_table(orders.sparkSession, model)
        norms.append(sum(r["std_coefficient"] ** 2 for r in table.collect()))
    assert norms == sorted(norms, reverse=True)


def test_scoring_leaves_the_columns_alone_and_needs_no_target(vehicles):
    model = ops.fit_linear(vehicles, VEHICLE_SPEC)
    scored = ops.score(model, vehicles)
    assert scored.columns == [*vehicles.columns, "prediction"]
    assert scored.drop("prediction").exceptAll(vehicles).count() == 0
    new = ops.score(model, vehicles.drop("CO2_emission_gkm"))
    assert new.select("prediction").exceptAll(scored.select("prediction")).count() == 0
    with pytest.raises(ValueError, match="cylinders"):
        ops.score(model, vehicles.drop("cylinders"))


def test_fitted_pipeline_can_be_saved(spark, vehicles, tmp_path):
    model = ops.fit_linear_pipeline(vehicles, VEHICLE_SPEC)
    model.pipeline.write().overwrite().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m"))
    rows = ops.prepared(vehicles, VEHICLE_SPEC)
    a = again.transform(rows).agg(F.sum("prediction")).first()[0]
    b = ops.score(model, vehicles).agg(F.sum("prediction")).first()[0]
    assert a == pytest.approx(b)


def test_coefficients_rank_planted_effects(spark, vehicles):
    table = ops.coefficient_table(spark, ops.fit_linear(vehicles, STRONG_SPEC), intercept=True)
    rows = {r["feature"]: r for r in table.collect()}
    assert INTERCEPT in rows
    best = max(SLOPES, key=SLOPES.get)
    fuels = {r["category"]: r["coefficient"] for r in rows.values() if r["field"] == "fuel_type"}
    assert max(fuels, key=fuels.get) == best
    assert sum(fuels.values()) == pytest.approx(0.0, abs=1e-6)
    strengths = [r["abs_coefficient"] for r in table.collect()]
    assert strengths == sorted(strengths, reverse=True)


def test_rollup_equals_pandas(spark, vehicles):
    table = ops.coefficient_table(spark, ops.fit_linear(vehicles, VEHICLE_SPEC, 0.5), intercept=True)
    pdf = table.where(F.col("feature") != INTERCEPT).toPandas()
    expected = pdf.groupby("field")["abs_coefficient"].agg(["mean", "sum", "median"])
    found = ops.field_rollup(table).collect()
    assert len(found) == len(expected)
    for r in found:
        assert tuple(r)[1:] == pytest.approx(tuple(expected.loc[r["field"]]))


def test_slot_table(spark, vehicles):
    model = ops.fit_linear(vehicles, STRONG_SPEC)
    rows = ops.slot_table(spark, model).collect()
    assert [r["idx"] for r in rows] == list(range(6))
    assert rows[-1]["slot"] == rows[-1]["field"] == "fuel_cons_comb_L100km"


@pytest.fixture(scope="module")
def forest(vehicles):
    return ops.fit_forest(vehicles, VEHICLE_SPEC, num_trees=10, max_depth=7)


def test_importances_have_the_right_names(spark, forest):
    slots = ops.feature_importance(spark, forest)
    rows = slots.collect()
    assert [r["rank"] for r in rows] == list(range(1, len(forest.slots) + 1))
    assert sum(r["importance"] for r in rows) == pytest.approx(1.0)
    assert rows[0]["field"].startswith("fuel_cons")
    # By position and not by the order of input columns.
    values = forest.regressor.featureImportances.toArray()
    assert {r["feature"]: r["importance"] for r in rows} == {
        s.name: values[s.idx] for s in forest.slots
    }
    fields = {r["field"]: r["importance"] for r in ops.importance_by_field(slots).collect()}
    assert set(fields) == set(VEHICLE_SPEC.predictors)
    assert sum(fields.values()) == pytest.approx(1.0)


def test_forest_fits_and_reports_both_sides(vehicles):
    marked = ops.mark_split(vehicles)
    model = ops.fit_forest(marked.where("split = 'train'"), VEHICLE_SPEC, 10, 7)
    report = {r["split"]: r for r in ops.overfit_report(model, marked, "forest").collect()}
    assert report["train"]["r2"] > report["test"]["r2"] > 0.8
    assert report["train"]["n"] + report["test"]["n"] == vehicles.count()


def test_residuals(vehicles):
    scored = ops.score(ops.fit_linear(vehicles, STRONG_SPEC), vehicles)
    found = ops.residual_table(scored, "CO2_emission_gkm", ("model_year",))
    assert found.columns == ["model_year", "actual", "prediction", "residual"]
    assert found.agg(F.avg("residual")).first()[0] == pytest.approx(0.0, abs=1e-8)


def test_numeric_only_and_categorical_only_specs(vehicles):
    only = FeatureSpec((), ("fuel_type", "make"), "CO2_emission_gkm")
    assert len(ops.fit_linear(vehicles, only).slots) == 9
    assert len(ops.fit_linear_pipeline(vehicles, only).used) == 7
    assert len(ops.fit_linear(vehicles, FeatureSpec(("cylinders",), (), only.target)).slots) == 1


def test_many_models_in_one_read(spark, orders):
    """Reports and predictions of all models equal those of each; the rows are read once."""
    marked = ops.mark_split(orders, ["o_orderkey"]).persist()
    train = marked.where("split = 'train'")
    models = {
        "numeric": ops.fit_linear(train, NUMERIC_SPEC),
        "target": ops.fit_linear(train, ORDER_SPEC, 20_000.0),
        "pipeline": ops.fit_linear(train, PRIORITY_SPEC, method="pipeline"),
        "forest": ops.fit_forest(train, ORDER_SPEC, num_trees=3, max_depth=3),
    }
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    found = {(r.model, r.split): r for r in ops.overfit_reports(models, marked.mapInArrow(count, marked.schema)).collect()}
    assert seen.value == marked.count()
    assert len(found) == 8
    for name, model in models.items():
        for r in ops.overfit_report(model, marked, name).collect():
            other = found[name, r.split]
            assert r.n == other.n
            for c in ("rmse", "mae", "r2"):
                assert other[c] == pytest.approx(r[c], rel=1e-9)
    scored = ops.score_all({"a": models["forest"], "b": models["target"]}, marked)
    assert scored.columns == [*marked.columns, "a", "b"]
    one = {r.o_orderkey: r.prediction for r in ops.score(models["forest"], marked).collect()}
    assert {r.o_orderkey: r.a for r in scored.collect()} == pytest.approx(one)


def test_lookup_beyond_the_broadcast_levels(spark, monkeypatch):
    """A level on a third of the rows, nulls on another: no task gets more than its share."""
    monkeypatch.setattr("keydrivers.operators.levels.HOT_LEVELS", 3)
    level = "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 3 = 1 THEN NULL ELSE concat('l', id % 500) END"
    rows = spark.range(30_000).selectExpr("id", f"{level} AS level", "id % 17 AS x", "id % 17 * 2.0 + id % 500 AS y")
    spec = FeatureSpec(("x",), ("level",), "y")
    model = ops.fit_linear(rows, spec)
    found = ops.score(model, rows.where("id < 29000"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        dealt = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
        assert len(dealt) == 8 and max(dealt) < 1.6 * sum(dealt) / 8
        scored = {r.id: r.prediction for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    monkeypatch.undo()
    expected = {r.id: r.prediction for r in ops.score(model, rows.where("id < 29000")).collect()}
    assert scored == pytest.approx(expected) and len(scored) == 29_000


def test_too_many_slots_for_the_driver(spark, monkeypatch):
    monkeypatch.setattr("keydrivers.operators.moments.MOST_BYTES", 10_000)
    rows = spark.range(500).selectExpr("CAST(id % 100 AS STRING) AS level", "id * 1.0 AS x", "id * 2.0 AS y")
    with pytest.raises(ValueError, match="pipeline"):
        ops.fit_linear(rows, FeatureSpec(("x",), ("level",), "y"))


@pytest.mark.parametrize("penalties", [(0.0,), (0.0, 10.0, 20_000.0)])
def test_gradients_equal_moments(spark, orders, penalties):
    rows = orders.withColumn("o_orderstatus", F.when(F.col("order_year") != 1995, F.col("o_orderstatus")))
    for penalty, fit in zip(penalties, ops.linear_path(rows, ORDER_SPEC, penalties), strict=True):
        other = ops.fit_linear(rows, ORDER_SPEC, penalty)
        assert [s.name for s in fit.slots] == [s.name for s in other.slots]
        assert fit.coefficients == pytest.approx(other.coefficients, rel=1e-6, abs=1e-3)
        assert fit.intercept == pytest.approx(other.intercept, rel=1e-6)
        assert fit.spread == pytest.approx(other.spread, rel=1e-8)


def test_gradients_over_many_levels(spark):
    """100,000 levels: the fit holds some numbers for each, where second moments would take 80 GB."""
    rows = spark.range(400_000).selectExpr(
        "concat('l', id % 100000) AS level", "double(id % 37) AS x", "double(id % 37) * 3 + id % 100000 % 50 AS y"
    )
    spec = FeatureSpec(("x",), ("level",), "y")
    model = ops.fit_linear(rows, spec, method="gradient")
    assert len(model.slots) == 100_001
    assert model.coefficients[-1] == pytest.approx(3.0, rel=1e-6)
    found = {s.category: model.coefficients[s.idx] for s in model.slots[:-1]}
    assert found["l49"] - found["l0"] == pytest.approx(49.0, rel=1e-6)
    with pytest.raises(ValueError, match="gradient"):
        ops.fit_linear(rows, spec)
