from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from keydrivers import FeatureSpec
from keydrivers import operators as ops
from keydrivers.operators.features import EMPTY_CATEGORY
from keydrivers.plans import VEHICLE_SPEC


def _ids(df):
    return {r[0] for r in df.select("o_orderkey").collect()}


def test_split_does_not_depend_on_partitioning(orders):
    two = [_ids(p) for p in ops.split(orders.repartition(2), ["o_orderkey"])]
    seven = [_ids(p) for p in ops.split(orders.repartition(7, "qty"), ["o_orderkey"])]
    assert two == seven
    assert two[0].isdisjoint(two[1])
    assert two[0] | two[1] == _ids(orders)
    assert len(two[0]) / orders.count() == pytest.approx(0.8, abs=0.04)


def test_split_without_key_and_with_three_parts(orders):
    parts = ops.split(orders, weights=(2, 1, 1))
    assert sum(p.count() for p in parts) == orders.count()
    assert parts[0].columns == orders.columns


def test_mark_split_is_the_same_rule(orders):
    train, test = ops.split(orders, ["o_orderkey"])
    marked = ops.mark_split(orders, ["o_orderkey"])
    assert _ids(marked.where("split = 'train'")) == _ids(train)
    assert _ids(marked.where("split = 'test'")) == _ids(test)


def test_split_is_a_filter_over_the_scan(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    plan = ops.split(orders, ["o_orderkey"])[0]._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_spark_random_split_is_there(orders):
    parts = ops.random_split(orders, seed=42)
    assert sum(p.count() for p in parts) == orders.count()


def test_folds_do_not_follow_from_the_split(orders):
    train, _ = ops.split(orders, ["o_orderkey"])
    sizes = [r["count"] for r in ops.assign_folds(train, ["o_orderkey"]).groupBy("fold").count().collect()]
    assert len(sizes) == 5
    assert max(sizes) < 1.4 * min(sizes)


def test_spec_is_checked():
    with pytest.raises(ValueError, match="more than one role"):
        FeatureSpec(("a",), ("a",), "y")
    with pytest.raises(ValueError, match="at least one"):
        FeatureSpec((), (), "y")


def test_spec_is_checked_against_the_table(vehicles):
    with pytest.raises(ValueError, match="nope"):
        FeatureSpec(("nope",), (), "model_year").validate(vehicles)
    with pytest.raises(TypeError, match="make"):
        FeatureSpec(("make",), (), "model_year").validate(vehicles)


def _features(df, spec, invalid="error"):
    rows = ops.prepared(df, spec, invalid)
    return ops.feature_pipeline(spec, invalid).fit(rows).transform(rows)


def test_slots_follow_the_vector(vehicles):
    features = _features(vehicles, VEHICLE_SPEC)
    slots = ops.feature_slots(features, VEHICLE_SPEC)
    assert [s.idx for s in slots] == list(range(features.first()["features"].size))
    assert [s.name for s in slots[-7:]] == list(VEHICLE_SPEC.numeric)
    fuels = {s.category for s in slots if s.field == "fuel_type"}
    assert fuels == {"X", "Z", "D", "E", "N"}
    # Clean text without any letter or digit keeps a slot, under a name that can be read.
    classes = {s.category for s in slots if s.field == "vehicle_class"}
    assert EMPTY_CATEGORY in classes and None not in classes


def test_index_is_by_frequency_then_name(spark):
    df = spark.createDataFrame(
        [("b", 1.0, 1.0), ("a", 1.0, 1.0), ("c", 1.0, 1.0), ("c", 1.0, 1.0), (None, 1.0, 1.0)],
        "k string, x double, y double",
    )
    spec = FeatureSpec(("x",), ("k",), "y")
    rows = ops.prepared(df, spec)
    model = ops.index_categories(spec).fit(rows)
    found = {r["k"]: r["k_idx"] for r in model.transform(rows).collect()}
    assert found == {"c": 0.0, "a": 1.0, "b": 2.0, None: 3.0}
    assert _features(df, spec).where("k is null").first()["features"].toArray().tolist() == [0, 0, 0, 1]


def test_unseen_category_gets_no_slot(vehicles):
    known = vehicles.where("fuel_type <> 'N'")
    spec = FeatureSpec(("fuel_cons_comb_L100km",), ("fuel_type",), "CO2_emission_gkm")
    model = ops.fit_linear(known, spec)
    assert ops.score(model, vehicles).where("prediction is null").count() == 0
    assert {s.category for s in model.slots if s.category} == {"X", "Z", "D", "E"}


def test_column_with_the_infix_in_its_own_name(vehicles):
    odd = vehicles.withColumnRenamed("fuel_type", "my_vec_fuel")
    spec = FeatureSpec(("cylinders",), ("my_vec_fuel", "make"), "CO2_emission_gkm")
    slots = ops.feature_slots(_features(odd, spec), spec)
    assert {s.field for s in slots} == {"my_vec_fuel", "make", "cylinders"}
    assert {s.category for s in slots if s.field == "my_vec_fuel"} == {"X", "Z", "D", "E", "N"}


@pytest.mark.parametrize("hole", [None, float("nan")])
def test_missing_number_stops_and_names_the_column(vehicles, hole):
    holes = vehicles.withColumn(
        "engine_size_l", F.when(F.col("model_year") == 2000, F.lit(hole)).otherwise(F.col("engine_size_l"))
    )
    spec = FeatureSpec(("engine_size_l", "cylinders"), (), "CO2_emission_gkm")
    with pytest.raises(Exception, match="no number in column 'engine_size_l'"):
        ops.fit_linear(holes, spec)


def test_missing_number_can_be_skipped(vehicles):
    holes = vehicles.withColumn(
        "engine_size_l", F.when(F.col("model_year") != 2000, F.col("engine_size_l"))
    )
    spec = FeatureSpec(("engine_size_l", "cylinders"), (), "CO2_emission_gkm")
    skipped = ops.fit_linear(holes, spec, invalid="skip")
    whole = ops.fit_linear(vehicles.where("model_year <> 2000"), spec)
    assert skipped.coefficients == pytest.approx(whole.coefficients)
    with pytest.raises(ValueError, match="invalid"):
        ops.prepared(holes, spec, "maybe")


def test_level_index_as_a_table(spark, monkeypatch):
    """The same numbers as Spark's indexer, missing, empty and unseen ones included; also beyond the broadcast levels."""
    level = "CASE WHEN id % 4 = 0 THEN 'hot' WHEN id % 11 = 0 THEN NULL WHEN id % 13 = 0 THEN '' ELSE concat('l', CAST(sqrt(id % 700) AS INT)) END"
    rows = spark.range(9_000).selectExpr("id", f"{level} AS c", "id % 5 AS index", "double(id) AS y")
    spec = FeatureSpec(("index",), ("c",), "y")
    indexer = ops.index_categories(spec).fit(ops.prepared(rows, spec))
    expected = {name: float(k) for k, name in enumerate(indexer.labelsArray[0])}
    found = ops.level_index(rows, "c")
    assert {r.category: r["index"] for r in found.collect()} == expected
    assert found.agg({"n": "sum"}).first()[0] == rows.where("c is not null").count()
    more = rows.unionByName(spark.createDataFrame([(-1, "unseen", 0, 0.0)], rows.schema))
    for hot in (10_000, 2):
        monkeypatch.setattr("keydrivers.operators.levels.HOT_LEVELS", hot)
        numbered = ops.with_level_index(more, "c", found)
        assert numbered.columns == [*rows.columns, "c_idx"]
        got = numbered.collect()
        assert len(got) == 9_001
        names = {"": "(empty)"}
        assert all(r.c_idx == expected.get(names.get(r.c, r.c), len(expected)) for r in got)
    with_features = ops.feature_pipeline(spec).fit(ops.prepared(rows, spec)).transform(ops.prepared(rows, spec))
    slots = [(s.idx, s.name, s.field, s.category) for s in ops.feature_slots(with_features, spec)]
    assert sorted(map(tuple, ops.slot_frame(rows, spec).collect())) == slots


def test_level_index_keeps_categories_off_the_driver(spark):
    """300,000 categories: what reaches the driver is a count for each part."""
    rows = spark.range(600_000).selectExpr("concat('c', id % 300000) AS c")
    index = ops.level_index(rows, "c")
    got = index.selectExpr("count(*) AS n", "min(index) AS lo", "max(index) AS hi", "count(DISTINCT index) AS d").first()
    assert tuple(got) == (300_000, 0.0, 299_999.0, 300_000)
