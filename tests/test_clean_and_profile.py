from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from vehicle_data import DIRTY_CLASSES

from keydrivers import operators as ops
from keydrivers.functions import field_of, normalized
from keydrivers.plans import VEHICLE_COLUMNS, VEHICLE_SCHEMA
from keydrivers.sources import read_table, schema_report, write_table


def test_headings_become_standard_names(vehicles):
    assert vehicles.columns == list(VEHICLE_COLUMNS.values())


def test_inferred_types_equal_the_declared_schema(spark, vehicle_csv):
    inferred = read_table(spark, vehicle_csv)
    assert [(f.name, f.dataType) for f in inferred.schema] == [
        (f.name, f.dataType) for f in VEHICLE_SCHEMA
    ]


def test_strict_rename_refuses_missing_names(spark):
    df = spark.range(1)
    with pytest.raises(ValueError, match="nope"):
        ops.standardize_columns(df, {"nope": "x"})
    assert ops.standardize_columns(df, {"nope": "x"}, strict=False).columns == ["id"]


def test_dirty_classes(spark):
    rows = [(k, v) for k, v in DIRTY_CLASSES.items()] + [("\tTwo\t seater ", "two-seater"), ("é x", "x")]
    df = spark.createDataFrame(rows, "raw string, clean string")
    found = df.select("clean", normalized("raw").alias("found")).collect()
    assert [r["found"] for r in found] == [r["clean"] for r in found]


def test_normalizing_twice_is_normalizing_once(spark):
    @settings(max_examples=5, deadline=None)
    @given(st.lists(st.text(max_size=30), min_size=20, max_size=60))
    def check(texts):
        df = spark.createDataFrame([(t,) for t in texts], "t string")
        once = df.select(normalized("t").alias("t"))
        both = once.select("t", normalized("t").alias("again")).collect()
        assert all(r["t"] == r["again"] for r in both)
        assert all(set(r["t"]) <= set("abcdefghijklmnopqrstuvwxyz0123456789-") for r in both)

    check()


def test_cardinality_counts_null_as_a_value(vehicles):
    cols = ["vehicle_class", "make", "fuel_type"]
    found = {r["column"]: r["n_values"] for r in ops.category_cardinality(vehicles, cols).collect()}
    expected = {c: vehicles.select(c).distinct().count() for c in cols}
    assert found == expected
    assert found["vehicle_class"] == len(set(DIRTY_CLASSES.values()))
    near = ops.category_cardinality(vehicles, cols, approx=True).collect()
    assert {r["column"]: r["n_values"] for r in near} == expected


def test_category_values_are_sorted_by_their_own_column(vehicles):
    found = ops.category_values(vehicles, "transmission").collect()
    assert [r["value"] for r in found] == sorted(r["value"] for r in found)
    assert sum(r["n"] for r in found) == vehicles.count()


def test_null_profile_and_sparse_columns(vehicles):
    profile = {r["column"]: r for r in ops.null_profile(vehicles).collect()}
    assert profile["CO2_rating"]["null_fraction"] > 0.7
    assert profile["make"]["n_null"] == 0
    assert profile["make"]["n"] == vehicles.count()
    left = ops.drop_sparse_columns(vehicles)
    assert set(vehicles.columns) - set(left.columns) == {"CO2_rating", "smog_rating"}
    assert "CO2_rating" in ops.drop_sparse_columns(vehicles, keep=["CO2_rating"]).columns
    assert ops.drop_columns(vehicles, ["co2_rating"]).columns == [
        c for c in vehicles.columns if c != "CO2_rating"
    ]


def test_profile_of_an_empty_table(vehicles):
    empty = vehicles.where("false")
    assert {r["null_fraction"] for r in ops.null_profile(empty).collect()} == {None}
    assert {r["n_values"] for r in ops.category_cardinality(empty, ["make"]).collect()} == {0}
    assert ops.drop_sparse_columns(empty).columns == vehicles.columns


def test_schema_report(vehicles):
    found = schema_report(vehicles).collect()
    assert [r["column"] for r in found] == vehicles.columns
    assert found[0]["type"] == "int"


def test_single_file(spark, vehicles, tmp_path):
    path = write_table(vehicles, str(tmp_path / "one"), single_file=True)
    assert len(list((tmp_path / "one").glob("part-*.csv"))) == 1
    assert read_table(spark, path, vehicles.schema).count() == vehicles.count()


@pytest.mark.parametrize(
    "slot, field",
    [
        ("fuel_type_vec_X", "fuel_type"),
        ("fuel_type_vec_X_vec_Y", "fuel_type"),
        ("fuel_type_vec", "fuel_type"),
        ("cylinders", "cylinders"),
    ],
)
def test_field_of_a_slot_name(spark, slot, field):
    assert spark.range(1).select(field_of(F.lit(slot))).first()[0] == field
