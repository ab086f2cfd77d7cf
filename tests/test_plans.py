"""What reaches the scan, and what is shuffled."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from keydrivers import operators as ops
from workload.fixtures import table


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _read_columns(df) -> set[str]:
    text = df._jdf.queryExecution().optimizedPlan().toString() + _plan(df)
    found = re.findall(r"ReadSchema: struct<([^>]*)>", text)
    return {part.split(":")[0] for schema in found for part in schema.split(",") if part}


@pytest.fixture(scope="module")
def lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem")


def test_only_needed_columns_are_read(lines):
    assert _read_columns(ops.category_values(lines, "l_returnflag")) == {"l_returnflag"}
    assert _read_columns(ops.histogram(lines, "l_tax", 0, 1, 5)) == {"l_tax"}
    assert _read_columns(ops.yearly_average(lines, "l_shipdate", ["l_tax"])) == {
        "l_shipdate",
        "l_tax",
    }
    assert _read_columns(ops.category_cardinality(lines, ["l_returnflag", "l_linestatus"])) == {
        "l_returnflag",
        "l_linestatus",
    }
    assert _read_columns(
        ops.scatter_sample(lines, "l_quantity", "l_tax", 0.5, ["l_orderkey"])
    ) == {"l_quantity", "l_tax", "l_orderkey"}


def test_filters_of_the_caller_reach_the_scan(lines):
    some = lines.where(F.col("l_quantity") > 10)
    plan = _plan(ops.regression_metrics(some.withColumn("prediction", F.col("l_tax")), "l_discount"))
    assert "GreaterThan(l_quantity,10.0)" in plan


def test_scoring_reads_what_the_result_needs_and_shuffles_nothing(lines):
    from keydrivers import FeatureSpec

    spec = FeatureSpec(("l_quantity", "l_tax"), ("l_returnflag",), "l_extendedprice")
    model = ops.fit_linear(lines, spec)
    scored = ops.score(model, lines)
    assert "Exchange hashpartitioning" not in _plan(scored)
    assert "ArrowEvalPython" not in _plan(scored) and "BatchEvalPython" not in _plan(scored)
    report = ops.regression_metrics(scored, spec.target)
    assert _read_columns(report) == set(spec.columns)


def test_rows_are_combined_before_every_shuffle(lines):
    for df in (
        ops.category_values(lines, "l_returnflag"),
        ops.histogram(lines, "l_tax", 0, 1, 5),
        ops.null_profile(lines),
    ):
        plan = _plan(df)
        first_scan_exchange = plan.rindex("Exchange")
        assert "partial_count" in plan[first_scan_exchange:]
