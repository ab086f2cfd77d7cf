from __future__ import annotations

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from keydrivers import operators as ops


def frame(spark, x, parts=5):
    names = [f"c{k}" for k in range(x.shape[1])]
    rows = [[None if np.isnan(v) else float(v) for v in row] for row in x]
    schema = ", ".join(f"{n} double" for n in names)
    return spark.createDataFrame(rows, schema).repartition(parts), names


def by_pair(df):
    return {(r.a, r.b): r.r for r in df.collect()}


def expected(x, i, j):
    both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
    a, b = x[both, i], x[both, j]
    if len(a) < 2 or np.ptp(a) == 0 or np.ptp(b) == 0:
        return None
    a, b = a - a.mean(), b - b.mean()
    return float(a @ b / np.sqrt((a @ a) * (b @ b)))


@pytest.mark.parametrize("offset", [0.0, 1e9])
def test_gaps_of_every_kind(spark, offset):
    """Random gaps, a column of gaps alone, one value, constants, and pairs without a common row."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 9)) * np.logspace(-3, 5, 9) + offset
    x[:, 1] += x[:, 0] * 10
    x[rng.random(x.shape) < 0.3] = np.nan
    x[:, 3] = np.nan
    x[:, 4] = np.where(rng.random(900) < 0.5, np.nan, 0.1)
    x[1:, 5] = np.nan
    x[::2, 6], x[1::2, 7] = np.nan, np.nan
    df, names = frame(spark, x)
    found = by_pair(ops.correlation_matrix(df, names))
    assert len(found) == 81
    for i, a in enumerate(names):
        for j, b in enumerate(names):
            want = expected(x, i, j)
            assert (found[a, b] is None) == (want is None), (a, b)
            if want is not None:
                assert found[a, b] == pytest.approx(want, abs=1e-5 if offset else 1e-11), (a, b)


def test_rows_of_a_pair_far_from_the_mean(spark):
    """Tiny spreads around distant values, which sums around the mean of the column would lose."""
    rng = np.random.default_rng(5)
    x = np.full((3_000, 3), np.nan)
    odd = np.arange(3_000) % 2 == 1
    x[:, 0] = np.where(odd, 0.0, 1e6 + rng.normal(size=3_000) * 1e-2)
    x[~odd, 1] = x[~odd, 0] * 3 + rng.normal(size=1_500) * 1e-2
    x[:, 2] = rng.normal(size=3_000)
    df, names = frame(spark, x)
    found = by_pair(ops.correlation_matrix(df, names))
    assert found["c0", "c1"] == pytest.approx(expected(x, 0, 1), abs=1e-6)
    assert found["c0", "c1"] == found["c1", "c0"] and found["c1", "c1"] == 1.0


def test_gaps_cost_at_most_twice(spark):
    """24 columns of 60,000 rows, complete and with gaps; the better of two runs each."""
    rows = spark.range(60_000).selectExpr("id", "rand(1) AS base")
    complete = rows.selectExpr(*[f"base + rand({k}) AS c{k}" for k in range(24)]).persist()
    complete.count()
    names = complete.columns
    gaps = complete.selectExpr(*[f"CASE WHEN rand({k}) > 0.1 THEN c{k} END AS c{k}" for k in range(24)]).persist()
    gaps.count()
    took = {}
    for _ in range(2):
        for kind, df in (("complete", complete), ("gaps", gaps)):
            began = time.perf_counter()
            assert ops.correlation_matrix(df, names).count() == 576
            took[kind] = min(took.get(kind, 99.0), time.perf_counter() - began)
    assert took["gaps"] < 2 * took["complete"] + 0.5, took


def test_one_pass_over_gaps(spark):
    """No aggregate for each pair: the plan has one Arrow scan, whatever the number of columns."""
    df = spark.range(100).selectExpr(*[f"CASE WHEN id % {k + 2} > 0 THEN id * {k} + rand({k}) END AS c{k}" for k in range(30)])
    plan = ops.correlation_matrix(df, df.columns)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and len(plan) < 60_000


def test_wide_columns_are_read_once(spark, monkeypatch):
    """Means and counts of every column beforehand would be a read of their own."""
    from keydrivers.operators import correlate

    monkeypatch.setattr(correlate, "column_stats", lambda *_: pytest.fail("read for column statistics"))
    x = F.col("id").cast("double")
    columns = {f"c{k}": F.when(F.col("id") % 14 != k, x * (k + 1.0)) for k in range(13)} | {"flat": F.lit(7.1)}
    rows = spark.range(500).select([c.alias(name) for name, c in columns.items()])
    found = {(r.a, r.b): r.r for r in ops.correlation_matrix(rows, list(columns)).collect()}
    assert len(found) == 14 * 14
    assert all((r is None) == ("flat" in pair) for pair, r in found.items())
    assert all(abs(r - 1.0) < 1e-9 for r in found.values() if r is not None)
