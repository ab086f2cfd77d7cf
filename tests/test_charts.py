from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from keydrivers import operators as ops
from keydrivers.plans import VEHICLE_SPEC


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all rows has one key, and a third of these one value; also null groups."""
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame(
        {
            "g": np.where(np.arange(6000) % 3 == 0, "hot", rng.choice(list("abcd"), 6000)),
            "v": np.round(rng.lognormal(3, 2, 6000), 3),
        }
    )
    pdf.loc[pdf.index % 9 == 0, "v"] = 12.5
    pdf.loc[pdf.index % 101 == 0, "g"] = None
    pdf.loc[pdf.index % 53 == 0, "v"] = None
    pdf.loc[len(pdf)] = ["empty", np.nan]
    rows = [
        (g if isinstance(g, str) else None, None if np.isnan(v) else float(v))
        for g, v in pdf.values
    ]
    return spark.createDataFrame(rows, "g string, v double").repartition(7).persist(), pdf


@pytest.mark.parametrize("rows_in_one_task", [10**6, 500, 20, 1])
def test_quantiles_by_group_equal_pandas(skewed, rows_in_one_task, monkeypatch):
    monkeypatch.setattr("keydrivers.operators.quantiles.CELLS", 16)
    df, pdf = skewed
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    names = [f"p{i}" for i in range(len(probs))]
    found = ops.quantiles_by(df, "v", probs, names, ["g"], rows_in_one_task=rows_in_one_task)
    # a, b, c, d, hot, null and the group without values
    assert found.groups == 7
    rows = {r["g"]: [r[n] for n in names] for r in found.table.collect()}
    assert rows.pop("empty") == [None] * len(probs)
    for group, part in pdf[pdf.g != "empty"].groupby("g", dropna=False):
        key = group if isinstance(group, str) else None
        expected = part.v.dropna().quantile(probs).tolist()
        assert rows.pop(key) == pytest.approx(expected, rel=1e-12)
    assert not rows


@pytest.mark.parametrize("rows_in_one_task", [10**6, 30])
def test_quantiles_of_all_rows_equal_pandas(skewed, rows_in_one_task):
    df, pdf = skewed
    found = ops.quantiles_by(
        df, "v", [0.25, 0.5], ["a", "b"], rows_in_one_task=rows_in_one_task
    ).table.first()
    assert found["n"] == pdf.v.count()
    assert [found["a"], found["b"]] == pytest.approx(pdf.v.quantile([0.25, 0.5]).tolist())


@pytest.mark.parametrize("bound", [1, 4, 10])
def test_joins_beyond_the_broadcast_bound_give_the_same(skewed, monkeypatch, bound):
    """With no group above its share of the rows, and with the hot one or more above it."""
    df, _ = skewed

    def run():
        probs, names = [0.1, 0.5], ["p", "m"]
        found = ops.quantiles_by(df, "v", probs, names, ["g"], rows_in_one_task=5)
        boxes = ops.box_stats(df, "v", "g")
        return sorted(found.table.collect(), key=str), sorted(boxes.collect(), key=str)

    with_broadcast = run()
    monkeypatch.setattr("keydrivers.operators.quantiles.BROADCAST_ROWS", bound)
    assert run() == with_broadcast


@pytest.mark.parametrize(("sample", "deviations"), [(64, 4.5), (16, 0.0), (3, -9.0)])
def test_brackets_from_small_samples(skewed, monkeypatch, sample, deviations):
    """Narrow brackets, and such that miss their rank, so that the rows are read again."""
    df, pdf = skewed
    monkeypatch.setattr("keydrivers.operators.quantiles.SAMPLE", sample)
    monkeypatch.setattr("keydrivers.operators.quantiles.DEVIATIONS", deviations)
    for few in (10**6, 20):
        found = ops.quantiles_by(df, "v", [0.1, 0.5, 0.9], ["a", "b", "c"], ["g"], rows_in_one_task=few)
        rows = {r["g"]: [r["n"], r["mean"], r["std"], r["min"], r["max"], r["a"], r["b"], r["c"]] for r in found.table.collect()}
        for group, part in pdf[pdf.g != "empty"].groupby("g", dropna=False):
            v = part.v.dropna()
            expected = [len(v), v.mean(), v.std(), v.min(), v.max(), *v.quantile([0.1, 0.5, 0.9])]
            assert rows[group if isinstance(group, str) else None] == pytest.approx(expected, rel=1e-12)
    boxes = {r["g"]: r for r in ops.box_stats(df, "v", "g").collect()}
    for group, part in pdf[pdf.g != "empty"].groupby("g", dropna=False):
        v = part.v.dropna()
        q1, q3 = v.quantile([0.25, 0.75])
        kept = v[(v >= q1 - 1.5 * (q3 - q1)) & (v <= q3 + 1.5 * (q3 - q1))]
        box = boxes[group if isinstance(group, str) else None]
        assert (box["n"], box["n_outliers"]) == (len(v), len(v) - len(kept))
        assert (box["whisker_low"], box["whisker_high"]) == (kept.min(), kept.max())


def counted_reads(spark, rows):
    """Rows that tell how often they are read."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    return rows.mapInArrow(count, rows.schema), seen


@pytest.mark.parametrize("few", [10**6, 200])
def test_two_reads_give_boxes_and_distributions(spark, few, monkeypatch):
    """Whatever the size of the groups, and also where what is kept is narrowed further."""
    n = 120_000
    rows = spark.range(n).selectExpr("CASE WHEN id % 3 = 0 THEN 0 ELSE id % 7 END AS g", "randn(3) * 100 AS v").persist()
    monkeypatch.setattr("keydrivers.operators.quantiles.ROWS_IN_ONE_TASK", few)
    for run in (
        lambda df: ops.box_stats(df, "v", "g"),
        lambda df: ops.box_stats(df, "v"),
        lambda df: ops.distribution_by(df, "g", "v"),
        lambda df: ops.quantiles_by(df, "v", [0.3, 0.99], ["a", "b"], ["g"], rows_in_one_task=few).table,
    ):
        df, seen = counted_reads(spark, rows)
        run(df).collect()
        assert seen.value == 2 * n
    small = ops.quantiles_by(rows, "v", [0.25, 0.5, 0.75], ["a", "b", "c"], reach=1.5).cells
    assert small.where("v is not null").count() < 0.2 * n


@pytest.mark.parametrize("bins", [2, 7, 20])
def test_automatic_histogram(spark, bins):
    """One read; bins of a power of two that hold all values, whatever their range and order."""
    rng = np.random.default_rng(8)
    for values in (
        rng.normal(size=4000) * 3 + 100, np.r_[np.zeros(50), 1e-9, 5e8], np.array([7.5]), -np.arange(1000.0),
        np.r_[1e300, -1e300, 0.1], np.r_[2.0**52 + np.arange(64)], np.r_[-3e-300, 0.0, 2e-301],
    ):
        rows = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),)], "v double").repartition(6)
        df, seen = counted_reads(spark, rows)
        found = ops.auto_histogram(df, "v", bins).collect()
        assert seen.value == len(values) + 2
        assert [r["bin"] for r in found] == list(range(1, len(found) + 1)) and len(found) <= bins
        assert found[0]["n"] > 0 and found[-1]["n"] > 0 and sum(r["n"] for r in found) == len(values)
        width = found[0]["upper"] - found[0]["lower"]
        for r in found:
            assert r["upper"] - r["lower"] == width and np.frexp(width)[0] == 0.5
            assert r["n"] == ((values >= r["lower"]) & (values < r["upper"])).sum()
        if len(values) > 1:
            # Half the width would need too many bins.
            assert np.floor(values.max() / (width / 2)) - np.floor(values.min() / (width / 2)) + 1 > bins
    empty = spark.createDataFrame([(None,)], "v double")
    assert ops.auto_histogram(empty, "v").count() == 0


def test_scatter_points(spark):
    rows = spark.range(5000).selectExpr("id % 2500 AS k", "id AS x", "id * 2.0 AS y", "id % 2 AS pair")
    first = sorted(map(tuple, ops.scatter_points(rows, "x", "y", 40, ["k", "pair"], extra=["k"]).collect()))
    again = sorted(map(tuple, ops.scatter_points(rows.repartition(13), "x", "y", 40, ["k", "pair"], extra=["k"]).collect()))
    assert first == again and len(first) == 40
    more = set(map(tuple, ops.scatter_points(rows, "x", "y", 90, ["k", "pair"], extra=["k"]).collect()))
    assert set(first) < more
    assert ops.scatter_points(rows.limit(7), "x", "y", 40, ["k", "pair"]).count() == 7


def test_quantiles_next_to_infinity(spark):
    rows = [(float(i),) for i in range(200)] + [(float("inf"),), (float("-inf"),)] * 3
    df = spark.createDataFrame(rows, "v double")
    for few in (10**6, 10):
        found = ops.quantiles_by(df, "v", [0.5], ["m"], rows_in_one_task=few).table.first()
        assert found["m"] == 99.5


def test_approximate_quantiles_are_near(skewed):
    df, pdf = skewed
    found = ops.quantiles_by(df, "v", [0.5], ["m"], approx=True).table.first()["m"]
    assert found == pytest.approx(pdf.v.quantile(0.5), rel=0.01)


def test_distribution_and_box_count_every_value(skewed):
    df, pdf = skewed
    distribution = {r["g"]: r for r in ops.distribution_by(df, "g", "v").collect()}
    boxes = {r["g"]: r for r in ops.box_stats(df, "v", "g").collect()}
    assert set(distribution) == set(boxes) == {None, "hot", "a", "b", "c", "d", "empty"}
    hot = pdf[pdf.g == "hot"].v.dropna()
    assert distribution["hot"]["n"] == boxes["hot"]["n"] == len(hot)
    assert distribution["hot"]["median"] == boxes["hot"]["median"] == hot.median()
    lo = hot.quantile(0.25) - 1.5 * (hot.quantile(0.75) - hot.quantile(0.25))
    hi = hot.quantile(0.75) + 1.5 * (hot.quantile(0.75) - hot.quantile(0.25))
    assert boxes["hot"]["n_outliers"] == int(((hot < lo) | (hot > hi)).sum())
    assert boxes["hot"]["whisker_high"] == hot[hot <= hi].max()
    assert boxes["empty"]["n"] == 0


def test_histogram_counts_add_up(skewed):
    df, pdf = skewed
    found = ops.histogram(df, "v", 0.0, 50.0, 10).collect()
    assert sum(r["n"] for r in found) == pdf.v.count()
    assert found[-1]["bin"] == 11 and found[-1]["lower"] == 50.0
    own_limits = ops.histogram(df, "v", bins=4).collect()
    assert [r["bin"] for r in own_limits] == [1, 2, 3, 4]
    assert sum(r["n"] for r in own_limits) == pdf.v.count()
    flat = ops.histogram(df.withColumn("v", F.lit(2.0)), "v", bins=3).collect()
    assert sum(r["n"] for r in flat) == len(pdf)


def test_yearly_average_takes_numbers_and_dates(vehicles):
    by_number = ops.yearly_average(vehicles, "model_year", ["fuel_cons_comb_L100km"]).collect()
    dated = vehicles.withColumn("day", F.make_date("model_year", F.lit(3), F.lit(1)))
    by_date = ops.yearly_average(dated, "day", ["fuel_cons_comb_L100km"]).collect()
    assert by_number == by_date
    assert [r["year"] for r in by_number] == sorted(r["year"] for r in by_number)


def test_correlation_equals_pandas(vehicles):
    holes = vehicles.withColumn(
        "cylinders", F.when(F.col("model_year") % 3 != 0, F.col("cylinders"))
    ).withColumn("engine_size_l", F.when(F.col("model_year") == 2000, float("nan")).otherwise(F.col("engine_size_l")))
    cols = list(VEHICLE_SPEC.measures)
    expected = holes.select(cols).toPandas().astype("float64").corr()
    for width in (12, 0):
        found = ops.correlation_matrix(holes, cols, compiled_width=width).collect()
        assert len(found) == len(cols) ** 2
        for r in found:
            assert r["r"] == pytest.approx(expected.loc[r["a"], r["b"]], abs=1e-10)
            assert abs(r["r"]) <= 1 + 1e-12
    wide = {r["feature"]: r for r in ops.correlation_wide(holes, cols).collect()}
    assert wide["cylinders"]["model_year"] == wide["model_year"]["cylinders"]


@pytest.mark.parametrize("width", [12, 0])
def test_constant_column_has_no_correlation(vehicles, width):
    flat = vehicles.withColumn("flat", F.lit(1234.567))
    found = {
        (r["a"], r["b"]): r["r"]
        for r in ops.correlation_matrix(
            flat, ["flat", "cylinders", "engine_size_l"], compiled_width=width
        ).collect()
    }
    assert found[("flat", "flat")] is None and found[("flat", "cylinders")] is None
    assert found[("cylinders", "cylinders")] == 1.0


def test_strongest_predictor_is_the_planted_one(vehicles):
    ranked = ops.target_correlation(vehicles, VEHICLE_SPEC).collect()
    # Emission is planted on combined consumption, which is little more than city consumption.
    assert ranked[0]["feature"] in ("fuel_cons_comb_L100km", "fuel_cons_city_L100km")
    near = ops.collinear_with(vehicles, VEHICLE_SPEC, "fuel_cons_comb_L100km").collect()
    assert {"fuel_cons_city_L100km", "engine_size_l"} <= {r["feature"] for r in near}
    assert "fuel_cons_comb_L100km" not in {r["feature"] for r in near}


def test_top_k(vehicles):
    found = ops.top_k(vehicles, [F.desc("CO2_emission_gkm"), F.col("model")], 3).collect()
    highest = vehicles.agg(F.max("CO2_emission_gkm")).first()[0]
    assert len(found) == 3 and found[0]["CO2_emission_gkm"] == highest


def test_infinities_do_not_stop_the_narrowing(spark, monkeypatch):
    """With infinities in a group its values are still cut into parts, not listed at once."""
    from keydrivers.operators import quantiles

    rows = [(float(i),) for i in range(5_000)] + [(float("inf"),), (float("-inf"),), (1.7e308,)]
    df = spark.createDataFrame(rows, "v double")
    listed = []
    pick = quantiles._pick

    def spy(cells, intervals, **options):
        listed.append(cells.groupBy("g", "lo").count().agg({"count": "max"}).first()[0])
        return pick(cells, intervals, **options)

    monkeypatch.setattr(quantiles, "_pick", spy)
    found = quantiles.quantiles_by(df, "v", [0.5], ["m"], rows_in_one_task=100).table.first()
    assert found["m"] == 2_500.0
    assert max(listed) <= quantiles.CELLS + 3


def test_histogram_and_average_leave_out_nan(spark):
    rows = [(2000, 1.0), (2000, float("nan")), (2000, 3.0), (2001, None)]
    df = spark.createDataFrame(rows, "year int, v double")
    assert sum(r["n"] for r in ops.histogram(df, "v", bins=2).collect()) == 2
    found = {r["year"]: (r["n"], r["avg_v"]) for r in ops.yearly_average(df, "year", ["v"]).collect()}
    assert found == {2000: (3, 2.0), 2001: (1, None)}


def test_correlation_of_a_pair_far_from_the_overall_mean(spark):
    rows = [(0.0, None)] * 500 + [(1e6 + i % 10 / 100, float(i % 10 + i % 3)) for i in range(500)]
    df = spark.createDataFrame(rows, "x double, y double")
    r = {(x["a"], x["b"]): x["r"] for x in ops.correlation_matrix(df, ["x", "y"]).collect()}
    pdf = df.dropna().toPandas()
    assert r["x", "y"] == pytest.approx(pdf.x.corr(pdf.y), abs=1e-6)
    assert ops.correlations_with(df, "y", ["x"]).first()["r"] == pytest.approx(r["x", "y"], abs=1e-9)
