"""The workload: every operator of the library on the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keydrivers import FeatureSpec
from keydrivers import operators as ops
from keydrivers.sources import checkpointed, kept, read_table, schema_report, scratch_dir, write_table

from .fixtures import (
    NUMERIC_SPEC,
    ORDER_KEY,
    ORDER_SPEC,
    PRIORITY_SPEC,
    TREE_SPEC,
    doc_features,
    order_features,
    table,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# A small penalty has no visible effect on a target of this spread; this one does.
STRONG_PENALTY = 20_000.0


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


def rounded(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    """Doubles that differ in the last bits between engines become equal.

    The order of summation changes from run to run, so digits are chosen to leave at least three
    orders of magnitude between the rounding step and the largest difference seen.
    """
    return df.withColumns({c: F.round(F.col(c), d) + F.lit(0.0) for c, d in digits.items()})


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.mark_split(order_features(spark, sf_dir), ORDER_KEY)


def _train(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.split(order_features(spark, sf_dir), ORDER_KEY)[0]


# --- Sources and sinks ---------------------------------------------------------------------


@query
def schema_of_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema_report(table(spark, sf_dir, "lineitem"))


@query
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer")
    path = write_table(customers, scratch_dir(spark, "customer-csv"))
    return read_table(spark, path, customers.schema)


@query
def csv_inferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    path = write_table(parts, scratch_dir(spark, "part-csv"))
    return read_table(spark, path)


@query
def parquet_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    path = write_table(
        orders, scratch_dir(spark, "orders"), fmt="parquet", partition_by=["o_orderstatus"]
    )
    return read_table(spark, path, orders.schema, fmt="parquet")


@query
def correlation_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    matrix = ops.correlation_wide(order_features(spark, sf_dir), ORDER_SPEC.measures)
    path = write_table(matrix, scratch_dir(spark, "correlation-csv"), single_file=True)
    found = read_table(spark, path, matrix.schema)
    return rounded(found, {c: 8 for c in ORDER_SPEC.measures})


@query
def coefficient_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    with kept(_train(spark, sf_dir)) as train:
        model = ops.fit_linear(train, ORDER_SPEC)
    result = ops.coefficient_table(spark, model).select("feature", "coefficient", "abs_coefficient")
    path = write_table(result, scratch_dir(spark, "coefficient-csv"), single_file=True)
    found = read_table(spark, path, result.schema)
    return rounded(found, {"coefficient": 1, "abs_coefficient": 1})


# --- Cleaning and profiles -----------------------------------------------------------------


@query
def renamed_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {"c_custkey": "customer_id", "c_mktsegment": "segment", "c_acctbal": "balance"}
    return ops.standardize_columns(table(spark, sf_dir, "customer"), names)


@query
def dropped_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.drop_columns(table(spark, sf_dir, "supplier"), ["S_NAME", "s_nationkey"])


@query
def normalized_priorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return ops.normalize_category(orders, ["o_orderpriority"])


@query
def normalized_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    return ops.normalize_category(parts, ["p_name", "p_brand", "p_type"])


@query
def normalized_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return ops.normalize_category(documents, ["text"])


@query
def order_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.category_cardinality(
        table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority", "o_custkey"]
    )


@query
def document_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.category_cardinality(
        doc_features(spark, sf_dir), ["lang", "source", "quality", "toxic"]
    )


@query
def clean_category_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = ops.normalize_category(table(spark, sf_dir, "part"), ["p_type", "p_brand"])
    return ops.category_cardinality(parts, ["p_type", "p_brand"])


@query
def part_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.category_values(table(spark, sf_dir, "part"), "p_type")


@query
def label_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.category_values(doc_features(spark, sf_dir), "quality")


@query
def null_profile_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ops.null_profile(doc_features(spark, sf_dir)), {"null_fraction": 8})


@query
def sparse_columns_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.drop_sparse_columns(doc_features(spark, sf_dir), max_null_fraction=0.5)


# --- Correlation ---------------------------------------------------------------------------


@query
def correlation_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ops.correlation_matrix(order_features(spark, sf_dir), ORDER_SPEC.measures)
    return rounded(found, {"r": 8})


@query
def correlation_matrix_of_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ops.correlation_matrix(doc_features(spark, sf_dir), ["n_chars", "quality", "toxic"])
    return rounded(found, {"r": 8})


@query
def correlation_by_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    measures = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]
    found = ops.correlation_matrix(table(spark, sf_dir, "lineitem"), measures, compiled_width=0)
    return rounded(found, {"r": 8})


@query
def correlation_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ops.correlation_wide(order_features(spark, sf_dir), ORDER_SPEC.measures)
    return rounded(found, {c: 8 for c in ORDER_SPEC.measures})


@query
def target_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ops.target_correlation(order_features(spark, sf_dir), ORDER_SPEC)
    return rounded(found, {"r": 8, "abs_r": 8})


@query
def collinear_with_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ops.collinear_with(order_features(spark, sf_dir), ORDER_SPEC, "n_lines")
    return rounded(found, {"r": 8, "abs_r": 8})


@query
def strongest_predictors(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = ops.target_correlation(order_features(spark, sf_dir), ORDER_SPEC)
    found = ops.top_k(ranked, [F.desc("abs_r"), F.col("feature")], 2)
    return rounded(found, {"r": 8, "abs_r": 8})


# --- Chart tables --------------------------------------------------------------------------

_CUTS = {"q1": 4, "median": 4, "q3": 4}


@query
def distribution_by_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ops.distribution_by(order_features(spark, sf_dir), "o_orderpriority", "target")
    return rounded(found, {"mean": 4, "std": 4, **_CUTS})


@query
def line_price_quartiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quartiles by narrowing intervals, as for groups that are too large for one task."""
    found = ops.quantiles_by(
        table(spark, sf_dir, "lineitem"),
        "l_extendedprice",
        ops.QUARTILES,
        list(_CUTS),
        ["l_returnflag", "l_linestatus"],
        rows_in_one_task=100,
    )
    return rounded(found.table.select("l_returnflag", "l_linestatus", *_CUTS), _CUTS)


@query
def box_stats_by_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ops.box_stats(order_features(spark, sf_dir), "target", "o_orderpriority")
    return rounded(found, {**_CUTS, "lower_fence": 4, "upper_fence": 4})


@query
def box_stats_of_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ops.box_stats(order_features(spark, sf_dir), "target")
    return rounded(found, {**_CUTS, "lower_fence": 4, "upper_fence": 4})


@query
def price_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ops.histogram(table(spark, sf_dir, "lineitem"), "l_extendedprice", 0.0, 110_000.0, 22)
    return rounded(found, {"lower": 4, "upper": 4})


@query
def yearly_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ops.yearly_average(table(spark, sf_dir, "orders"), "o_orderdate", ["o_totalprice"])
    return rounded(found, {"avg_o_totalprice": 4})


@query
def yearly_average_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    measures = ["n_lines", "qty", "target"]
    found = ops.yearly_average(order_features(spark, sf_dir), "order_year", measures)
    return rounded(found, {f"avg_{m}": 4 for m in measures})


@query
def scatter_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.scatter_sample(
        order_features(spark, sf_dir), "n_lines", "target", 0.1, ORDER_KEY, extra=ORDER_KEY
    )


@query
def scatter_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.scatter_points(
        order_features(spark, sf_dir), "n_lines", "target", 500, ORDER_KEY, extra=ORDER_KEY
    )


@query
def auto_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins that follow from the balances, some of which are below zero."""
    return ops.auto_histogram(table(spark, sf_dir, "customer"), "c_acctbal", 30)


# --- Split, folds, features ----------------------------------------------------------------


@query
def hash_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["l_orderkey", "l_linenumber"]
    train, test = ops.split(table(spark, sf_dir, "lineitem").select(*keys), keys)
    return train.withColumn("side", F.lit("train")).unionByName(
        test.withColumn("side", F.lit("test"))
    )


@query
def folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    return ops.assign_folds(lines, ["l_orderkey", "l_linenumber"])


@query
def category_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = FeatureSpec(
        numeric=("p_retailprice",), categorical=("p_brand", "p_type"), target="p_size"
    )
    rows = ops.prepared(table(spark, sf_dir, "part"), spec)
    indexed = ops.index_categories(spec).fit(rows).transform(rows)
    return indexed.select("p_partkey", "p_brand", "p_brand_idx", "p_type", "p_type_idx")


@query
def level_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as ``category_index`` from tables of categories."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    for c in ("p_brand", "p_type"):
        parts = ops.with_level_index(parts, c, ops.level_index(parts, c))
    return parts


@query
def slot_table_of_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = FeatureSpec(("p_size",), ("p_name", "p_type"), "p_retailprice")
    return ops.slot_frame(table(spark, sf_dir, "part"), spec)


@query
def feature_slot_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum over all rows of every slot of the feature vector, under the name of the slot."""
    rows = ops.prepared(order_features(spark, sf_dir), ORDER_SPEC)
    with kept(rows):
        features = ops.feature_pipeline(ORDER_SPEC).fit(rows).transform(rows)
    slots = ops.feature_slots(features, ORDER_SPEC)
    names = F.array(
        *[
            F.struct(
                F.lit(s.name).alias("slot"),
                F.lit(s.field).alias("field"),
                F.lit(s.category).cast("string").alias("category"),
            )
            for s in slots
        ]
    )
    sums = features.select(Summarizer.sum(F.col("features")).alias("v"))
    return (
        sums.select(F.posexplode(F.arrays_zip(names.alias("name"), _as_array("v").alias("total"))))
        .select("col.name.*", F.round("col.total", 2).alias("total"))
    )


def _as_array(vector: str):
    from pyspark.ml.functions import vector_to_array

    return vector_to_array(F.col(vector))


# --- Linear and ridge regression -----------------------------------------------------------


def _coefficients(spark, sf_dir, spec, penalty=0.0, fit=ops.fit_linear) -> DataFrame:
    with kept(_train(spark, sf_dir)) as train:
        model = fit(train, spec, penalty)
        found = ops.coefficient_table(spark, model, intercept=True)
    return rounded(found, {"coefficient": 1, "abs_coefficient": 1, "std_coefficient": 9})


@query
def linear_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coefficients(spark, sf_dir, NUMERIC_SPEC)


@query
def ridge_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coefficients(spark, sf_dir, NUMERIC_SPEC, STRONG_PENALTY)


@query
def linear_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coefficients(spark, sf_dir, ORDER_SPEC)


@query
def ridge_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coefficients(spark, sf_dir, ORDER_SPEC, STRONG_PENALTY)


@query
def linear_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as ``linear_full`` by a Spark ML pipeline."""
    return _coefficients(spark, sf_dir, ORDER_SPEC, fit=ops.fit_linear_pipeline)


@query
def ridge_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coefficients(
        spark, sf_dir, ORDER_SPEC, STRONG_PENALTY, fit=ops.fit_linear_pipeline
    )


@query
def linear_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coefficients(spark, sf_dir, PRIORITY_SPEC)


def _rollup(spark, sf_dir, penalty) -> DataFrame:
    with kept(_train(spark, sf_dir)) as train:
        model = ops.fit_linear(train, ORDER_SPEC, penalty)
    found = ops.field_rollup(ops.coefficient_table(spark, model))
    return rounded(
        found,
        {"avg_abs_coefficient": 2, "sum_abs_coefficient": 2, "median_abs_coefficient": 2},
    )


@query
def field_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rollup(spark, sf_dir, 0.0)


@query
def ridge_field_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rollup(spark, sf_dir, STRONG_PENALTY)


@query
def field_of_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots of the encoded part types, and the source column read from the slot name."""
    from keydrivers.functions import field_of

    slots = table(spark, sf_dir, "part").select(
        F.concat(F.lit("p_type_vec_"), F.col("p_type")).alias("slot"), "p_brand"
    )
    every = slots.select("slot").unionByName(
        slots.select(F.concat("p_brand", F.lit("_vec")).alias("slot"))
    ).unionByName(slots.select(F.col("p_brand").alias("slot")))
    return every.groupBy("slot", field_of("slot").alias("field")).agg(F.count("*").alias("n"))


def _scored(spark, sf_dir, spec, penalty=0.0) -> DataFrame:
    marked = _marked(spark, sf_dir)
    with kept(marked) as rows:
        model = ops.fit_linear(rows.where("split = 'train'"), spec, penalty)
    return ops.score(model, marked)


@query
def priority_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ops.residual_table(
        _scored(spark, sf_dir, PRIORITY_SPEC), "target", ("o_orderkey", "split")
    )
    return rounded(found, {"prediction": 1, "residual": 1})


@query
def full_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ops.residual_table(
        _scored(spark, sf_dir, ORDER_SPEC), "target", ("o_orderkey", "split")
    )
    return rounded(found, {"prediction": 1, "residual": 1})


_METRICS = {"rmse": 3, "mae": 3, "r2": 8}


@query
def metrics_by_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _scored(spark, sf_dir, PRIORITY_SPEC).where("split = 'test'")
    return rounded(ops.regression_metrics(scored, "target", by="o_orderpriority"), _METRICS)


@query
def linear_overfit(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = _marked(spark, sf_dir)
    with kept(marked) as rows:
        model = ops.fit_linear(rows.where("split = 'train'"), ORDER_SPEC)
    return rounded(ops.overfit_report(model, marked, "linear_full"), _METRICS)


@query
def linear_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = _marked(spark, sf_dir)
    candidates = {
        "linear_numeric": (NUMERIC_SPEC, 0.0),
        "linear_full": (ORDER_SPEC, 0.0),
        "linear_priority": (PRIORITY_SPEC, 0.0),
        "ridge_full": (ORDER_SPEC, STRONG_PENALTY),
    }
    with kept(marked) as rows:
        train = rows.where("split = 'train'")
        models = {name: ops.fit_linear(train, *how) for name, how in candidates.items()}
    return rounded(ops.leaderboard([ops.overfit_reports(models, marked)]), _METRICS)


# --- Tuning --------------------------------------------------------------------------------


def _ridge_cv(spark, sf_dir, spec, name, grid=ops.RIDGE_GRID) -> ops.CvResult:
    with kept(ops.assign_folds(_train(spark, sf_dir), ORDER_KEY)) as train:
        return ops.ridge_cv(train, spec, grid, metrics=("r2", "rmse"), model=name)


def _cv_table(spark, result) -> DataFrame:
    digits = F.when(F.col("metric") == "r2", 8).otherwise(3)
    found = ops.cv_report(spark, result)
    return found.withColumns(
        {
            c: F.when(digits == 8, F.round(c, 8)).otherwise(F.round(c, 3))
            for c in ("mean", "std")
        }
    )


@query
def ridge_cv_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cv_table(spark, _ridge_cv(spark, sf_dir, NUMERIC_SPEC, "numeric"))


@query
def ridge_cv_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cv_table(spark, _ridge_cv(spark, sf_dir, ORDER_SPEC, "full"))


@query
def ridge_cv_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cv_table(spark, _ridge_cv(spark, sf_dir, PRIORITY_SPEC, "priority"))


@query
def ridge_cv_strong(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = (0.0, 5_000.0, STRONG_PENALTY, 100_000.0)
    return _cv_table(spark, _ridge_cv(spark, sf_dir, ORDER_SPEC, "strong", grid))


@query
def best_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = (0.0, 5_000.0, STRONG_PENALTY, 100_000.0)
    return ops.best_params(spark, _ridge_cv(spark, sf_dir, ORDER_SPEC, "strong", grid))


@query
def cv_by_refitting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same scores as from moments, with one Spark fit for each fold and penalty."""
    train = ops.assign_folds(_train(spark, sf_dir), ORDER_KEY)
    result = ops.cross_validate(
        train,
        PRIORITY_SPEC,
        ops.linear_regressor(PRIORITY_SPEC),
        {"regParam": ops.RIDGE_GRID},
        metrics=("r2", "rmse"),
        model="refitted",
        parallelism=4,
    )
    return _cv_table(spark, result)


@query
def ridge_cv_full_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same scores as ``ridge_cv_full``, by Spark fits."""
    train = ops.assign_folds(_train(spark, sf_dir), ORDER_KEY)
    result = ops.ridge_cv(
        train, ORDER_SPEC, metrics=("r2", "rmse"), model="full", method="pipeline", parallelism=4
    )
    # Without a penalty Spark iterates, to a tolerance.
    return ops.cv_report(spark, result).withColumns(
        {
            c: F.when(F.col("metric") == "r2", F.round(c, 6)).otherwise(F.round(c, 1))
            for c in ("mean", "std")
        }
    )


# --- Random forest -------------------------------------------------------------------------


def _forest(spark, sf_dir) -> tuple[DataFrame, ops.FittedRegression]:
    """The scores of a forest on both sides of the split, from the rows it was fitted on, and the forest."""
    with kept(_marked(spark, sf_dir)) as rows:
        model = ops.fit_forest(rows.where("split = 'train'"), ORDER_SPEC)
        # A row for each side; taken here, the rows are not joined again for it.
        report = checkpointed(ops.overfit_report(model, rows, "forest"))
    return report, model


def _forest_alone(spark, sf_dir) -> ops.FittedRegression:
    with kept(_train(spark, sf_dir)) as rows:
        return ops.fit_forest(rows, ORDER_SPEC)


@query
def forest_overfit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _forest(spark, sf_dir)[0]


@query
def feature_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.feature_importance(spark, _forest_alone(spark, sf_dir))


@query
def importance_by_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    importances = ops.feature_importance(spark, _forest_alone(spark, sf_dir))
    return ops.importance_by_field(importances)


def _forest_cv(spark, sf_dir):
    train = ops.assign_folds(_train(spark, sf_dir), ORDER_KEY)
    return ops.forest_cv(train, ORDER_SPEC, parallelism=4)


@query
def forest_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and spread of R² at every point of the grid."""
    return ops.cv_report(spark, _forest_cv(spark, sf_dir))


@query
def best_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.best_params(spark, _forest_cv(spark, sf_dir))


@query
def leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    with kept(_marked(spark, sf_dir)) as rows:
        train = rows.where("split = 'train'")
        models = {
            "linear_full": ops.fit_linear(train, ORDER_SPEC),
            "ridge_full": ops.fit_linear(train, ORDER_SPEC, STRONG_PENALTY),
            "forest": ops.fit_forest(train, ORDER_SPEC),
        }
        # Two rows for each model; taken here, the rows are not joined again for them.
        reports = checkpointed(ops.overfit_reports(models, rows))
    return ops.leaderboard([reports])


@query
def tree_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linear models, a ridge and a tree on one table, scored in one read."""
    marked, tree = _tree(spark, sf_dir)
    with kept(marked) as rows:
        train = rows.where("split = 'train'")
        models = {
            "linear_numeric": ops.fit_linear(train, NUMERIC_SPEC),
            "tree": tree,
            "ridge_full": ops.fit_linear(train, ORDER_SPEC, STRONG_PENALTY),
            "linear_priority": ops.fit_linear(train, PRIORITY_SPEC),
        }
    return rounded(ops.leaderboard([ops.overfit_reports(models, marked)]), _METRICS)


# --- One tree, whose splits SQL can find ----------------------------------------------------


def _tree(spark, sf_dir) -> tuple[DataFrame, ops.FittedRegression]:
    """Depth 2 over columns of few values, all rows and both columns at every split."""
    marked = _marked(spark, sf_dir)
    with kept(marked) as rows:
        model = ops.fit_forest(
            rows.where("split = 'train'"),
            TREE_SPEC,
            num_trees=1,
            max_depth=2,
            min_info_gain=0.0,
            bootstrap=False,
            featureSubsetStrategy="all",
        )
    return marked, model


@query
def tree_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked, model = _tree(spark, sf_dir)
    found = ops.residual_table(ops.score(model, marked), "target", ("o_orderkey", "split"))
    return rounded(found, {"prediction": 2, "residual": 2})


@query
def tree_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked, model = _tree(spark, sf_dir)
    return rounded(ops.overfit_report(model, marked, "tree"), _METRICS)


@query
def tree_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ops.feature_importance(spark, _tree(spark, sf_dir)[1])
    return rounded(found, {"importance": 6})


@query
def tree_importance_by_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ops.importance_by_field(ops.feature_importance(spark, _tree(spark, sf_dir)[1]))
    return rounded(found, {"importance": 6})


@query
def importance_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = ops.feature_importance(spark, _tree(spark, sf_dir)[1])
    path = write_table(result, scratch_dir(spark, "importance-csv"), single_file=True)
    return rounded(read_table(spark, path, result.schema), {"importance": 6})


def _tree_cv(spark, sf_dir):
    train = ops.assign_folds(_train(spark, sf_dir), ORDER_KEY)
    grid = {"numTrees": (1,), "maxDepth": (1, 2), "minInfoGain": (0.0,)}
    return ops.forest_cv(
        train, TREE_SPEC, grid, model="tree", metrics=("r2", "rmse", "mae"), parallelism=4,
        bootstrap=False, featureSubsetStrategy="all",
    )


@query
def tree_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depths 1 and 2 of a single tree, both from the deeper one of each fold."""
    found = ops.cv_report(spark, _tree_cv(spark, sf_dir))
    return rounded(found, {"mean": 4, "std": 4})


@query
def best_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.best_params(spark, _tree_cv(spark, sf_dir))


@query
def forest_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold for any forest: rows by split, importances that add up, slots by field."""
    report, model = _forest(spark, sf_dir)
    importances = ops.feature_importance(spark, model)
    total = importances.agg(F.round(F.sum("importance"), 6).alias("value"))
    slots = importances.groupBy("field").agg(F.count("*").cast("double").alias("value"))
    fields = ops.importance_by_field(importances).agg(F.round(F.sum("importance"), 6).alias("value"))
    return (
        report.select(F.concat(F.lit("rows "), "split").alias("name"), F.col("n").cast("double").alias("value"))
        .unionByName(total.withColumn("name", F.lit("importance")))
        .unionByName(fields.withColumn("name", F.lit("importance of fields")))
        .unionByName(slots.select(F.concat(F.lit("slots "), "field").alias("name"), "value"))
    )


# --- Gaps, small units, many levels ---------------------------------------------------------


@query
def small_unit_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A predictor in units of 1e12."""
    train = _train(spark, sf_dir).withColumn("tiny", F.col("n_lines") * F.lit(1e-12))
    model = ops.fit_linear(train, FeatureSpec(("tiny",), (), "target"))
    found = ops.coefficient_table(spark, model, intercept=True)
    scaled = F.when(F.col("feature") == "tiny", F.col("coefficient") * 1e-12)
    return found.select(
        "feature", F.round(F.coalesce(scaled, "coefficient"), 2).alias("coefficient")
    )


@query
def histogram_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    gaps = F.when(F.col("l_linenumber") == 2, F.lit(float("nan"))).when(
        F.col("l_linenumber") != 3, F.col("l_quantity")
    )
    lines = table(spark, sf_dir, "lineitem").select(gaps.alias("v"))
    return rounded(ops.histogram(lines, "v", 0.0, 60.0, 6), {"lower": 4, "upper": 4})


@query
def correlation_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where y is set, x is far from its mean over all rows and varies little."""
    lines = table(spark, sf_dir, "lineitem")
    far = F.lit(1e6) + F.col("l_extendedprice") * F.lit(1e-5)
    odd = F.col("l_linenumber") % 2 == 1
    rows = lines.select(
        F.when(odd, 0.0).otherwise(far).alias("x"),
        F.when(~odd, F.col("l_extendedprice") * F.col("l_discount")).alias("y"),
    )
    return rounded(ops.correlation_matrix(rows, ["x", "y"]), {"r": 6})


@query
def gradient_many_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as ``linear_many_levels`` without second moments on the driver."""
    lines = table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") % 2200).cast("string").alias("level"), "l_quantity", "l_extendedprice"
    )
    spec = FeatureSpec(("l_quantity",), ("level",), "l_extendedprice")
    found = ops.coefficient_table(spark, ops.fit_linear(lines, spec, method="gradient"))
    return rounded(found.select("feature", "field", "category", "coefficient"), {"coefficient": 2})


@query
def gradient_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four numbers and three categories, with a penalty."""
    return _coefficients(
        spark, sf_dir, ORDER_SPEC, STRONG_PENALTY, lambda df, spec, penalty: ops.fit_linear(df, spec, penalty, method="gradient")
    )


@query
def correlation_wide_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """24 columns, each with gaps of its own: prices of lines at one of 24 places of a cycle are missing."""
    lines = table(spark, sf_dir, "lineitem")
    place = (F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 24
    value = F.col("l_extendedprice") + F.col("l_quantity") * 500
    columns = {
        f"c{k:02d}": F.when(place != k, value * F.lit(1.0 + k) + F.pmod(F.col("l_partkey") * (k + 3), F.lit(997)) * 100.0)
        for k in range(24)
    }
    rows = lines.select([c.alias(name) for name, c in columns.items()])
    return rounded(ops.correlation_matrix(rows, list(columns)), {"r": 8})


@query
def linear_many_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """More than 2,000 levels of a category."""
    lines = table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") % 2200).cast("string").alias("level"), "l_quantity", "l_extendedprice"
    )
    model = ops.fit_linear(lines, FeatureSpec(("l_quantity",), ("level",), "l_extendedprice"))
    found = ops.coefficient_table(spark, model)
    return rounded(found.select("feature", "field", "category", "coefficient"), {"coefficient": 2})
