"""Feature tables derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keydrivers import FeatureSpec

ORDER_SPEC = FeatureSpec(
    numeric=("n_lines", "qty", "avg_disc", "order_year"),
    categorical=("o_orderpriority", "o_orderstatus", "c_mktsegment"),
    target="target",
)
NUMERIC_SPEC = FeatureSpec(numeric=ORDER_SPEC.numeric, target="target")
PRIORITY_SPEC = FeatureSpec(
    numeric=("n_lines",), categorical=("o_orderpriority",), target="target"
)
TREE_SPEC = FeatureSpec(numeric=("n_lines", "order_year"), target="target")
ORDER_KEY = ["o_orderkey"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each order with lines: its attributes, line measures and total price.

    Lines are summed up by order before any join, so only one row for each order meets the other
    tables.
    """
    lines = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey")
        .agg(
            F.count("*").alias("n_lines"),
            F.sum("l_quantity").alias("qty"),
            F.round(F.avg("l_discount"), 6).alias("avg_disc"),
            F.round(F.sum("l_extendedprice"), 2).alias("target"),
        )
    )
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        "o_custkey",
        F.year("o_orderdate").alias("order_year"),
        "o_orderpriority",
        "o_orderstatus",
    )
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return (
        orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .select(
            "o_orderkey",
            "order_year",
            "o_orderpriority",
            "o_orderstatus",
            "c_mktsegment",
            "n_lines",
            "qty",
            "avg_disc",
            "target",
        )
    )


def doc_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their labels where there are any."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return documents.join(table(spark, sf_dir, "labels"), "doc_id", "left").select(
        "doc_id", "lang", "source", "n_chars", "quality", "toxic"
    )
