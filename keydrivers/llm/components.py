"""Connected components of a graph whose edges are rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, stored


def _downward(edges: DataFrame) -> DataFrame:
    """Each edge once, from the larger node to the smaller."""
    high, low = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    return edges.where("a <> b").select(high, low).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Tie all larger neighbours of a node to the smallest of the node and its neighbours."""
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    least = least.select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Tie a node and its smaller neighbours to the smallest of these."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    beside = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return beside.unionAll(least.select("a", F.col("m").alias("b")))


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b), named by the smallest node.

    Large-star and small-star steps in turn (Kiveris et al., 2014) until nothing changes. Only minima
    are gathered by node, and joins with them can be split by Spark, so a hub with any number of
    neighbours burdens no task. Every round is written to the shared scratch folder. Edges that
    repeat or join a node with itself are no matter; edges with nulls are left out. No edges give no
    rows.
    """
    now = stored(_downward(edges.select("a", "b").dropna()), "edges")
    mark = _mark(now)
    while mark[0]:
        after = stored(_downward(_small_star(_downward(_large_star(now)))), "edges")
        dropped(now)
        before, mark, now = mark, _mark(after), after
        if mark == before:
            break
    members = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return members.unionAll(roots)
