"""Every point of a forest grid from one forest for each fold.

Trees grow greedily from the root, one after the other. So a forest holds the forests of fewer trees (its first
ones), of less depth (cut below that depth) and of a higher least gain (cut where a split gains less). The
largest forest of a fold is fitted once; one scan scores all points of all folds.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml.feature import VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import scratch_dir
from .features import FEATURES

NESTED = ("numTrees", "maxDepth", "minInfoGain")
MOST_NODES = 20_000_000


def forest_nodes(model: RandomForestRegressionModel) -> DataFrame:
    """(tree, node, prediction, n, gain, left, right, feature, threshold, categories): the trees as rows.

    A leaf has no children (-1). A row goes left if its feature is at most the threshold, or, where
    that is null, one of the categories.
    """
    spark = SparkSession.active()
    path = scratch_dir(spark, "forest")
    model.write().save(path)
    node = F.col("nodeData")
    split = node["split"]
    numeric = split["numCategories"] == -1
    values = split["leftCategoriesOrThreshold"]
    return spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"),
        node["id"].alias("node"),
        node["prediction"].alias("prediction"),
        node["rawCount"].alias("n"),
        node["gain"].alias("gain"),
        node["leftChild"].alias("left"),
        node["rightChild"].alias("right"),
        split["featureIndex"].alias("feature"),
        F.when(numeric, F.get(values, F.lit(0))).alias("threshold"),
        F.when(~numeric, values).alias("categories"),
    )


def forest_arrays(model: RandomForestRegressionModel) -> dict[str, np.ndarray]:
    """The trees as flat arrays; a leaf leads back to itself.

    A forest has at most trees * 2 ** (depth + 1) nodes, a bound that the grid sets.
    """
    found = forest_nodes(model).toArrow().sort_by([("tree", "ascending"), ("node", "ascending")])
    if found.num_rows > MOST_NODES:
        raise ValueError(
            f"{found.num_rows} nodes are too many for one forest in a task: use method='refit' or a smaller grid"
        )
    columns = {c: found.column(c).to_numpy() for c in ("tree", "node", "prediction", "gain", "left", "right", "feature")}
    index = np.arange(found.num_rows)
    begin = np.searchsorted(columns["tree"], columns["tree"])
    inner = columns["left"] >= 0
    bits = np.zeros(found.num_rows, np.uint64)
    for k, values in enumerate(found.column("categories").to_pylist()):
        for value in values or ():
            if value >= 64:
                raise ValueError("a split over more than 64 categories: use method='refit'")
            bits[k] |= np.uint64(1 << int(value))
    threshold = found.column("threshold").to_numpy()
    return {
        "root": np.flatnonzero(columns["node"] == 0),
        "prediction": columns["prediction"],
        "gain": np.where(inner, columns["gain"], -np.inf),
        "left": np.where(inner, begin + columns["left"], index),
        "right": np.where(inner, begin + columns["right"], index),
        "feature": np.where(inner, columns["feature"], -1),
        # Categories of a one-hot slot are 0 and 1; NaN marks such a split.
        "threshold": np.where(inner, threshold, np.inf),
        "bits": bits,
    }


def _partial_scores(shared, trees: Sequence[int], depths: Sequence[int], gains: Sequence[float], centre: float):
    """For mapInArrow over (fold, target, slots): sums over a task's rows for each fold and point."""

    def walk(forest, x: np.ndarray, least: float) -> Iterator[tuple[int, int, np.ndarray]]:
        """(trees so far, depth, sum of their predictions) at every wanted number and depth."""
        total = {d: np.zeros(len(x)) for d in depths}
        rows = np.arange(len(x))
        for t, root in enumerate(forest["root"][: max(trees)]):
            node = np.full(len(x), root)
            for depth in range(max(depths) + 1):
                if depth in total:
                    total[depth] += forest["prediction"][node]
                if depth == max(depths):
                    break
                value = x[rows, np.maximum(forest["feature"][node], 0)]
                threshold = forest["threshold"][node]
                left = value <= threshold
                listed = np.isnan(threshold)
                if listed.any():
                    category = value[listed].astype(np.uint64)
                    left[listed] = forest["bits"][node[listed]] >> category & np.uint64(1)
                after = np.where(left, forest["left"][node], forest["right"][node])
                node = np.where(forest["gain"][node] >= least, after, node)
            if t + 1 in trees:
                for depth in depths:
                    yield t + 1, depth, total[depth]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            folds = batch.column("fold").to_numpy()
            y = batch.column("target").to_numpy() - centre
            slots = batch.column("slots")
            values = slots.flatten().to_numpy(zero_copy_only=False)
            x = values.reshape(batch.num_rows, -1) if len(values) else np.zeros((batch.num_rows, 1))
            for fold in np.unique(folds):
                part = folds == fold
                own = y[part]
                for k, least in enumerate(gains):
                    for n_trees, depth, total in walk(shared.value[int(fold)], x[part], least):
                        error = own - (total / n_trees - centre)
                        key = (int(fold), n_trees, depth, k)
                        found = (len(own), (error**2).sum(), np.abs(error).sum(), own.sum(), (own**2).sum())
                        sums[key] = sums.get(key, 0.0) + np.array(found)
        if sums:
            keys = np.array(list(sums), dtype="int32").T
            columns = [pa.array(c) for c in keys] + [pa.array(c) for c in np.array(list(sums.values())).T]
            names = ["fold", "trees", "depth", "least", "n", "sse", "sae", "sy", "syy"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def nested_scores(
    vectors: DataFrame,
    models: Mapping[int, RandomForestRegressionModel],
    target: str,
    fold: str,
    trees: Sequence[int],
    depths: Sequence[int],
    gains: Sequence[float],
    parallelism: int = 2,
) -> DataFrame:
    """``scores_of_arrays`` of the forest of each fold."""
    with ThreadPool(parallelism) as pool:
        arrays_of = pool.map(inheritable_thread_target(vectors.sparkSession)(forest_arrays), models.values())
    forests = dict(zip(models, arrays_of, strict=True))
    return scores_of_arrays(vectors, forests, target, fold, trees, depths, gains)


def scores_of_arrays(
    vectors: DataFrame,
    forests: Mapping[int, dict[str, np.ndarray]],
    target: str,
    fold: str,
    trees: Sequence[int],
    depths: Sequence[int],
    gains: Sequence[float],
) -> DataFrame:
    """(fold, trees, depth, least, n, rmse, mae, r2) of the rows of each fold under the forest of that fold.

    Forests are as ``forest_arrays`` gives them. ``least`` is the place of a least gain in ``gains``. One scan; what is
    shuffled is one row for each task, fold and point.
    """
    spark = vectors.sparkSession
    used = sorted({int(s) for a in forests.values() for s in a["feature"] if s >= 0}) or [0]
    place = np.full(max(used) + 2, 0)
    place[used] = np.arange(len(used))
    forests = {f: arrays | {"feature": place[arrays["feature"]]} for f, arrays in forests.items()}
    centre = vectors.agg(F.avg(F.col(target).cast("double"))).first()[0] or 0.0
    shared = spark.sparkContext.broadcast(forests)
    slicer = VectorSlicer(inputCol=FEATURES, outputCol="__slots", indices=used)
    rows = slicer.transform(vectors.where(F.col(target).isNotNull())).select(
        F.col(fold).cast("int").alias("fold"),
        F.col(target).cast("double").alias("target"),
        vector_to_array("__slots").alias("slots"),
    )

    run = _partial_scores(shared, tuple(trees), tuple(depths), tuple(gains), centre)
    schema = "fold int, trees int, depth int, least int, n double, sse double, sae double, sy double, syy double"
    sums = rows.mapInArrow(run, schema).groupBy("fold", "trees", "depth", "least")
    sums = sums.agg(*[F.sum(c).alias(c) for c in ("n", "sse", "sae", "sy", "syy")])
    spread = F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")
    return sums.select(
        "fold",
        "trees",
        "depth",
        "least",
        F.col("n").cast("bigint").alias("n"),
        F.sqrt(F.col("sse") / F.col("n")).alias("rmse"),
        (F.col("sae") / F.col("n")).alias("mae"),
        (F.lit(1.0) - F.try_divide(F.col("sse"), F.when(spread > 0, spread))).alias("r2"),
    )
