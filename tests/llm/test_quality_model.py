from __future__ import annotations

import zlib

import numpy as np
from keydrivers.llm.quality_model import (
    STATISTICS,
    Model,
    Settings,
    _sums,
    described,
    fitted,
    scored,
)
from pyspark.sql import functions as F


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    rows = scored(docs, labels).toPandas()
    assert len(rows) == docs.count()
    assert rows.score.between(0, 1).all()
    assert (rows.predicted == (rows.score >= 0.3)).all()
    assert (rows.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in rows.doc_id]).all()
    both = rows[rows.held_out].merge(labels.toPandas(), on="doc_id")
    assert (both.predicted == both.quality).mean() >= 0.97


def test_held_out_labels_have_no_influence(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    other = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = (scored(docs, x).orderBy("doc_id").toPandas() for x in (labels, other))
    assert np.allclose(one.score, two.score, atol=1e-9)


def test_normal_equations_are_those_of_all_rows(spark):
    drawn = np.random.default_rng(1)
    x, y = drawn.normal(size=(300, len(STATISTICS))), drawn.integers(0, 2, 300).astype(float)
    model = Model(Settings(features=16, tasks=3), x.mean(0), x.std(0))
    rows = spark.createDataFrame([(a.tolist(), float(b)) for a, b in zip(x, y)], "x array<double>, y double")
    z = model.cosines(x)
    assert np.allclose(_sums(rows, model), np.hstack([z.T @ z, (z.T @ y)[:, None]]))


def test_cosines_approximate_the_kernel():
    drawn = np.random.default_rng(2)
    x = drawn.normal(size=(40, len(STATISTICS)))
    model = Model(Settings(features=4096), np.zeros(len(STATISTICS)), np.ones(len(STATISTICS)))
    z = model.cosines(x)[:, :-1]
    distance = ((x[:, None] - x[None]) ** 2).sum(-1)
    assert np.abs(z @ z.T - np.exp(-distance / (2 * 4.0**2))).max() < 0.08


def test_edge_cases(spark, edge_docs, no_docs):
    labels = spark.createDataFrame(
        [(1, 0, 0), (3, 1, 0), (8, 1, None), (9, None, 0), (None, 1, 1), (3, 1, 0)],
        "doc_id bigint, quality int, toxic int",
    )
    assert scored(edge_docs, labels).count() == edge_docs.count()
    assert scored(no_docs, labels).count() == 0
    none = scored(edge_docs, labels.where("false")).collect()
    assert {(r.score, r.predicted) for r in none} == {(0.5, 1)}
    one_class = scored(edge_docs, labels.where("quality = 1")).collect()
    assert all(r.score > 0.9 for r in one_class if r.doc_id in (3, 8))
    assert fitted(described(edge_docs), labels.select("doc_id", F.col("quality").alias("y"))).weights is not None
