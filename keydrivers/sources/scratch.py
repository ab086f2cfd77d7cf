"""Rows that are kept for a while: cached, or in the shared scratch folder of the cluster.

The cluster names that folder in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def _checkpoint_root(spark: SparkSession) -> str:
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root and re.fullmatch(r"local(\[.*\])?", context.master):
        # Driver and tasks are one process here; local-cluster and clusters must name a folder.
        root = tempfile.mkdtemp(prefix="keydrivers-")
        context.setCheckpointDir(root)
    if not root:
        raise RuntimeError("spark.checkpoint.dir must name a folder that every executor can reach")
    return root


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder name below the shared checkpoint folder."""
    return f"{_checkpoint_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read on from there.

    A reliable checkpoint survives lost executors, and the plan behind it is cut.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(_checkpoint_root(df.sparkSession))
    return df.checkpoint(eager=True)


@contextmanager
def kept(df: DataFrame) -> Iterator[DataFrame]:
    """Keep rows that several passes read, in memory and else on executor disks.

    A lost executor costs the recomputation of its partitions, not the run. Rows that the caller
    has cached already stay as they are.
    """
    cached = df.storageLevel.useMemory or df.storageLevel.useDisk
    stored = df if cached else df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield stored
    finally:
        if not cached:
            stored.unpersist()
