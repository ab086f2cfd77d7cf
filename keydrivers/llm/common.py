"""Helpers that several operators share: scratch tables, batches of bounded size, shared files."""

from __future__ import annotations

import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keydrivers.sources import scratch_dir

SLICE_BYTES = 4 << 20


@lru_cache(maxsize=1)
def _package() -> str:
    """The library as a zip file, on the driver."""
    top = Path(__file__).resolve().parents[2]
    base = Path(tempfile.mkdtemp(prefix="keydrivers-zip-")) / "keydrivers"
    return shutil.make_archive(str(base), "zip", top, "keydrivers")


def on_executors(spark: SparkSession) -> None:
    """Let Spark hand the library to executors, whose Python may not have it installed."""
    context = spark.sparkContext
    if _package() not in getattr(context, "_python_includes_done", ()):
        context.addPyFile(_package())
        context._python_includes_done = {_package()}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def picked(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the names an operator works with.

    Other columns of the caller never meet those that an operator adds, whatever their names.
    """
    return df.select(*[F.col(f"`{source}`").alias(name) for name, source in columns.items()])


def boxed(df: DataFrame, **columns: str | Column) -> DataFrame:
    """Every row as one struct ``row``, beside columns under the names an operator works with.

    So the caller's columns, all of which an operator keeps, never meet its own; ``row.*`` is the row.
    """
    named = {n: F.col(f"`{c}`") if isinstance(c, str) else c for n, c in columns.items()}
    return df.select(F.struct("*").alias("row"), *[c.alias(n) for n, c in named.items()])


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write rows to the shared scratch folder once, and read on from there.

    The plan behind them is cut, they survive lost executors, and the optimiser knows their size.
    """
    path = scratch_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete the files of a ``stored`` table that nothing reads any more."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for folder in {name.rpartition("/")[0] for name in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def deleted(spark: SparkSession, folder: str) -> None:
    """Delete a scratch folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def is_empty(df: DataFrame) -> bool:
    return not df.take(1)


def give_back() -> None:
    """Return memory that a task no longer uses: its worker lives on beside those of other stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def slices(batches: Iterable[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Cut batches into runs of rows with about SLICE_BYTES in ``column``."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(False)
        ends = np.cumsum(lengths.astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = int(np.searchsorted(ends, before + SLICE_BYTES, side="right"))
            stop = max(stop, start + 1)
            yield batch.slice(start, stop - start)
            start = stop
    give_back()


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of every text, nulls as empty ones."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def as_texts(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


class BoundedCache(dict):
    """Values by key, made when asked for; starts afresh when it is full."""

    def __init__(self, make: Callable, limit: int, fixed: dict | None = None):
        super().__init__(fixed or {})
        self.make, self.limit, self.fixed = make, limit, fixed or {}

    def __missing__(self, key):
        self.trim()
        value = self[key] = self.make(key)
        return value

    def trim(self) -> None:
        if len(self) > self.limit + len(self.fixed):
            self.clear()
            self.update(self.fixed)


def letters(text: Column) -> Column:
    """A null text is an empty one."""
    return F.coalesce(text, F.lit(""))


def filesystem(uri: str):
    """The file system of a shared folder and the path in it, in a task or on the driver."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


def fresh_name(stem: str, suffix: str) -> str:
    """A file name of this attempt alone: a task that runs twice writes two files, and the rows
    of the attempt that Spark commits name the one that counts."""
    return f"{stem}-{uuid.uuid4().hex}{suffix}"
