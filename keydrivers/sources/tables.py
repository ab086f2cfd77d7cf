"""Reading, writing and describing tables."""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_SCHEMA_REPORT = T.StructType(
    [
        T.StructField("ordinal", T.IntegerType(), False),
        T.StructField("column", T.StringType(), False),
        T.StructField("type", T.StringType(), False),
        T.StructField("nullable", T.BooleanType(), False),
    ]
)


def read_table(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str | None = None,
    fmt: str = "csv",
    **options: str,
) -> DataFrame:
    """Read one table. CSV has a header row.

    With a ``schema`` nothing is read before the first action; without one, CSV types are
    inferred, which costs one more pass over the file.
    """
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True)
        if schema is None:
            reader = reader.option("inferSchema", True)
    return reader.options(**options).load(path)


def write_table(
    df: DataFrame,
    path: str,
    fmt: str = "csv",
    single_file: bool = False,
    partition_by: Iterable[str] = (),
    mode: str = "overwrite",
    **options: str,
) -> str:
    """Write one table and return its path.

    ``single_file`` is for result tables that an outside chart tool picks up: one file means one
    task, whatever the number of rows.
    """
    if single_file:
        # Unlike coalesce(1), this keeps the work before the write parallel.
        df = df.repartition(1)
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    partition_by = list(partition_by)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.options(**options).save(path)
    return path


_ARROW_TYPES = {
    T.StringType(): pa.string(),
    T.DoubleType(): pa.float64(),
    T.IntegerType(): pa.int32(),
    T.BooleanType(): pa.bool_(),
}


def rows_to_frame(spark: SparkSession, rows: Iterable[tuple], schema: T.StructType) -> DataFrame:
    """A DataFrame of model results; its size is the number of slots, never of data rows.

    As an Arrow table it becomes a local relation of known size, read without Python workers.
    """
    rows = list(rows)
    arrays = [
        pa.array([row[i] for row in rows], _ARROW_TYPES[field.dataType])
        for i, field in enumerate(schema.fields)
    ]
    return spark.createDataFrame(pa.table(arrays, names=schema.names), schema)


def result_schema(**types: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in types.items()])


def schema_report(df: DataFrame) -> DataFrame:
    """One row for each column: (ordinal, column, type, nullable)."""
    rows = [
        (i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(df.schema.fields)
    ]
    return rows_to_frame(df.sparkSession, rows, _SCHEMA_REPORT)
