"""Compare Spark results with DuckDB results, whatever the order of rows and columns."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def duckdb_on(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def _plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return repr(value + 0.0)
    return repr(value)


def row_set(columns: list[str], rows) -> list[tuple[str, ...]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(row[i]) for i in order) for row in rows)


def differences(spark_df, connection: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """Empty if both have the same column names and the same rows, value types included."""
    expected = connection.sql(sql)
    found = []
    if sorted(spark_df.columns) != sorted(expected.columns):
        found.append(f"columns {sorted(spark_df.columns)} != {sorted(expected.columns)}")
        return found
    left = row_set(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    right = row_set(expected.columns, expected.fetchall())
    if len(left) != len(right):
        found.append(f"{len(left)} rows != {len(right)} rows")
    only_left = sorted(set(left) - set(right))[:3]
    only_right = sorted(set(right) - set(left))[:3]
    if left != right:
        found.append(f"only Spark: {only_left}; only SQL: {only_right}")
    return found
