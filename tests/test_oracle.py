"""Every query with reference SQL gives the rows of that SQL."""

from __future__ import annotations

import pytest
from compare import differences, duckdb_on

import __spark_entry__ as entry_module

QUERIES = entry_module.queries()
ORACLE = entry_module.oracle_sql()


@pytest.fixture(scope="module")
def connection(sf_dir):
    return duckdb_on(sf_dir)


def test_every_reference_has_a_query():
    assert not set(ORACLE) - set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_reference(name, spark, sf_dir, connection):
    assert differences(QUERIES[name](spark, sf_dir), connection, ORACLE[name]) == []


def test_entry_has_a_stable_schema(spark):
    found = entry_module.entry(spark)
    assert found.columns == ["feature", "r", "abs_r"]
    assert found.first()["feature"] == "n_lines"
