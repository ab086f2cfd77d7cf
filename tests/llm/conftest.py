from __future__ import annotations

import pytest

LONG = "lorem ipsum dolor sit amet consectetur " * 3000

EDGE_TEXTS = [
    None,
    "",
    " \t\n\x0b\f\r ",
    "one",
    "a b c a b c a b c",
    "dup line here\ndup line here\n\n \nother\ndup line here",
    "nbsp stays one word   too",
    "É è ñ 日本語 🙂 #$%&|<>*",
    LONG,
    LONG,
    "x" * 200_000,
]


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows, clashing names."""
    rows = [(i, t, f"s{i % 3}", i, "own") for i, t in enumerate(EDGE_TEXTS)]
    rows += [(3, "one", "s0", 3, "own"), (None, "no id", None, None, None)]
    schema = "doc_id bigint, text string, source string, n_tokens bigint, kept string"
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").persist()


def rows_by(df, key="doc_id"):
    found = {}
    for row in df.collect():
        found.setdefault(row[key], []).append(row)
    return found
