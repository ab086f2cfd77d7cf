from __future__ import annotations

from keydrivers.llm.id_filter import filter_bits, id_test, only_ids, without_ids
from pyspark.sql import functions as F


def test_rows_with_and_without_ids(spark):
    rows = [(i % 700, f"t{i}", None) for i in range(1400)] + [(None, "null", 1.5), (-(2**62), "low", 2.5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, other double")
    ids = spark.createDataFrame([(i,) for i in [*range(0, 700, 7), 9999, -(2**62)]], "id bigint")
    wanted = {r.id for r in ids.collect()}
    has = sorted((r for r in rows if r[0] in wanted), key=repr)
    assert sorted(map(tuple, only_ids(docs, ids).collect()), key=repr) == has
    rest = sorted((r for r in rows if r[0] not in wanted), key=repr)
    assert sorted(map(tuple, without_ids(docs, ids).collect()), key=repr) == rest
    assert docs.where(id_test(ids)(F.col("doc_id"))).count() < len(has) + 20
    assert without_ids(docs, ids.where("false")).count() == len(rows)
    assert only_ids(docs.where("false"), ids).count() == 0


def test_filter_grows_with_the_ids_up_to_a_bound():
    assert [filter_bits(n) for n in (0, 1 << 19, 1 << 20, 10_000_000, 1 << 40)] == [24, 24, 25, 28, 28]


def test_no_text_goes_through_python(spark, edge_docs):
    ids = spark.createDataFrame([(3,)], "id bigint")
    plan = only_ids(edge_docs, ids)._jdf.queryExecution().executedPlan().toString()
    calls = [line for line in plan.splitlines() if "ArrowEvalPython" in line]
    assert calls and all("xxhash64" in line.split("], [")[0] or "may_be(" in line for line in calls)
    assert "MapInArrow" not in plan
