from __future__ import annotations

import sys
from pathlib import Path

import corpus_pipeline
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))

from test_decontaminate import brute_force  # noqa: E402
from test_near_dedup import expected as groups  # noqa: E402
from test_quality_rules import expected as rules  # noqa: E402
from test_secrets import expected as secrets  # noqa: E402


def cleaned(text):
    spans = [tuple(map(int, x.split(":")[1:])) for x in secrets(text)[4].split(",") if x]
    out, at = "", 0
    for a, b in spans:
        if a >= at:
            out += text[at:a] + "[secret]"
        at = max(at, b)
    return out + text[at:]


def test_stages_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    rows = {r.doc_id: r.text for r in docs.collect()}
    rows = {i: t for i, t in rows.items() if not rules(t)[5]}
    found = groups(list(rows.items()))
    rows = {i: t for i, t in rows.items() if found[i][2]}
    suspects = [(i, t) for i, t in rows.items() if any(x in t for _, k in items for x in [k[:40], k[-40:]])]
    leaked = {d for d, _ in brute_force(suspects, items)}
    rows = {i: cleaned(t) for i, t in rows.items() if i not in leaked}
    result = corpus_pipeline.run(spark, sf_dir)
    assert {r.doc_id: r.decoded for r in result.collect()} == rows
    assert result.count() == len(rows)


def test_stages_keep_the_columns_of_documents(spark, sf_dir, no_docs, edge_docs):
    docs = edge_docs.select("doc_id", "text", F.lit("en").alias("lang"), "source", F.lit(1).cast("bigint").alias("n_chars"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns, name
        assert stage(spark, no_docs, sf_dir).count() == 0, name
    once = corpus_pipeline.near_dedup(spark, docs, sf_dir).collect()
    assert sorted(r.doc_id for r in once if r.doc_id is not None) == [0, 1, 2, 3, 4, 5, 6, 7, 8, 10]


def test_columns_of_any_name_pass_through_every_stage(spark, sf_dir):
    names = ["__h", "__entropy", "__id", "__maybe", "__host", "__base", "__all", "__wanted_id"]
    names += ["row", "own", "wanted", "id", "host", "bad", "base", "found", "base_spans", "all_spans", "a.b"]
    words = " ".join(f"w{i}" for i in range(60))
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").first().text
    texts = [words, words, words + " token=abcdefgh", words + " " + item, None, words]
    rows = [(i if i < 5 else None, t, "s", *[f"{n}{i}" for n in names]) for i, t in enumerate(texts)]
    rows.append(rows[2])
    schema = ", ".join(["doc_id bigint", "text string", "source string", *[f"`{n}` string" for n in names]])
    docs = spark.createDataFrame(rows, schema)
    kept = {"quality_rules": [0, 1, 2, 2, 3, None], "near_dedup": [0, 3, 4, None], "decontamination": [0, 1, 2, 2, 4, None]}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        result = stage(spark, docs, sf_dir)
        assert [c for c in result.columns if c != "n_chars"] == docs.columns, name
        found = result.collect()
        ids = kept.get(name, [0, 1, 2, 2, 3, 4, None])
        assert sorted((r.doc_id for r in found), key=str) == sorted(ids, key=str), name
        own = {tuple(r[n] for n in names) for r in found}
        assert own <= {r[3:] for r in rows}, name
