from __future__ import annotations

import random

import numpy as np
import pytest
from keydrivers.llm import decontaminate
from keydrivers.llm.decontaminate import Alignment, Items, leaks, smith_waterman, without_leaks
from keydrivers.llm.shingles import Words, bare, windows


def plain_alignment(item, words, how):
    best = 0
    last = [0] * (len(words) + 1)
    for x in item:
        row = [0]
        for j, y in enumerate(words, 1):
            step = how.match if x == y else how.mismatch
            row.append(max(0, last[j - 1] + step, last[j] + how.gap, row[-1] + how.gap))
        best, last = max(best, *row), row
    return best / (how.match * len(item))


def test_alignment_is_smith_waterman():
    random.seed(2)
    how = Alignment()
    for _ in range(60):
        item = [random.randint(0, 6) for _ in range(random.randint(1, 15))]
        words = [random.randint(0, 6) for _ in range(random.randint(0, 30))]
        found = smith_waterman(np.array(item, np.uint64), np.array(words, np.uint64), how)
        assert abs(found - plain_alignment(item, words, how)) < 1e-12


def normal(text):
    marks = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»„“”‘’…–—"
    import re

    return [w.lower().strip(marks) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]


def brute_force(docs, items, how=Alignment()):
    found = set()
    for i, text in docs:
        words = normal(text)
        for k, item in items:
            wanted = normal(item)
            if len(wanted) >= how.min_words and set(wanted) & set(words):
                if plain_alignment(wanted, words, how) >= how.min_score:
                    found.add((i, k))
            elif wanted and len(wanted) < how.min_words:
                n = len(wanted)
                if any(words[a : a + n] == wanted for a in range(len(words) - n + 1)):
                    found.add((i, k))
    return found


def test_against_brute_force_on_copies_edits_and_clean_text(spark):
    random.seed(4)

    def words(n):
        return [f"w{random.randint(0, 400)}" for _ in range(n)]

    items = [(k, " ".join(words(random.randint(10, 40)))) for k in range(12)]
    items += [(90, "too short here"), (91, None), (92, "")]
    docs = []
    for i in range(120):
        text = words(random.randint(0, 150))
        if i % 2:
            copy = normal(random.choice(items[:12])[1])
            kind = i % 10
            if kind == 3:
                copy = [w if random.random() > 0.15 else words(1)[0] for w in copy]
            elif kind == 5:
                copy = [w for w in copy if random.random() > 0.1]
            elif kind == 7:
                copy = copy[: len(copy) // 3]
            elif kind == 9:
                copy = [f"({w.upper()}!" for w in copy]
            text = text[:20] + copy + text[20:]
        docs.append((i, " ".join(text)))
    docs += [(500, None), (501, ""), (None, items[0][1]), (1, docs[1][1])]
    frame = spark.createDataFrame([(*d, 1.0) for d in docs], "doc_id bigint, text string, score double")
    tests = spark.createDataFrame(items, "item_id bigint, text string")
    found = {(r.doc_id, r.item_id) for r in leaks(frame, tests).collect()}
    true = brute_force(docs, items)
    assert found == true
    gone = {d for d, _ in found}
    kept = [r.doc_id for r in without_leaks(frame, tests).collect()]
    assert sorted(kept, key=repr) == sorted((d for d, _ in docs if d not in gone), key=repr)


def test_planted_items_of_the_tables(documents, spark, sf_dir):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = {(r.doc_id, r.item_id) for r in leaks(documents, items).collect()}
    texts = [(r.doc_id, r.text) for r in documents.collect()]
    exact = {(d, r.item_id) for r in items.collect() for d, t in texts if r.text in t}
    assert exact and exact <= found


def test_blocks_of_items_and_no_rows(spark, monkeypatch, no_docs):
    items = spark.createDataFrame(
        [(k, " ".join(f"k{k}w{j}" for j in range(12))) for k in range(6)], "item_id bigint, text string"
    )
    docs = items.select((items.item_id * 10).alias("doc_id"), "text")
    whole = sorted(map(tuple, leaks(docs, items).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 130)
    assert sorted(map(tuple, leaks(docs, items).collect())) == whole
    assert [w[:2] for w in whole] == [(k * 10, k) for k in range(6)]
    assert leaks(no_docs, items).count() == 0
    assert leaks(docs, items.where("false")).count() == 0


@pytest.mark.parametrize("copies", [30, 333])
@pytest.mark.parametrize("kind", ["edited", "half"])
def test_one_copy_in_many_documents(spark, kind, copies):
    item = [f"i{j}" for j in range(25)]
    copy = [f"new{j}" if j % 5 == 4 else w for j, w in enumerate(item)]
    copy = copy if kind == "edited" else item[:13]
    assert plain_alignment(item, copy, Alignment()) >= Alignment().min_score
    rows = []
    for i in range(1000):
        own = [f"d{i}w{j}" for j in range(30)]
        rows.append((i, " ".join(own[:15] + (copy if i < copies else []) + own[15:])))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    tests = spark.createDataFrame([(1, " ".join(item))], "item_id bigint, text string")
    found = sorted((r.doc_id, r.item_id) for r in leaks(docs, tests).collect())
    assert found == [(i, 1) for i in range(copies)]


def test_bounds_leave_no_leak_out():
    random.seed(6)
    how = Alignment()
    for _ in range(400):
        item = [random.randint(0, 9) for _ in range(random.randint(8, 20))]
        words = []
        for w in item:
            words += [w] if random.random() > 0.25 else [random.randint(0, 9)] * random.randint(0, 2)
        words = [10 + j for j in range(5)] + words + [20 + j for j in range(5)]
        text = " ".join(f"w{w}" for w in words)
        known = Items([(1, " ".join(f"w{w}" for w in item).encode())], how)
        hashes = Words(bare).hashes(text.encode())
        if plain_alignment(item, words, how) >= how.min_score:
            assert [k for k, _ in known.places(windows(hashes, how.seed), how.seed)] == [0]
            assert how.possible(known.words[0], hashes)


def test_short_items_leak_as_a_whole(spark):
    items = spark.createDataFrame(
        [(1, "Seven words make up this test item."), (2, "two words"), (3, "Solo"), (4, None), (5, ""), (6, "two words")],
        "item_id bigint, text string",
    )
    texts = ["x seven words MAKE up this test item, y", "seven words make up this item", "words two words", "solo. words", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = sorted((r.doc_id, r.item_id, r.score) for r in leaks(docs, items).collect())
    assert found == [(0, 1, 1.0), (2, 2, 1.0), (2, 6, 1.0), (3, 3, 1.0)]


def test_rows_without_an_id_lose_their_leaks(spark):
    item = "the quick brown fox jumps over the lazy dog near the old river bank today"
    items = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    rows = [(None, f"before {item} after", "a"), (None, "clean text of a row", "b"), (None, None, "c"), (7, item, "d"), (8, "clean", "e")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, id string")
    assert sorted(r.id for r in without_leaks(docs, items).collect()) == ["b", "c", "e"]
