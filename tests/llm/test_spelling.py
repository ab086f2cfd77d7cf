from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest

from keydrivers.llm.spelling import near_words, spelling_variants, word_counts

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def counted(rows, fewest=3, shortest=5):
    counts = Counter()
    for doc_id, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            if len(run) >= shortest:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= fewest}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    p = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[p + 1 :] == b[p + 1 :] if len(a) == len(b) else a[p:] == b[p + 1 :]


def neighbours(words):
    """Words that share what is left without one letter, checked by ``one_edit``."""
    by_rest = {}
    for w in words:
        for rest in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            by_rest.setdefault(rest, []).append(w)
    near = {w: set() for w in words}
    for same in by_rest.values():
        for a in same:
            near[a].update(b for b in same if one_edit(a, b))
    return near


def brute(rows):
    counts = counted(rows)
    near = neighbours(counts)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-counts[o], o), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * counts[w] else None
    found = {}
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        found[w] = (form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None)
    return found


def result(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    expected = brute([tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert result(spelling_variants(docs)) == expected
    assert sum(v[0] is not None for v in expected.values()) > 50
    assert any(v[0] is not None and v[1] != v[0] for v in expected.values())


def random_words(seed, letters, n, longest):
    rng = random.Random(seed)
    base = ["".join(rng.choices(letters, k=rng.randint(5, longest))) for _ in range(n // 3)]
    words = set(base)
    while len(words) < n:
        w = rng.choice(base)
        k = rng.randrange(len(w) + 1)
        words.add(rng.choice([w[:k] + rng.choice(letters) + w[k:], w[:k] + w[k + 1 :], w[:k] + rng.choice(letters) + w[k + 1 :]]))
    return [w for w in words if len(w) >= 5]


@pytest.mark.parametrize(("letters", "longest", "most"), [("ab", 9, 20_000), ("ab", 12, 4), ("aÿß", 8, 2), ("abcdefghijé", 7, 7)])
def test_pairs_equal_all_pairs(spark, letters, longest, most):
    """Also with groups that are halved until one letter is open."""
    words = random_words(len(letters) * longest, letters, 400, longest)
    df = spark.createDataFrame([(w, i) for i, w in enumerate(words)], "word string, n bigint").repartition(3)
    found = [(r.word, r.near, r.near_n) for r in near_words(df, most=most).collect()]
    expected = [(a, b, words.index(b)) for a in words for b in words if one_edit(a, b)]
    assert sorted(found) == sorted(expected)


def test_hot_prefix_and_suffix(spark):
    """Thousands of words with the same beginning, or the same end."""
    rng = random.Random(2)
    words = {f"aaaaaaaa{''.join(rng.choices('abcde', k=6))}" for _ in range(2500)}
    words |= {f"{''.join(rng.choices('abcde', k=6))}zzzzzzzz" for _ in range(2500)}
    df = spark.createDataFrame([(w, 3) for w in words], "word string, n bigint")
    found = {}
    for r in near_words(df, most=300).collect():
        found.setdefault(r.word, []).append(r.near)
    near = neighbours(words)
    assert {w: sorted(x) for w, x in found.items()} == {w: sorted(x) for w, x in near.items() if x}


def test_chains_ties_and_edges(spark, edge_docs, no_docs):
    rows = [(i, t) for i, t in enumerate(["magical " * 40, "magicel " * 12, "magicels " * 5, "magicelss " * 3, "ÀÿÉÈÀ " * 3])]
    rows += [(10, "tiesa tiesb " * 8), (11, "tiesc " * 4), (12, None), (13, ""), (None, "nullid nullid nullid nullid")]
    rows += [(14, "x" * 50_000 + " " + "x" * 49_999 + "y"), (14, "x" * 50_000 + " " + "x" * 49_999 + "y")] * 3
    df = spark.createDataFrame([(*r, "own", 1) for r in rows], "doc_id bigint, text string, word string, n int")
    expected = brute(rows)
    assert result(spelling_variants(df)) == expected
    assert any(v[1] == "magical" and v[0] != "magical" for v in expected.values())
    assert spelling_variants(no_docs).count() == 0
    edge = [(r.doc_id, r.text) for r in edge_docs.collect()]
    assert result(spelling_variants(edge_docs)) == brute(edge)


def test_counts(spark):
    rows = [(i, "Éclair ÉCLAIR eclair naïve-naïve x÷y×zzzzz AbCdEf") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.word: r.n for r in word_counts(df).collect()} == counted(rows)
