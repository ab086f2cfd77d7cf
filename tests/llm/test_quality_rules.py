from __future__ import annotations

import re
from collections import Counter, defaultdict

from keydrivers.llm.quality_rules import Rules, document_counts, host_verdicts, judged

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def expected(text):
    text = text or ""
    words = WORDS.findall(text)
    windows = Counter(zip(words, words[1:], words[2:]))
    inside = set()
    for i in range(len(words) - 2):
        if windows[tuple(words[i : i + 3])] > 1:
            inside |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    return (
        len(words),
        sum(map(len, words)),
        len(re.findall(r"[#*$%&|<>]", text)),
        len(lines) - len(set(lines)),
        len(inside),
        len(words) < 50 or 100 * len(inside) > 50 * len(words),
    )


COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def compared(docs):
    found = sorted(map(repr, document_counts(docs).select("doc_id", *COLUMNS).collect()))
    rows = docs.select("doc_id", "text").collect()
    from pyspark.sql import Row

    make = Row("doc_id", *COLUMNS)
    assert found == sorted(repr(make(r.doc_id, *expected(r.text))) for r in rows)


def test_counts_of_documents(documents):
    compared(documents)


def test_counts_of_edge_cases(edge_docs):
    compared(edge_docs)


def test_host_verdicts_follow_the_beta_prior(spark):
    good, bad = "a b c d e f g h i j " + " ".join(f"w{i}" for i in range(60)), "short"
    rows = []
    for host, n_good, n_bad in (("fine", 90, 10), ("awful", 5, 95), ("tiny", 0, 1), ("mid", 30, 20)):
        rows += [(host, good)] * n_good + [(host, bad)] * n_bad
    rows += [(None, good), (None, bad)]
    docs = spark.createDataFrame([(i, t, h) for i, (h, t) in enumerate(rows)], "doc_id bigint, text string, source string")
    counts = document_counts(docs)
    verdicts = {r.host: r for r in host_verdicts(counts).collect()}
    rates = defaultdict(list)
    for h, t in rows:
        if h:
            rates[h].append(t == bad)
    means = {h: sum(x) / len(x) for h, x in rates.items()}
    m = sum(means.values()) / len(means)
    v = sum((x - m) ** 2 for x in means.values()) / len(means)
    weight = m * (1 - m) / v - 1
    weight = weight if weight > 0 else Rules().weak_prior
    for h, x in rates.items():
        rate = (sum(x) + m * weight) / (len(x) + weight)
        assert abs(verdicts[h].rate - rate) < 1e-12
        assert verdicts[h].rejected == (rate > 0.5)
    kept = judged(docs).collect()
    assert {r.kept for r in kept if r.host == "awful"} == {False}
    assert sum(r.kept for r in kept) == 90 + 30 + 1
    assert len(kept) == len(rows)


def test_no_rows(no_docs):
    assert judged(no_docs).count() == 0
