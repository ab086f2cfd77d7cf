from __future__ import annotations

import random
import re
from itertools import combinations

import numpy as np
import pytest
from keydrivers.llm.near_dedup import Similarity, estimated, minima, near_duplicates, registers

UPPER = {c: chr(c + 32) for c in range(65, 91)}


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    if not words:
        return frozenset()
    if len(words) < 5:
        return frozenset([tuple(words)])
    return frozenset(zip(*(words[i:] for i in range(5))))


def expected(rows):
    """Links of all pairs of sets that share a shingle, and the smallest id of each component."""
    sets = {}
    for i, text in rows:
        sets.setdefault(shingles(text), []).append(i)
    by_shingle = {}
    distinct = list(sets)
    for k, s in enumerate(distinct):
        for x in s:
            by_shingle.setdefault(x, []).append(k)
    up = list(range(len(distinct)))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    seen = set()
    for ks in by_shingle.values():
        for a, b in combinations(ks, 2):
            if (a, b) not in seen and find(a) != find(b):
                seen.add((a, b))
                both = len(distinct[a] & distinct[b])
                if 100 * both >= 75 * (len(distinct[a]) + len(distinct[b]) - both):
                    up[find(a)] = find(b)
    smallest = {}
    for k, s in enumerate(distinct):
        smallest[find(k)] = min(smallest.get(find(k), 1 << 60), *sets[s])
    found = {}
    for k, s in enumerate(distinct):
        for i in sets[s]:
            component = smallest[find(k)] if s else i
            found[i] = (len(s), component, i == component)
    return found


def compared(docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").distinct().collect()]
    found = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs).collect()}
    assert found == expected(rows)
    return found


def test_documents(documents):
    found = compared(documents)
    assert any(not kept for _, _, kept in found.values())


def test_sizes_chains_and_hot_groups(spark):
    random.seed(11)

    def words(n):
        return [f"w{random.randint(0, 10**6)}" for _ in range(n)]

    texts = []
    for n in (1, 2, 4, 5, 6, 8, 12, 20, 40, 80, 300, 1500):
        for _ in range(4):
            base = words(n)
            texts.append(base)
            for share in (0.0, 0.01, 0.03, 0.05, 0.08):
                edited = [w if random.random() >= share else words(1)[0] for w in base]
                texts.append(edited)
    chain = words(100)
    for _ in range(40):
        chain = chain[2:] + words(2)
        texts.append(chain)
    base = words(60)
    for _ in range(200):
        edited = list(base)
        edited[random.randrange(60)] = words(1)[0]
        texts.append(edited)
    shared = words(50)
    texts += [words(random.randint(5, 60)) + shared for _ in range(150)]
    texts += [base] * 300
    random.shuffle(texts)
    rows = [(i * 3 + 1, " ".join(t), "own") for i, t in enumerate(texts)]
    rows += [(9001, "", "x"), (9002, None, "x"), (9003, " \n", "x")]
    compared(spark.createDataFrame(rows, "doc_id bigint, text string, component_id string"))


def test_edge_cases(edge_docs, no_docs):
    found = near_duplicates(edge_docs).collect()
    assert len(found) == edge_docs.count()
    by_id = {r.doc_id: r for r in found}
    assert by_id[None].component_id is None and by_id[None].kept
    assert by_id[0].n_shingles == 0 and by_id[0].kept
    assert by_id[9].component_id == 8 and not by_id[9].kept
    assert near_duplicates(no_docs).count() == 0


@pytest.mark.parametrize("n", [10, 200, 5000])
def test_estimates_follow_the_similarity(n):
    random_numbers = np.random.default_rng(n)
    for share in (0.3, 0.75, 0.95):
        common = round(2 * n * share / (1 + share))
        errors = []
        for _ in range(20):
            pool = random_numbers.integers(0, 2**64, 2 * n - common, dtype=np.uint64)
            left, right = pool[:n], pool[n - common :]
            r, s = (registers(minima(x, 128))[None, :] for x in (left, right))
            true = common / (2 * n - common)
            errors.append(estimated(r, s, np.array([n]), np.array([n]))[0] - true)
        assert abs(np.mean(errors)) < 0.04
        assert max(map(abs, errors)) < Similarity().slack


def test_registers_hold_zeros_and_mantissa():
    values = np.array([0xFFFFFFFF, 0x80000000, 1, 0, 0x00012345], np.uint32)
    found = [(int(x) >> 11, int(x) & 0x7FF) for x in registers(values)]
    assert found == [(0, 0x7FF), (0, 0), (31, 0), (31, 0), (15, 0b00100011010)]
