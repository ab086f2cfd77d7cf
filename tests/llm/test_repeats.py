from __future__ import annotations

import hashlib
import os
import random
import tempfile

import numpy as np
import pytest

from keydrivers.llm import repeats as repeats_module
from keydrivers.llm import suffix_sort
from keydrivers.llm.repeats import digests, without_repeats
from keydrivers.llm.suffix_sort import GAP, LEAD, Bytes, Scratch, sorted_suffixes


def brute(rows, length=100):
    """The contract, string by string, for rows with unique ids."""
    seen, found = set(), {}
    for doc_id, text in sorted(rows):
        raw = (text or "").encode()
        mask = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            string = raw[i : i + length]
            if string in seen:
                mask[i : i + length] = b"\x01" * length
            seen.add(string)
        kept = bytes(b for b, m in zip(raw, mask, strict=True) if not m)
        spans = sum(m and not p for m, p in zip(mask, b"\x00" + mask, strict=False))
        found[doc_id] = (len(raw), sum(mask), spans, hashlib.sha256(kept).hexdigest())
    return found


def result(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in digests(df).collect()}


def words(rng, n):
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(n))


def made_up(seed=3):
    rng = random.Random(seed)
    passages = [words(rng, n) for n in (18, 30, 60, 200)]
    rows = []
    for i in range(120):
        parts = [words(rng, rng.randint(0, 40)) for _ in range(3)]
        parts.insert(rng.randint(0, 3), rng.choice(passages))
        rows.append((i * 3 - 50, "\n".join(parts)))
    rows += [(1000, rows[7][1]), (1001, rows[7][1][5:-9]), (1002, "x" * 1500), (1003, "x" * 99), (1004, "ab" * 700)]
    rows += [(1005, ""), (1006, None), (1007, "x" * 100), (1008, "\x00" * 250 + "x" * 130), (1009, words(rng, 9) * 40)]
    return rows


def test_equals_all_strings(spark):
    rows = made_up()
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    assert result(without_repeats(df)) == brute(rows)


def test_hot_minima_and_small_pieces(spark, monkeypatch):
    rows = made_up(4)
    monkeypatch.setattr(repeats_module, "SHARD_BYTES", 20_000)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)
    assert result(without_repeats(df, hot=3)) == brute(rows)


def test_queues_on_disk(spark):
    rows = made_up(5)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert result(without_repeats(df, limit=500)) == brute(rows)


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    assert len({r[0] for r in rows}) == len(rows)
    assert result(without_repeats(docs)) == brute(rows)


def test_other_length(spark):
    rows = made_up(6)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert result(without_repeats(df, length=40)) == brute(rows, 40)


def test_edge_rows(spark, edge_docs, no_docs):
    """Nulls, repeated rows, ids that several texts share, and columns with names of the result."""
    found = digests(without_repeats(edge_docs)).collect()
    assert len(found) == edge_docs.count()
    first = [r for r in found if r.doc_id == 8][0]
    again = [r for r in found if r.doc_id == 9][0]
    assert first.n_removed < first.n_bytes and again.n_removed == again.n_bytes
    assert [r.n_removed for r in found if r.doc_id is None] == [0]
    assert without_repeats(no_docs).count() == 0
    long = "".join(random.Random(1).choices("abcdefgh", k=303))
    rows = [(1, long), (1, long), (1, long + "!" * 3), (None, long), (None, long), (0, "short"), (0, "short")]
    kept = sorted(
        (r.doc_id is None, r.n_bytes, r.n_removed)
        for r in digests(without_repeats(spark.createDataFrame(rows, "doc_id bigint, text string"))).collect()
    )
    assert [k for k in kept if k[1] == 5] == [(False, 5, 0)] * 2
    assert [k for k in kept if k[0]] == [(True, 303, 303)] * 2
    ones = [k for k in kept if not k[0] and k[1] > 5]
    # Which of the two texts of id 1 comes first is a matter of their hash; equal rows are removed.
    assert sorted(ones)[1:] in (
        [(False, 303, 303), (False, 306, 303)],
        [(False, 303, 303), (False, 306, 0)],
    )


def test_spans_and_bytes_agree(spark):
    rows = made_up(8)
    texts = dict(rows)
    for r in without_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect():
        raw = (texts[r.doc_id] or "").encode()
        mask = bytearray(len(raw))
        for span in r.spans:
            mask[span.start : span.stop] = b"\x01" * (span.stop - span.start)
        assert bytes(b for b, m in zip(raw, mask, strict=True) if not m) == bytes(r.kept)


def sorted_pieces(pieces, limit, block, cap, folder):
    scratch = Scratch(folder, limit)
    text = Bytes(scratch, block)
    for piece in pieces:
        text.add(piece)
    text.close()
    places, common = [], []
    for p, c in sorted_suffixes(text, scratch, cap):
        places += p.tolist()
        common += c.tolist()
    written = scratch.n_files
    scratch.close()
    return places, common, written


@pytest.mark.parametrize("trial", range(24))
def test_suffix_order_and_common_prefixes(trial, monkeypatch):
    rng = random.Random(trial)
    letters = rng.choice([b"ab", b"abc", b"abcdefgh", bytes(range(248))])
    pieces = [bytes(rng.choices(letters, k=rng.choice([0, 1, 5, 40, 200]))) for _ in range(rng.randint(1, 12))]
    pieces += [b"x" * 300, b"ab" * 150, b"x" * 301][: trial % 4]
    if trial % 2:
        pieces += pieces
    whole = b"".join([bytes([GAP]) * LEAD, *(p + bytes([GAP]) for p in pieces)])
    expected = sorted(range(LEAD, len(whole)), key=lambda i: whole[i:], reverse=True)
    for limit, block in ((1 << 20, 1 << 22), (5, 64), (40, 256)):
        if limit < 100:
            monkeypatch.setattr(suffix_sort, "BATCH", rng.choice([3, 17, 1000]))
            monkeypatch.setattr(suffix_sort.Blocks, "BLOCK", rng.choice([7, 64]))
        cap = rng.choice([5, 100])
        with tempfile.TemporaryDirectory() as folder:
            places, common, written = sorted_pieces(pieces, limit, block, cap, folder)
            assert not os.listdir(folder)
        assert places == expected
        assert (written > 0) == (limit < 100) or len(whole) < 60
        for i in range(1, len(places)):
            a, b = whole[places[i - 1] :], whole[places[i] :]
            n = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
            assert common[i] == min(n, cap) or GAP in a[: min(n, cap)]
        monkeypatch.undo()


def test_long_ascending_runs(tmp_path):
    """Sorted pieces, whose names ascend over thousands of places."""
    pieces = [b"b" + b"%06d" % i + b"a" * 30 for i in range(3_000)]
    places, _, _ = sorted_pieces(pieces, 1 << 20, 1 << 22, 100, str(tmp_path))
    whole = b"".join([bytes([GAP]) * LEAD, *(p + bytes([GAP]) for p in pieces)])
    assert places == sorted(range(LEAD, len(whole)), key=lambda i: whole[i:], reverse=True)


def test_shard_larger_than_memory(tmp_path):
    """A text of 3 MB with queues of 20,000 rows: the same order as in memory."""
    rng = np.random.default_rng(1)
    base = rng.integers(97, 105, 40_000, dtype=np.uint8).tobytes()
    pieces = [base[i : i + 140] for i in rng.integers(0, 39_000, 4_000)]
    places, common, written = sorted_pieces(pieces, 20_000, 1 << 16, 100, str(tmp_path))
    in_memory = sorted_pieces(pieces, 1 << 22, 1 << 24, 100, str(tmp_path))
    assert written > 50 and in_memory[2] == 0
    assert (places, common) == in_memory[:2]
