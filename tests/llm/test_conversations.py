from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib

import pytest

from keydrivers.llm import conversations as module
from keydrivers.llm.conversations import damaged, repaired

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def spaced(value):
    return " " if value is None else value


def damage(rows):
    found = {}
    for conv, turn, role, text in rows:
        rest = found.setdefault(conv, [])
        kind = zlib.crc32(f"{spaced(conv)}:{spaced(turn)}".encode()) % 20
        role, text = spaced(role), spaced(text)
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        rest += [(turn, role, text)] * (2 if kind == 3 else 1)
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2])) for c, r in found.items()}


def faults_of(rows):
    seen, found = set(), []
    for _, role, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]", text)
        if not words:
            found.append("blank")
        elif (role, text) in seen:
            found.append("duplicate")
        else:
            found.append("ok" if words[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return found


def cheapest(rows, faults):
    """Uniform search over all edits by (cost, audit): whole paths, two inserts in a row included."""
    follows = {"": "su", "s": "u", "u": "a", "a": "u"}
    heap, done = [(0, "", 0, "", ())], set()
    # A path is final when its (cost, audit) is the least among all complete ones; equal prefixes are
    # told apart by the whole audit, so states are not merged.
    best = None
    while heap:
        cost, audit, at, last, out = heapq.heappop(heap)
        if best is not None and cost > best[0]:
            break
        if at == len(rows) and last in ("", "a"):
            if best is None or (cost, audit) < best[:2]:
                best = (cost, audit, out)
        if (audit, last) in done:
            continue
        done.add((audit, last))
        if not audit.endswith("II"):
            for role in ("user", "assistant"):
                if role[0] in follows[last]:
                    heapq.heappush(heap, (cost + 3, audit + "I", at, role[0], (*out, (role, ""))))
        if at < len(rows):
            _, role, text = rows[at]
            heapq.heappush(heap, (cost + 4, audit + "D", at + 1, last, out))
            if faults[at] in ("ok", "truncated"):
                more = 3 if faults[at] == "truncated" else 0
                if role[:1] and role[:1] in follows[last]:
                    heapq.heappush(heap, (cost + more, audit + "K", at + 1, role[:1], (*out, (role, text))))
                for to in ("user", "assistant"):
                    if to[0] in follows[last]:
                        heapq.heappush(heap, (cost + more + 3, audit + "R", at + 1, to[0], (*out, (to, text))))
    return best


def brute(rows):
    found = {}
    for conv, own in damage(rows).items():
        faults = faults_of(own)
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        initials = [role[:1] for _, role, _ in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        cost, audit, out = cheapest(own, faults)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
        counts = [faults.count(k) for k in ("blank", "duplicate", "truncated")]
        found[conv] = (gaps, *counts, illegal, cost, audit, digest)
    return found


def result(df):
    rows = df.collect()
    found = {r.conv_id: tuple(r[c] for c in module.COLUMNS[1:]) for r in rows}
    assert len(found) == len(rows)
    return found


def made_up(seed, n=60, longest=8):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "Why?", "and then", "", None, " \t", "Yes.", "so. ", "é.", "日本"]
    roles = ["user", "assistant", "user", "assistant", "system", "usher", "tool", "", None, "Assistant"]
    rows = []
    for conv in [None, *range(-3, n)]:
        for k in range(rng.randint(1, longest)):
            turn = rng.choice([k, k, k, k, k + 2, None, 5])
            role = roles[k % 2] if rng.random() < 0.6 else rng.choice(roles)
            text = f"Row {rng.randint(0, 99)}." if rng.random() < 0.5 else rng.choice(texts)
            rows.append((conv, turn, role, text))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_equals_full_search(spark, seed):
    rows = made_up(seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert result(repaired(damaged(df))) == brute(rows)


def test_conversations(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    assert result(repaired(damaged(table))) == brute(rows)


def test_long_conversations_are_cut(spark, monkeypatch):
    """Parts in many tasks, and stretches of few rows, give what one pass over the conversation gives."""
    rng = random.Random(9)
    rows = [
        (conv, turn, rng.choice(["user", "assistant", "system"]), rng.choice(["Go.", f"Row {turn}.", "no end", ""]))
        for conv, n in ((1, 900), (2, 3), (None, 500), (4, 1))
        for turn in range(n)
    ]
    own = damage(rows)
    expected = {}
    for conv, kept in own.items():
        faults = faults_of(kept)
        kinds = {"ok": module.SOUND, "blank": module.BLANK, "duplicate": module.DUPLICATE, "truncated": module.CUT_OFF}
        whole = module._stretch([(r[:1], kinds[f]) for (_, r, _), f in zip(kept, faults, strict=True)])
        expected[conv] = module._finished(whole)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    first = result(repaired(damaged(df)))
    assert {c: r[5:7] for c, r in first.items()} == expected
    replay = module._Replay(expected[1][1])
    for _, role, text in own[1]:
        replay.row(role, text)
    replay.inserted()
    assert first[1][7] == hashlib.sha256("\n".join(f"{r}:{t}" for r, t in replay.rows).encode()).hexdigest()
    initials = "".join(r[0] for r, _ in replay.rows)
    assert re.fullmatch("(s?(ua)+)?", initials)
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    try:
        assert result(repaired(damaged(df))) == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_stretches_join_exactly():
    rng = random.Random(4)
    for _ in range(200):
        rows = [(rng.choice("suax"), rng.choice([0, 0, 1, 2, 3])) for _ in range(rng.randint(1, 12))]
        cut = rng.randint(0, len(rows))
        parts = [module._stretch(p) for p in (rows[:cut], rows[cut:]) if p]
        assert module._finished(module._together(parts)) == module._finished(module._stretch(rows))


def test_copies_ties_empty_and_other_columns(spark):
    rows = [(1, 0, "user", "Hi."), (1, 0, "user", "Hi."), (1, 0, "user", "Hi."), (1, 0, "assistant", "Hi."), (1, 3, "user", "Hi.")]
    rows += [(None, None, None, None)] * 3 + [(7, 1, "user", "x" * 500_000 + ".")]
    wide = [(*r, "own", 5, True) for r in rows]
    df = spark.createDataFrame(wide, SCHEMA + ", audit string, cost int, gone boolean")
    assert result(repaired(damaged(df))) == brute(rows)
    assert repaired(damaged(spark.createDataFrame([], SCHEMA))).count() == 0


def test_very_long_texts_are_read_again(spark, monkeypatch):
    rows = made_up(11, 20)
    df = spark.createDataFrame(rows, SCHEMA)
    # Tasks import the module anew, so the bound is set where rows are held.
    parts = [module._Part() for _ in range(2)]
    monkeypatch.setattr(module, "HELD", 10)
    parts[0].add(1, "user", "more than ten characters.", False)
    assert parts[0].rows is None
    monkeypatch.undo()
    assert result(repaired(damaged(df))) == brute(rows)
