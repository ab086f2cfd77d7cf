"""Repair of the structure of conversations at the least cost, with the edits as an audit.

A repair is a path through a graph without cycles: its nodes are (rows done, role before), its edges keep,
rerole or delete the next row, with or without an inserted row before it. The weight of a path is
one integer. Its high digits are the cost; below stand the letters of the edits, one digit of fixed width for
each place, filled up with zeros at the end. So the smaller of two integers is the cheaper path and, at
the same cost, the one whose letters come first; nothing else decides. Integers of paths that follow
each other are joined by shifting, so a conversation is cut into stretches, and stretches of
a long one are worked on by different tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import on_executors, picked, stored

WIDTH = 3
LETTERS = "\0DIKR"  # by ASCII; a digit is the place in this text
DELETE, INSERT, KEEP, REROLE = 1, 2, 3, 4
COSTS = {DELETE: 4, INSERT: 3, KEEP: 0, REROLE: 3}
TRUNCATED = 3  # on top, for a truncated row that stays
ROLES = {"u": "user", "a": "assistant"}
BEGIN, SYSTEM, USER, ASSISTANT = range(4)  # what the row before is
STRETCH = 64  # rows whose path integers are made at once
HELD = 8 << 20  # characters of one conversation that a task keeps
SOUND, BLANK, DUPLICATE, CUT_OFF = range(4)
# The state that an initial leads to, where it may follow.
AFTER = {
    ("s", BEGIN): SYSTEM,
    ("u", BEGIN): USER,
    ("u", SYSTEM): USER,
    ("u", ASSISTANT): USER,
    ("a", USER): ASSISTANT,
}

Path = tuple[int, int]  # the integer, and for how many letters it has digits
Paths = list[list[Path | None]]  # by the state before and after


def _joined(first: Path | None, second: Path | None) -> Path | None:
    """The path that goes one way and then the other."""
    if first is None or second is None:
        return None
    (a, n), (b, m) = first, second
    mask = (1 << WIDTH * n) - 1
    letters = a & mask
    unused = ((letters & -letters).bit_length() - 1) // WIDTH if letters else n
    cost = (a >> WIDTH * n) + (b >> WIDTH * m)
    tail = (b & ((1 << WIDTH * m) - 1)) << WIDTH * unused
    return (cost << WIDTH * (n + m)) | (letters << WIDTH * m) | tail, n + m


def _least(paths: list[Path | None]) -> Path | None:
    return min((p for p in paths if p is not None), default=None)


def _then(first: Paths, second: Paths) -> Paths:
    return [
        [_least([_joined(first[s][m], second[m][t]) for m in range(4)]) for t in range(4)] for s in range(4)
    ]


def _inserts(state: int) -> list[tuple[list[int], int]]:
    """Inserted rows before a row: none or one. Two lead back to the same role, and after a system row
    its deletion is cheaper."""
    found = [([], state)]
    for initial in "ua":
        if (initial, state) in AFTER:
            found.append(([INSERT], AFTER[initial, state]))
    return found


def _steps(initial: str, fault: int) -> list[list[tuple[int, list[int], int]]]:
    """Edges of one row by the state before: (cost, letters, state after)."""
    found: list[list] = [[] for _ in range(4)]
    for state in range(4):
        for before, at in _inserts(state):
            edits = [(DELETE, 0, at)]
            if fault in (SOUND, CUT_OFF):
                extra = TRUNCATED if fault == CUT_OFF else 0
                edits += [(KEEP, extra, AFTER.get((initial, at)))]
                edits += [(REROLE, extra, AFTER.get((to, at))) for to in ROLES]
            for edit, extra, after in edits:
                if after is not None:
                    letters = [*before, edit]
                    found[state].append((sum(COSTS[x] for x in letters) + extra, letters, after))
    return found


_EDGES: dict[tuple[str, int], list] = {}


def _edges(initial: str, fault: int) -> list:
    key = (initial if initial in ("s", "u", "a") else "", fault)
    if key not in _EDGES:
        _EDGES[key] = _steps(*key)
    return _EDGES[key]


def _stretch(rows: list[tuple[str, int]]) -> Paths:
    """The least integers of a run of (initial, fault), by the state before and after it.

    From the last row to the first: an edge adds its cost above, and its letters before those that follow.
    All paths have as many kept, changed and deleted rows and end with one, so none's letters begin another's.
    """
    digits = 2 * len(rows)
    top, mask = WIDTH * digits, (1 << WIDTH * digits) - 1
    table: list[list[list[int | None]]] = [[None] * 4 for _ in range(4)]
    for end in range(4):
        table[end][end] = 0
    for row in reversed(rows):
        edges, new = _edges(*row), [[None] * 4 for _ in range(4)]
        for state in range(4):
            for cost, letters, after in edges[state]:
                head = cost << top
                for k, letter in enumerate(letters):
                    head |= letter << top - WIDTH * (k + 1)
                shift = WIDTH * len(letters)
                for end in range(4):
                    rest = table[after][end]
                    if rest is not None:
                        value = head + ((rest >> top) << top) + ((rest & mask) >> shift)
                        if new[state][end] is None or value < new[state][end]:
                            new[state][end] = value
        table = new
    return [[None if v is None else (v, digits) for v in ends] for ends in table]


def _together(parts: list[Paths]) -> Paths:
    while len(parts) > 1:
        paired = [_then(a, b) for a, b in zip(parts[::2], parts[1::2], strict=False)]
        parts = paired + parts[len(paired) * 2 :]
    return parts[0]


def _finished(paths: Paths) -> tuple[int, str]:
    """Cost and letters of the best path from the beginning; a last user row, or a system row, needs more rows."""
    ends = {BEGIN: 0, ASSISTANT: 0, USER: 1, SYSTEM: 2}
    full = []
    for state, more in ends.items():
        closing = COSTS[INSERT] * more << WIDTH * 2
        for k in range(more):
            closing |= INSERT << WIDTH * (1 - k)
        full.append(_joined(paths[BEGIN][state], (closing, 2)))
    value, digits = _least(full)
    letters = []
    for k in range(digits - 1, -1, -1):
        digit = value >> WIDTH * k & 7
        if digit:
            letters.append(LETTERS[digit])
    return value >> WIDTH * digits, "".join(letters)


def _fault(text: str, again: bool) -> int:
    last = text.rstrip(" \t\n\v\f\r")[-1:]
    if not last:
        return BLANK
    if again:
        return DUPLICATE
    return SOUND if last in ".!?" else CUT_OFF


@dataclass
class _Replay:
    """The repaired rows of a conversation as they pass, by the letters of its audit."""

    audit: str
    at: int = 0
    state: int = BEGIN
    rows: list[tuple[str, str]] = field(default_factory=list)

    def _next_role(self) -> str:
        initial = "a" if self.state == USER else "u"
        self.state = AFTER[initial, self.state]
        return ROLES[initial]

    def inserted(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            self.rows.append((self._next_role(), ""))

    def row(self, role: str, text: str) -> None:
        self.inserted()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "K":
            self.state = AFTER[role[:1], self.state]
            self.rows.append((role, text))
        elif letter == "R":
            self.rows.append((self._next_role(), text))


@dataclass
class _Digest:
    """The SHA-256 of repaired rows, one after the other."""

    value: object = field(default_factory=hashlib.sha256)
    empty: bool = True

    def add(self, rows: list[tuple[str, str]]) -> None:
        for role, text in rows:
            self.value.update(f"{'' if self.empty else '\n'}{role}:{text}".encode())
            self.empty = False
        rows.clear()


@dataclass
class _Part:
    """Rows of one conversation that follow each other in one task."""

    first_turn: int | None = None
    last_turn: int | None = None
    distinct: int = 0
    faults: list[int] = field(default_factory=lambda: [0, 0, 0, 0])
    illegal: int = 0
    first_initial: str | None = None
    last_initial: str | None = None
    paths: list[Paths] = field(default_factory=list)
    pending: list[tuple[str, int]] = field(default_factory=list)
    rows: list[tuple[str, str]] | None = field(default_factory=list)
    size: int = 0
    before: tuple | None = None

    def add(self, turn: int | None, role: str, text: str, early: bool) -> None:
        again = early or (turn, role, text) == self.before
        self.before = (turn, role, text)
        fault = _fault(text, again)
        self.faults[fault] += 1
        initial = role[:1]
        if self.first_initial is None:
            self.first_initial = initial
        elif self.last_initial + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.last_initial = initial
        if turn is not None:
            self.distinct += turn != self.last_turn
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
        self.pending.append((initial, fault))
        if len(self.pending) == STRETCH:
            self._pack()
        if self.rows is not None:
            self.size += len(role) + len(text)
            self.rows.append((role, text))
            if self.size > HELD:
                self.rows = None  # too long to keep: its texts are read again

    def _pack(self) -> None:
        if self.pending:
            self.paths.append(_stretch(self.pending))
            self.pending = []
        # Like the digits of a counter, so that integers of equal length are joined.
        while len(self.paths) > 1 and self.paths[-1][0][0][1] >= self.paths[-2][0][0][1]:
            last = self.paths.pop()
            self.paths[-1] = _then(self.paths[-1], last)

    def path(self) -> Paths | None:
        self._pack()
        return _together(self.paths) if self.paths else None

    @property
    def gaps(self) -> int:
        return 0 if self.last_turn is None else self.last_turn - self.first_turn + 1 - self.distinct


_SUMMARY = pa.schema(
    [("conv_id", pa.int64()), ("part", pa.int64()), ("whole", pa.bool_())]
    + [(c, pa.int64()) for c in ("first_turn", "last_turn", "distinct", "blank", "duplicate", "truncated", "illegal")]
    + [(c, pa.string()) for c in ("first_initial", "last_initial")]
    + [("paths", pa.list_(pa.binary())), ("digits", pa.int64())]
    + [("gaps", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())]
)
SUMMARY = (
    "conv_id bigint, part bigint, whole boolean, first_turn bigint, last_turn bigint, distinct bigint, "
    "blank bigint, duplicate bigint, truncated bigint, illegal bigint, first_initial string, last_initial string, "
    "paths array<binary>, digits bigint, gaps bigint, cost bigint, audit string, repaired_sha256 string"
)


def _packed(paths: Paths) -> list[bytes | None]:
    return [None if p is None else p[0].to_bytes((p[0].bit_length() + 7) // 8 or 1) for s in paths for p in s]


def _unpacked(values: list[bytes | None], digits: int) -> Paths:
    flat = [None if v is None else (int.from_bytes(v), digits) for v in values]
    return [flat[4 * s : 4 * s + 4] for s in range(4)]


def _summary(conv_id: int | None, number: int, part: _Part, whole: bool) -> dict:
    path = part.path()
    row = {
        "conv_id": conv_id,
        "part": number,
        "whole": whole and part.rows is not None,
        "first_turn": part.first_turn,
        "last_turn": part.last_turn,
        "distinct": part.distinct,
        "blank": part.faults[BLANK],
        "duplicate": part.faults[DUPLICATE],
        "truncated": part.faults[CUT_OFF],
        "illegal": part.illegal,
        "first_initial": part.first_initial,
        "last_initial": part.last_initial,
        "gaps": part.gaps,
    }
    if row["whole"]:
        cost, audit = _finished(path) if path else (0, "")
        replay, digest = _Replay(audit), _Digest()
        for role, text in part.rows:
            replay.row(role, text)
        replay.inserted()
        digest.add(replay.rows)
        return row | {"cost": cost, "audit": audit, "repaired_sha256": digest.value.hexdigest()}
    return row | {"paths": _packed(path) if path else None, "digits": path[0][0][1] if path else None}


def _examined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A summary of each conversation; of the first and last one of a task, which others may continue,
    the integers of its paths."""
    from pyspark import TaskContext

    number, part, last, first = TaskContext.get().partitionId(), None, None, True
    found: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            key = (row["conv_id"] is None, row["conv_id"])
            if part is None or key != last:
                if part is not None:
                    found.append(_summary(last[1], number, part, whole=not first))
                    first = False
                part, last = _Part(), key
            if not row["gone"]:
                part.add(row["turn"], row["role"], row["text"], row["early"])
            if len(found) >= 1000:
                yield pa.RecordBatch.from_pylist(found, _SUMMARY)
                found = []
    if part is not None:
        found.append(_summary(last[1], number, part, whole=False))
    if found:
        yield pa.RecordBatch.from_pylist(found, _SUMMARY)


_VERDICT = pa.schema([_SUMMARY.field(c) for c in ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")])
VERDICT = (
    "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, "
    "cost bigint, audit string"
)


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of a conversation, which come in order, put together."""
    open_, last = None, None

    def closed() -> dict:
        path = _together(open_["paths"]) if open_["paths"] else None
        cost, audit = _finished(path) if path else (0, "")
        first, end = open_["first_turn"], open_["last_turn"]
        gaps = 0 if first is None else end - first + 1 - open_["distinct"]
        return {k: open_[k] for k in ("blank", "duplicate", "truncated", "illegal")} | {
            "conv_id": last[1], "gaps": gaps, "cost": cost, "audit": audit,
        }

    for batch in batches:
        for row in batch.to_pylist():
            key = (row["conv_id"] is None, row["conv_id"])
            if open_ is not None and key != last:
                yield pa.RecordBatch.from_pylist([closed()], _VERDICT)
                open_ = None
            if open_ is None:
                last = key
                open_ = {"paths": [], "first_turn": None, "last_turn": None, "distinct": 0, "before": None}
                open_ |= {k: 0 for k in ("blank", "duplicate", "truncated", "illegal")}
            for k in ("blank", "duplicate", "truncated", "illegal"):
                open_[k] += row[k]
            if row["digits"] is None:
                continue  # no rows after damage
            if open_["before"] is not None:
                open_["illegal"] += open_["before"] + row["first_initial"] not in ("su", "ua", "au")
            open_["before"] = row["last_initial"]
            open_["paths"].append(_unpacked(row["paths"], row["digits"]))
            if row["last_turn"] is not None:
                open_["distinct"] += row["distinct"] - (row["first_turn"] == open_["last_turn"])
                if open_["first_turn"] is None:
                    open_["first_turn"] = row["first_turn"]
                open_["last_turn"] = row["last_turn"]
    if open_ is not None:
        yield pa.RecordBatch.from_pylist([closed()], _VERDICT)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of conversations whose rows follow their audit, in order."""
    replay, digest, last = None, None, None

    def closed() -> pa.RecordBatch:
        replay.inserted()
        digest.add(replay.rows)
        row = {"conv_id": last, "repaired_sha256": digest.value.hexdigest()}
        return pa.RecordBatch.from_pylist([row], pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())]))

    for batch in batches:
        for row in batch.to_pylist():
            if row["audit"] is not None:
                if replay is not None:
                    yield closed()
                replay, digest, last = _Replay(row["audit"]), _Digest(), row["conv_id"]
            else:
                replay.row(row["role"], row["text"])
                digest.add(replay.rows)
    if replay is not None:
        yield closed()


def _initial(column: Column) -> Column:
    return F.coalesce(column, F.lit(" "))


def damaged(
    conversations: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """Rows with planted faults: conv_id, turn, role, text, gone.

    With k = CRC-32 of ``conv_id:turn`` modulo 20: 0 drops a row (``gone``), 1 empties its text, 2 takes out
    ``.``, ``!`` and ``?``, 3 doubles it, 4 makes its role ``user``. A null in any column counts as a space there;
    conv_id and turn stay null.
    """
    rows = picked(conversations, conv_id=conv_col, turn=turn_col, role=role_col, text=text_col)
    key = [_initial(F.col(c).cast("string")) for c in ("conv_id", "turn")]
    kind = F.crc32(F.concat(key[0], F.lit(":"), key[1]).cast("binary")) % 20
    rows = rows.select(
        F.col("conv_id").cast("bigint"),
        F.col("turn").cast("bigint"),
        _initial(F.col("role")).alias("role"),
        _initial(F.col("text")).alias("text"),
        kind.alias("kind"),
    )
    text = F.when(F.col("kind") <= 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select(
        "conv_id",
        "turn",
        F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        text.alias("text"),
        (F.col("kind") == 0).alias("gone"),
        F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("copy"),
    ).drop("copy")


def _with_earlier(rows: DataFrame) -> DataFrame:
    """``early``: whether a row of an earlier turn has the same role and text.

    Rows that come once, nearly all, are not listed; equal rows of one turn follow each other when sorted.
    """
    said = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    rows = rows.withColumn("said", said)
    kept = rows.where(~F.col("gone"))
    first = F.min(F.struct(F.col("turn").isNotNull().alias("later"), "turn")).alias("first")
    groups = kept.groupBy("conv_id", "said").agg(first, F.count("*").alias("rows"))
    several = groups.where("rows > 1").select(F.col("conv_id").alias("conv"), F.col("said").alias("same"), "first")
    several = stored(several, "said-again")
    match = F.col("conv_id").eqNullSafe(F.col("conv")) & (F.col("said") == F.col("same"))
    joined = rows.join(several, match, "left")
    own = F.struct(F.col("turn").isNotNull().alias("later"), "turn")
    early = F.coalesce(F.col("first").isNotNull() & ~F.col("first").eqNullSafe(own), F.lit(False))
    return joined.select("conv_id", "turn", "role", "text", "gone", early.alias("early"))


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def repaired(rows: DataFrame) -> DataFrame:
    """One row for each conversation of ``damaged``: its faults, the cost of the cheapest repair, its
    edits (``audit``: Delete, Insert, Keep, Rerole) and the SHA-256 of the repaired rows.

    Rows are taken by turn (nulls first), then role and text. The first fault of a row counts: blank, duplicate
    (a row before has its role and text), truncated (its last character that is no space is not ``.``, ``!``
    or ``?``). Kept roles count by their first letter. A conversation whose rows are all gone has zeros, an
    empty audit and the digest of an empty text. No rows give no rows; a null conv_id is one conversation.
    """
    on_executors(rows.sparkSession)
    rows = _with_earlier(rows)
    # A long conversation is cut between tasks by its rows; a prefix of the text has the order of the text.
    prefix = F.substring("text", 1, 64)
    dealt = rows.repartitionByRange("conv_id", F.col("turn").asc_nulls_first(), "role", prefix)
    sort = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    summaries = dealt.sortWithinPartitions(*sort).mapInArrow(_examined, SUMMARY)
    summaries = stored(summaries, "conversation-parts")
    whole = summaries.where("whole").select(COLUMNS)

    # The others are the first and last of a task, and very long ones.
    parts = summaries.where("not whole").repartition("conv_id").sortWithinPartitions("conv_id", "part")
    verdicts = stored(parts.mapInArrow(_combined, VERDICT), "conversation-verdicts")
    texts = rows.where("not gone").join(
        verdicts.select(F.col("conv_id").alias("conv")), F.col("conv_id").eqNullSafe(F.col("conv")), "left_semi"
    )
    none = F.lit(None).cast("string")
    heads = verdicts.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("turn"), none.alias("role"), none.alias("text"), "audit")
    texts = texts.select("conv_id", F.lit(1).alias("kind"), "turn", "role", "text", none.alias("audit"))
    # One digest of one text is made by one task, row by row.
    order = ["conv_id", "kind", F.col("turn").asc_nulls_first(), "role", "text"]
    lines = heads.unionAll(texts).repartition("conv_id").sortWithinPartitions(*order)
    digests = lines.mapInArrow(_hashed, "conv_id bigint, repaired_sha256 string")
    digests = digests.withColumnRenamed("conv_id", "conv")
    rest = verdicts.join(digests, F.col("conv_id").eqNullSafe(F.col("conv"))).select(COLUMNS)
    return whole.unionAll(rest)
