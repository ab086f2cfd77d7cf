"""Passages that repeat anywhere in a corpus, found by suffix arrays, and texts without the repeats.

A string of ``length`` bytes has one minimum among the hash values of its short windows; equal strings have
equal minima. So strings are dealt to shards by their minimum: a run of strings with the same one
is a piece of text. Equal pieces are kept once, and those whose minimum comes in no other piece and but
once in theirs hold nothing to compare. Each shard sorts the suffixes of the others by external induced
sorting (``suffix_sort``); a stretch of the order whose neighbours share ``length`` bytes is one
string, and all its places but the first repeat.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keydrivers.sources import scratch_dir

from .common import as_bytes, deleted, dropped, is_empty, letters, on_executors, picked, slices, stored
from .suffix_sort import Blocks, Buckets, Bytes, Scratch, sorted_suffixes

LENGTH = 100
SEED = 24  # bytes of the windows that are hashed
MOST_IN_PIECE = 256  # strings of one piece
SCAN = 1 << 16
SHARD_BYTES = 6 << 20
HOT = 40_000  # pieces of one minimum, about a shard, from which its strings are dealt singly
PLACE = "doc_id bigint, version bigint, start bigint, n bigint"
_PLACE = [(c, pa.int64()) for c in ("doc_id", "version", "start", "n")]
_PIECE = pa.schema([*_PLACE, ("seed", pa.int64()), ("weight", pa.int64()), ("piece", pa.binary())])
NO_ID = np.iinfo(np.int64).max


def _seeds(data: np.ndarray) -> np.ndarray:
    """A hash value of the SEED bytes from each place on: a polynomial by doubling, then mixed."""
    spans, factor = [data.astype(np.uint64)], 0x9E3779B97F4A7C15
    for span in (1, 2, 4, 8):
        spans.append(spans[-1][:-span] * np.uint64(factor) + spans[-1][span:])
        factor = factor * factor % (1 << 64)
    mixed = spans[4][: -(SEED - 16)] * np.uint64(0xD6E8FEB86659FD93) + spans[3][16:]
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return mixed ^ (mixed >> np.uint64(29))


def _extreme(values: np.ndarray, width: int, pick) -> np.ndarray:
    """The least or largest of each ``width`` neighbours."""
    span = 1
    while 2 * span <= width:
        values = pick(values[:-span], values[span:])
        span *= 2
    return pick(values[: len(values) - (width - span)], values[width - span :]) if span < width else values


def _runs(data: np.ndarray, whole: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(start, strings, minimum, whether the minimum comes more than once) of each run.

    ``whole`` says at which places a string begins that ends in the same text.
    """
    width = length - SEED + 1
    seeds = _seeds(data)
    least = np.where(whole, _extreme(seeds, width, np.minimum), np.uint64(0))
    edge = np.append(True, (least[1:] != least[:-1]) | (whole[1:] != whole[:-1]))
    starts = np.flatnonzero(edge)
    sizes = np.diff(np.append(starts, len(least)))
    # Where a minimum stands: its places, of which two in a row in one run make it repeat.
    padded = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
    at = np.flatnonzero(seeds == _extreme(padded, width, np.maximum))
    again = (seeds[at[1:]] == seeds[at[:-1]]) & (np.diff(at) <= width)
    kept = whole[starts]
    starts, sizes = starts[kept], sizes[kept]
    minima = least[starts]
    twice = np.isin(minima, np.unique(seeds[at[1:]][again]))
    parts = -(-sizes // MOST_IN_PIECE)
    which = np.repeat(np.arange(len(starts)), parts)
    offset = (np.arange(len(which)) - np.repeat(np.cumsum(parts) - parts, parts)) * MOST_IN_PIECE
    left = np.minimum(sizes[which] - offset, MOST_IN_PIECE)
    return starts[which] + offset, left, minima[which].view(np.int64), twice[which]


def _marked(length: int):
    """The runs of each text, one row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = as_bytes(batch.column("text"))
            sizes = np.array([len(t) for t in texts])
            ends = np.cumsum(sizes)
            data = np.frombuffer(b"".join(texts), np.uint8)
            for low in range(0, len(data) - length + 1, SCAN):
                part = data[low : low + SCAN + length - 1]
                places = np.arange(low, low + len(part) - length + 1)
                rows = np.searchsorted(ends, places, side="right")
                starts, n, seeds, twice = _runs(part, places + length <= ends[rows], length)
                row = rows[starts]
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(take),
                        batch.column("version").take(take),
                        pa.array(low + starts - (ends - sizes)[row]),
                        pa.array(n),
                        pa.array(seeds),
                        pa.array(twice.astype(np.int64) + 1),
                    ],
                    ["doc_id", "version", "start", "n", "seed", "weight"],
                )

    return run


def _cut(length: int):
    """Pieces of the marked runs; of equal ones in a slice of texts only the earliest has its bytes.

    The others repeat it as a whole, so that a passage with very many copies is sent few times.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = as_bytes(batch.column("text"))
            ids = pc.fill_null(batch.column("doc_id"), NO_ID).to_numpy()
            versions = batch.column("version").to_numpy()
            row, start, n, seed, weight = _listed(batch.column("runs"))
            order = np.lexsort((start, versions[row], ids[row]))
            row, start, n = row[order], start[order], n[order]
            ends = (start + n + (length - 1)).tolist()
            seen: set[bytes] = set()
            new, pieces = np.zeros(len(row), bool), []
            for k, (i, at, end) in enumerate(zip(row.tolist(), start.tolist(), ends, strict=True)):
                piece = texts[i][at:end]
                if piece not in seen:
                    seen.add(piece)
                    new[k] = True
                    pieces.append(piece)
            sent = [pa.array(c[order], mask=~new) for c in (seed, weight)]
            spread = np.where(new, np.cumsum(new) - 1, 0)
            pieces = pa.array(pieces, pa.binary()).take(pa.array(spread, mask=~new))
            take = pa.array(row)
            where = [batch.column(c).take(take) for c in ("doc_id", "version")]
            yield pa.RecordBatch.from_arrays([*where, pa.array(start), pa.array(n), *sent, pieces], schema=_PIECE)

    return run


def _listed(column: pa.Array) -> tuple[np.ndarray, ...]:
    """Row numbers and fields of a column with a list of structs in each row."""
    row = pc.list_parent_indices(column).to_numpy().astype(np.int64)
    return row, *(field.to_numpy() for field in pc.list_flatten(column).flatten())


class _Places:
    """Where the pieces of a shard come from, found by their place in its text."""

    def __init__(self, scratch: Scratch):
        self.columns = [Blocks(scratch, np.int64, 1 << 18) for _ in range(5)]
        self.rows: list[tuple] = []
        self.firsts: list[int] = []

    def add(self, row: tuple) -> None:
        self.rows.append(row)
        if len(self.rows) == self.columns[0].block:
            self.close()

    def close(self) -> None:
        if self.rows:
            self.firsts.append(self.rows[0][0])
            for column, values in zip(self.columns, zip(*self.rows, strict=True), strict=True):
                column.add(np.array(values, np.int64))
            self.rows = []

    def find(self, places: np.ndarray) -> tuple[np.ndarray, ...]:
        """doc_id, version, place in the document, and strings left in the piece from there on."""
        block = np.searchsorted(self.firsts, places, side="right") - 1
        found = np.empty((4, len(places)), np.int64)
        for k in np.unique(block):
            here = block == k
            begin, ids, versions, starts, sizes = (c.part(k) for c in self.columns)
            row = np.searchsorted(begin, places[here], side="right") - 1
            offset = places[here] - begin[row]
            found[:, here] = ids[row], versions[row], starts[row] + offset, sizes[row] - offset
        return tuple(found)


def _repeated(text: Bytes, origin: _Places, scratch: Scratch, length: int) -> Iterator[np.ndarray]:
    """Places in the shard's text whose string of ``length`` bytes comes earlier, unordered."""
    carry = np.empty(0, np.int64)  # the first place so far of the string that a batch ended with
    for places, common in sorted_suffixes(text, scratch, length):
        places = np.concatenate([carry, places])
        group = np.cumsum(np.concatenate([np.zeros(len(carry), bool), common < length]))
        many = np.bincount(group)[group] > 1
        many |= group == group[-1]
        places, group = places[many], group[many]
        ids, versions, starts, left = origin.find(places)
        order = np.lexsort((starts, versions, ids, group))
        places, group, left = places[order], group[order], left[order]
        first = np.append(True, group[1:] != group[:-1])
        carry = places[first][-1:]
        yield places[~first & (left > 0)]


def _sorted_shard(folder: str, length: int, limit: int):
    """Repeats among the pieces of one task; equal ones follow each other, the earliest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scratch = Scratch(folder, limit)
        text, origin = Bytes(scratch), _Places(scratch)
        last, alone = (None, None), None  # minimum and piece before; a piece that may be the only one
        try:
            for batch in batches:
                columns = [pc.fill_null(batch.column("doc_id"), NO_ID).to_pylist()]
                columns += [batch.column(c).to_pylist() for c in ("version", "start", "n", "weight", "seed", "piece")]
                again = []
                for *place, weight, seed, piece in zip(*columns, strict=True):
                    again.append((seed, piece) == last)
                    if again[-1]:
                        continue
                    if seed != last[0]:
                        alone = None
                    elif alone is not None:
                        origin.add((text.add(last[1]), *alone))
                        alone = None
                    if seed != last[0] and weight < 2:
                        alone = place
                    else:
                        origin.add((text.add(piece), *place))
                    last = (seed, piece)
                yield batch.select(["doc_id", "version", "start", "n"]).filter(pa.array(again, pa.bool_()))
            origin.close()
            if not origin.firsts:
                return
            text.close()
            width = 1 << 20
            dealt = Buckets(scratch, -(-text.n // width), [np.int64])
            for places in _repeated(text, origin, scratch, length):
                dealt.deal(places // width, (places,))
            for b in range(len(dealt.parts)):
                places = np.sort(dealt.all(b)[0])
                if not len(places):
                    continue
                starts = np.flatnonzero(np.append(True, np.diff(places) > 1))
                n = np.diff(np.append(starts, len(places)))
                ids, versions, at, _ = origin.find(places[starts])
                ids = pa.array(ids, mask=ids == NO_ID)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(versions), pa.array(at), pa.array(n)], ["doc_id", "version", "start", "n"]
                )
        finally:
            scratch.close()

    return run


def _single_strings(pieces: DataFrame, length: int) -> DataFrame:
    """Repeats among the strings of very frequent minima: each string by itself, by its digest."""
    at = F.posexplode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("k", "i")
    strings = pieces.select("doc_id", "version", "start", "piece", at)
    digest = F.unhex(F.md5(F.expr(f"substring(piece, i, {length})"))).alias("digest")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "version", (F.col("start") + F.col("k")).alias("start"))
    strings = stored(strings.select(digest, place.alias("place")), "strings")
    firsts = stored(strings.groupBy("digest").agg(F.min("place").alias("first")), "first-strings")
    later = strings.join(firsts, "digest").where(~F.col("place").eqNullSafe(F.col("first")))
    return later.select("place.doc_id", "place.version", "place.start", F.lit(1).cast("bigint").alias("n"))


def _versions(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, version, text, copies: one row for each document. Rows whose id is unique have version 0,
    others one that follows from their text; equal rows are one with their number."""
    rows = picked(docs, doc_id=id_col, text=text_col)
    rows = rows.select(F.col("doc_id").cast("bigint"), letters(F.col("text")).alias("text"))
    counts = rows.groupBy("doc_id").agg(F.count("*").alias("rows"))
    several = stored(counts.where("rows > 1 or doc_id is null").select(F.col("doc_id").alias("id")), "ids")
    marked = rows.join(several.withColumn("several", F.lit(True)), F.col("doc_id").eqNullSafe(F.col("id")), "left")
    single = marked.where("several is null")
    single = single.select("doc_id", F.lit(0).cast("bigint").alias("version"), "text", F.lit(1).cast("bigint").alias("copies"))
    others = marked.where("several").groupBy("doc_id", F.xxhash64("text").alias("version"))
    return single.unionAll(others.agg(F.first("text").alias("text"), F.count("*").alias("copies")))


def _joined(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """Join by document, ids without a value included."""
    right = right.withColumnsRenamed({"doc_id": "right_id", "version": "right_version"})
    same = F.col("doc_id").eqNullSafe(F.col("right_id")) & (F.col("version") == F.col("right_version"))
    return left.join(right, same, how).drop("right_id", "right_version")


def repeats(docs: DataFrame, length: int = LENGTH, hot: int = HOT, limit: int = 1 << 20) -> DataFrame:
    """Strings of ``length`` bytes that come earlier: runs of their starts as doc_id, version, start, n.

    ``docs`` are rows of ``_versions``. Earlier is a smaller doc_id (none comes last), then a smaller
    version, then an earlier start. A task keeps ``limit`` rows of each of its queues in memory, the rest in
    the scratch folder. Minima with more than ``hot`` pieces would make one shard large, so their
    strings are dealt one by one.
    """
    spark = docs.sparkSession
    on_executors(spark)
    texts = docs.select("doc_id", "version", "text")
    kinds = f"{PLACE}, seed bigint, weight bigint"
    runs = stored(texts.mapInArrow(_marked(length), kinds), "runs")
    counts = runs.groupBy("seed").agg(F.sum("weight").alias("weight")).where("weight > 1")
    shared = stored(counts.select("seed"), "seeds")
    kept = runs.join(shared, "seed").groupBy("doc_id", "version")
    kept = kept.agg(F.collect_list(F.struct("start", "n", "seed", "weight")).alias("runs"))
    pieces = _joined(texts, kept, "inner").mapInArrow(_cut(length), f"{PLACE}, seed bigint, weight bigint, piece binary")
    pieces = stored(pieces, "pieces")
    for done in (runs, shared):
        dropped(done)

    first = pieces.where("seed is not null")
    often = first.groupBy("seed").agg(F.count("*").alias("rows")).where(F.col("rows") > hot)
    often = stored(often.select("seed"), "hot-seeds")
    size = first.agg(F.sum(F.col("n") + (length - 1))).first()[0] or 0
    shards = max(1, -(-size // SHARD_BYTES))
    folder = scratch_dir(spark, "suffixes")
    # Pieces in the order of their bytes would make ascending runs of any length in the sorter.
    order = ["seed", F.xxhash64("piece"), "piece", F.col("doc_id").asc_nulls_last(), "version", "start"]
    cold = first.join(often, "seed", "left_anti").repartition(shards, "seed").sortWithinPartitions(*order)
    found = cold.mapInArrow(_sorted_shard(folder, length, limit), PLACE)
    whole = pieces.where("seed is null").select("doc_id", "version", "start", "n")
    found = found.unionAll(whole)
    if not is_empty(often):
        found = found.unionAll(_single_strings(first.join(often, "seed", "left_semi"), length))
    result = stored(found, "repeats")
    dropped(pieces)
    deleted(spark, folder)
    return result


def _without(length: int):
    """Each text without the bytes that its repeats cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows = []
            spans = _spans(*_listed(batch.column("runs")), length, batch.num_rows)
            columns = (batch.column(c).to_pylist() for c in ("doc_id", "copies"))
            texts = as_bytes(batch.column("text"))
            for doc_id, copies, text, own in zip(*columns, texts, spans, strict=True):
                rows.append((doc_id, text, own))
                # Equal rows after the first: every string of theirs comes earlier.
                rows += [(doc_id, text, [(0, len(text))] if len(text) >= length else [])] * (copies - 1)
            for at in range(0, len(rows), 10_000):
                yield _result(rows[at : at + 10_000])

    return run


def _spans(row: np.ndarray, start: np.ndarray, n: np.ndarray, length: int, rows: int) -> list[list]:
    """The covered spans of each row."""
    order = np.lexsort((start, row))
    row, start = row[order], start[order]
    stop = start + n[order] + (length - 1)
    # Ends so far within a row: rows lie far apart on a common line.
    far = row * (int(stop.max(initial=0)) + 1)
    reach = np.maximum.accumulate(stop + far) - far
    new = np.append(True, (row[1:] != row[:-1]) | (start[1:] > reach[:-1])) if len(row) else np.empty(0, bool)
    at = np.flatnonzero(new)
    ends = reach[np.append(at[1:], len(row)) - 1] if len(row) else reach
    found: list[list] = [[] for _ in range(rows)]
    for i, a, b in zip(row[at].tolist(), start[at].tolist(), ends.tolist(), strict=True):
        found[i].append((a, b))
    return found


RESULT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary, spans array<struct<start:bigint,stop:bigint>>"
_RESULT = pa.schema(
    [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64())]
    + [("kept", pa.binary()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))]
)


def _result(rows: list[tuple]) -> pa.RecordBatch:
    found = []
    for doc_id, text, spans in rows:
        ends = [0, *(stop for _, stop in spans)]
        starts = [*(start for start, _ in spans), len(text)]
        kept = b"".join(text[a:b] for a, b in zip(ends, starts, strict=True))
        found.append(
            {
                "doc_id": doc_id,
                "n_bytes": len(text),
                "n_removed": len(text) - len(kept),
                "n_spans": len(spans),
                "kept": kept,
                "spans": [{"start": a, "stop": b} for a, b in spans],
            }
        )
    return pa.RecordBatch.from_pylist(found, _RESULT)


def without_repeats(
    docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", **options
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (bytes that stay) and spans (what goes) of every row.

    A byte goes if a string of ``length`` bytes covers it that also starts earlier: in a document with
    a smaller id, or before in the same one. Texts are judged as they came, as UTF-8; removal can
    cut through a character. A null text is empty; texts under ``length`` bytes stay whole. Rows
    without an id come last. Different texts with one id are different documents, in the order of a hash
    of the text; of equal rows the first counts and the others repeat it. No rows give no rows. Other
    columns are not carried.
    """
    versions = _versions(docs, id_col, text_col)
    found = repeats(versions, length, **options).groupBy("doc_id", "version")
    found = found.agg(F.collect_list(F.struct("start", "n")).alias("runs"))
    return _joined(versions, found, "left").select("doc_id", "copies", "runs", "text").mapInArrow(_without(length), RESULT)


def digests(cleaned: DataFrame) -> DataFrame:
    """The columns of the contract: the bytes that stay by their SHA-256."""
    return cleaned.select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )
