"""Near duplicates by HyperMinHash.

For each bucket the smallest hash of a document's shingles is kept as a register of 16 bits: its
number of leading zeros and the next 11 bits. Bands of four registers, 64 bits, propose candidates.
How often registers agree, less the agreement that compression alone gives to sets of that size,
estimates the Jaccard similarity and drops hopeless candidates; the rest is confirmed on full sets.

Buckets are independent hash functions, not parts of one: documents of a few words would leave most
parts empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, boxed, dropped, is_empty, on_executors, picked, slices, stored
from .components import components
from .id_filter import only_ids, without_ids
from .shingles import Words, mixed, shingle_set

MANTISSA = 11
BAND = 4


@dataclass(frozen=True)
class Similarity:
    """Links hold from ``percent`` of intersection in union on, over runs of ``words`` words.

    With 32 bands a pair at 75 percent is proposed with probability 1 - 5e-6, at 80 percent with
    1 - 5e-8. An estimate from 128 registers has a standard error of 0.04; ``slack`` is five of them.
    """

    words: int = 5
    percent: int = 75
    bands: int = 32
    slack: float = 0.2

    @property
    def registers(self) -> int:
        return self.bands * BAND


@lru_cache(maxsize=4)
def _functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and offsets of n hash functions on 32 bits."""
    seeds = mixed(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    seeds = (seeds >> np.uint64(32)).astype(np.uint32)
    return seeds[:n] | np.uint32(1), seeds[n:]


def minima(shingles: np.ndarray, n: int) -> np.ndarray:
    """The smallest value of each hash function over a set of 64-bit shingles."""
    multiply, add = _functions(n)
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    best = np.full(n, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(short), 256):
        values = short[i : i + 256, None] * multiply
        values += add
        np.minimum(best, values.min(axis=0), out=best)
    return best


def registers(values: np.ndarray) -> np.ndarray:
    """Leading zeros (5 bits) and the bits after the first one (11 bits) of 32-bit values."""
    wide = values.astype(np.uint64)
    length = np.frexp(wide.astype(np.float64))[1].astype(np.uint64)
    zeros = np.minimum(np.uint64(32) - length, np.uint64(31))
    rest = (wide << (zeros + np.uint64(1))) & np.uint64(0xFFFFFFFF)
    mantissa = rest >> np.uint64(32 - MANTISSA)
    return ((zeros << np.uint64(MANTISSA)) | mantissa).astype(np.uint16)


@lru_cache(maxsize=1)
def _chance() -> tuple[np.ndarray, np.ndarray]:
    """Logarithms of set sizes, and the chance that registers of two such sets agree although their
    smallest hashes differ: the sum over register values of their squared probability."""
    part = np.arange(1 << MANTISSA) / (1 << MANTISSA)
    low = np.concatenate([(1 + part) * 2.0 ** -(zeros + 1) for zeros in range(32)])
    width = np.repeat([2.0 ** -(zeros + 1 + MANTISSA) for zeros in range(32)], len(part))
    sizes = np.geomspace(1, 1e9, 46)
    found = []
    for n in sizes:
        above, beyond = n * np.log1p(-low), n * np.log1p(-np.minimum(low + width, 1 - 1e-16))
        found.append(float(np.square(np.exp(above) - np.exp(beyond)).sum()))
    return np.log(sizes), np.array(found)


def estimated(left: np.ndarray, right: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard similarity of pairs of sets from rows of registers and the sizes of the sets."""
    agreement = (left == right).mean(axis=1)
    logs, chances = _chance()
    chance = np.interp((np.log(np.maximum(n, 1)) + np.log(np.maximum(m, 1))) / 2, logs, chances)
    return (agreement - chance) / (1 - chance)


SKETCH = "doc_id bigint, n_shingles bigint, digest binary, registers binary"


def sketches(docs: DataFrame, how: Similarity) -> DataFrame:
    """n_shingles, a 128-bit digest of the set and its registers, of rows (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for part in slices(batches, "text"):
            sizes, digests, values = [], [], []
            for text in as_bytes(part.column("text")):
                found = shingle_set(words.hashes(text), how.words)
                sizes.append(len(found))
                digests.append(xxhash.xxh3_128_digest(found.tobytes()))
                values.append(minima(found, how.registers))
            packed = registers(np.array(values))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array(sizes, pa.int64()),
                    pa.array(digests, pa.binary()),
                    pa.array([row.tobytes() for row in packed], pa.binary()),
                ],
                ["doc_id", "n_shingles", "digest", "registers"],
            )

    return docs.mapInArrow(run, SKETCH)


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, n)


def band_keys(classes: DataFrame, how: Similarity) -> DataFrame:
    """(key, id): one 64-bit key for each band of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        band = mixed(np.arange(1, how.bands + 1, dtype=np.uint64))
        for part in slices(batches, "registers"):
            rows = _matrix(part.column("registers"), how.registers).view(np.uint64)
            keys = mixed(mixed(rows) + band).view(np.int64)
            ids = np.repeat(part.column("id").to_numpy(), how.bands)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.ravel()), pa.array(ids)], ["key", "id"]
            )

    return classes.select("id", "registers").mapInArrow(run, "key bigint, id bigint")


def _sizes_allow(how: Similarity, n: str, m: str) -> Column:
    return 100 * F.least(n, m) >= how.percent * F.greatest(n, m)


def likely(pairs: DataFrame, classes: DataFrame, how: Similarity) -> DataFrame:
    """(a, b, estimate) of the pairs (a, b) whose registers do not rule out a link."""
    left = classes.select(F.col("id").alias("a"), F.col("n").alias("n"), F.col("registers").alias("r"))
    right = classes.select(F.col("id").alias("b"), F.col("n").alias("m"), F.col("registers").alias("s"))
    both = pairs.join(left, "a").join(right, "b").where(_sizes_allow(how, "n", "m"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "r"):
            r, s = (_matrix(part.column(c), how.registers) for c in ("r", "s"))
            n, m = (part.column(c).to_numpy() for c in ("n", "m"))
            estimate = estimated(r, s, n, m)
            keep = pa.array(estimate >= how.percent / 100 - how.slack)
            found = [part.column("a"), part.column("b"), pa.array(estimate)]
            yield pa.RecordBatch.from_arrays([x.filter(keep) for x in found], ["a", "b", "estimate"])

    return both.mapInArrow(run, "a bigint, b bigint, estimate double")


def confirmed(pairs: DataFrame, texts: DataFrame, how: Similarity) -> DataFrame:
    """The pairs (a, b) linked by their full shingle sets; ``texts`` has a row (id, text) of each."""
    left = texts.select(F.col("id").alias("a"), F.col("text").alias("left"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("right"))
    both = pairs.select("a", "b").join(right, "b").join(left, "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        last, last_set = None, None
        for part in slices(batches, "right"):
            keep = []
            for text, other in zip(*(as_bytes(part.column(c)) for c in ("left", "right")), strict=True):
                if text != last:
                    last, last_set = text, shingle_set(words.hashes(text), how.words)
                found = shingle_set(words.hashes(other), how.words)
                common = len(np.intersect1d(last_set, found, assume_unique=True))
                union = len(last_set) + len(found) - common
                keep.append(100 * common >= how.percent * union)
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [part.column(c).filter(mask) for c in ("a", "b")], ["a", "b"]
            )

    return both.mapInArrow(run, "a bigint, b bigint")


def _ordered(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def linked_classes(classes: DataFrame, texts_of, how: Similarity) -> DataFrame:
    """(node, component) for the classes that have links. ``classes``: id, n, registers;
    ``texts_of(ids)``: stored (id, text) of the given ids.

    1. In each bucket, members are paired with its smallest one, the head: as many pairs as members.
    2. Of its likely pairs, each class confirms the best one first. Mostly these already join what
       belongs together.
    3. Only pairs across the components so far can add anything: pairs left over from 1, and pairs of
       a bucket's other members, which ``_across`` compares without listing them. So no link between
       components is lost.
    """
    bands = band_keys(classes, how)
    heads = bands.groupBy("key").agg(F.min("id").alias("head"), F.count("*").alias("many"))
    heads = heads.where("many > 1").select("key", "head")
    members = stored(bands.join(heads, "key"), "members")
    star = members.where("id <> head").select(*_ordered("head", "id")).distinct()
    candidates = stored(likely(star, classes, how), "likely")
    either = candidates.select("b", "a", "estimate").toDF("a", "b", "estimate")
    best = (
        candidates.unionByName(either)
        .groupBy("a")
        .agg(F.max_by("b", F.struct("estimate", -F.col("b"))).alias("b"))
        .select(*_ordered("a", "b"))
        .distinct()
    )
    texts = texts_of(stored(members.select("id").distinct(), "candidates"))
    links = stored(confirmed(best, texts, how), "links")
    found = stored(components(links), "components")

    def of(column: str) -> DataFrame:
        return found.select(F.col("node").alias(column), F.col("component").alias(f"c_{column}"))

    named = candidates.join(of("a"), "a", "left").join(of("b"), "b", "left")
    rest = named.where(F.coalesce("c_a", "a") != F.coalesce("c_b", "b")).select("a", "b")
    across = _across(members, found, texts, how)
    late = confirmed(rest, texts, how)
    both = stored(links.unionByName(late).unionByName(across), "all-links")
    dropped(members)
    return components(both)


DIFFERENCE = "head bigint, id bigint, n int, held binary, added binary"
BLOCK_ROWS = 1024


def _differences(pairs: DataFrame, texts: DataFrame, how: Similarity) -> DataFrame:
    """Each member of (head, id) as its difference from the head: a bit for each shingle of the head
    that says whether the member holds it, and the shingles that it has besides."""
    left = texts.select(F.col("id").alias("head"), F.col("text").alias("left"))
    right = texts.select("id", F.col("text").alias("right"))
    both = pairs.join(right, "id").join(left, "head")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        last, last_set = None, None
        for part in slices(batches, "right"):
            sizes, held, added = [], [], []
            for text, other in zip(*(as_bytes(part.column(c)) for c in ("left", "right")), strict=True):
                if text != last:
                    last, last_set = text, shingle_set(words.hashes(text), how.words)
                own = shingle_set(words.hashes(other), how.words)
                bits = np.packbits(np.isin(last_set, own, assume_unique=True))
                sizes.append(len(own))
                held.append(bits.tobytes())
                added.append(own[~np.isin(own, last_set, assume_unique=True)].tobytes())
            yield pa.RecordBatch.from_arrays(
                [
                    *(part.column(c) for c in ("head", "id")),
                    pa.array(sizes, pa.int32()),
                    pa.array(held, pa.binary()),
                    pa.array(added, pa.binary()),
                ],
                ["head", "id", "n", "held", "added"],
            )

    return both.mapInArrow(run, DIFFERENCE)


def _linked_rows(rows: list[dict], how: Similarity) -> Iterator[tuple[int, int]]:
    """Links between the outsiders among the rows of one block and all rows that face them."""
    outside, inside = ([r for r in rows if r["outside"] == x] for x in (True, False))
    if not outside or not inside:
        return
    bits = np.array([np.frombuffer(r["held"], np.uint8) for r in inside])
    n = np.array([r["n"] for r in inside], np.int64)
    added = np.array([len(r["added"]) // 8 for r in inside], np.int64)
    component = np.array([r["c"] for r in inside])
    for row in outside:
        own = np.frombuffer(row["added"], np.uint64)
        shared = np.bitwise_count(bits & np.frombuffer(row["held"], np.uint8)).sum(axis=1, dtype=np.int64)
        most = shared + np.minimum(added, len(own))
        total = n + row["n"]
        may = ((100 + how.percent) * most >= how.percent * total) & (component != row["c"])
        for k in np.flatnonzero(may):
            other = np.frombuffer(inside[k]["added"], np.uint64)
            common = shared[k] + len(np.intersect1d(own, other, assume_unique=True))
            if 100 * common >= how.percent * (total[k] - common):
                yield row["id"], inside[k]["id"]


def _across(members: DataFrame, found: DataFrame, texts: DataFrame, how: Similarity) -> DataFrame:
    """Links between members of a bucket that are in different components.

    For the members of buckets that hold more than one component. One of a pair is an outsider, not
    in the head's component. Outsiders and all members of a head are cut into blocks by a hash, and
    each block of outsiders meets each block of members in a group of some thousand short rows, which
    compares differences from the head bit by bit. Only links leave it, no pairs.
    """
    component = found.select(F.col("node").alias("id"), F.col("component").alias("c"))
    named = members.join(component, "id", "left")
    named = named.select("key", "head", "id", F.coalesce("c", "id").alias("c"))
    split = named.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"))
    open_keys = split.where("lo <> hi").select("key")
    pairs = named.join(open_keys, "key", "left_semi").where("id <> head")
    pairs = pairs.select("head", "id").distinct()
    of_head = component.select(F.col("id").alias("head"), F.col("c").alias("c_head"))
    rows = (
        _differences(pairs, texts, how)
        .join(component, "id", "left")
        .join(of_head, "head", "left")
        .withColumn("c", F.coalesce("c", "id"))
        .withColumn("outside", F.col("c") != F.coalesce("c_head", "head"))
        .drop("c_head")
    )
    rows = stored(rows, "differences")
    blocks = rows.groupBy("head").agg(
        F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("all"),
        F.ceil(F.count_if("outside") / BLOCK_ROWS).cast("int").alias("out"),
    )
    placed = rows.join(blocks.where("`out` > 0"), "head")
    own = F.pmod(F.xxhash64("id"), F.lit(1 << 20)).cast("int")

    def facing(own_blocks: str, other_blocks: str, names: tuple[str, str]) -> list:
        other = F.explode(F.sequence(F.lit(0), F.col(other_blocks) - 1)).alias(names[1])
        return [(own % F.col(own_blocks)).alias(names[0]), other]

    columns = ["head", "id", "n", "held", "added", "c"]
    outsiders = placed.where("outside").select(
        *columns, F.lit(True).alias("outside"), *facing("out", "all", ("i", "j"))
    )
    every = placed.select(*columns, F.lit(False).alias("outside"), *facing("all", "out", ("j", "i")))
    meeting = outsiders.unionByName(every).repartition("head", "i", "j")
    meeting = meeting.sortWithinPartitions("head", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows_of() -> Iterator[dict]:
            for part in slices(batches, "added"):
                yield from part.to_pylist()

        for _, group in groupby(rows_of(), key=lambda r: (r["head"], r["i"], r["j"])):
            links = list(_linked_rows(list(group), how))
            if links:
                a, b = zip(*links, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"]
                )

    return meeting.mapInArrow(run, "a bigint, b bigint")


def near_duplicates(
    docs: DataFrame, how: Similarity = Similarity(), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row.

    Rows are linked if their shingle sets are alike enough, and component_id is the smallest id that
    links reach. Rows with equal sets form a class, and only one row of a class is compared. Null
    texts, and texts without words, have an empty set and no links: they are kept. Rows without an id
    have no component and are kept. Rows that share an id and a text share the result; ids are meant
    to be unique otherwise. Other columns are not carried; no rows give no rows.
    """
    on_executors(docs.sparkSession)
    rows = picked(docs, doc_id=id_col, text=text_col)
    rows = rows.withColumn("doc_id", F.col("doc_id").cast("bigint"))
    drawn = stored(sketches(rows, how), "sketches")
    named = drawn.where("n_shingles > 0 and doc_id is not null")
    ids = named.groupBy("digest").agg(F.min("doc_id").alias("id"))
    ids = stored(ids, "classes")
    first = named.join(ids, "digest").where("doc_id = id")
    classes = first.groupBy("id").agg(
        F.max("n_shingles").alias("n"), F.max("registers").alias("registers")
    )
    classes = stored(classes, "class-registers")

    def texts_of(wanted: DataFrame) -> DataFrame:
        one = only_ids(rows, wanted).select(F.col("doc_id").alias("id"), "text").dropDuplicates(["id"])
        return stored(one, "texts")

    joined = linked_classes(classes, texts_of, how)
    component = F.coalesce("component", "id").alias("component")
    named_ids = ids.join(joined, ids["id"] == joined["node"], "left").select("digest", component)
    result = drawn.select("doc_id", "n_shingles", "digest").join(named_ids, "digest", "left")
    empty = F.col("n_shingles") == 0
    component_id = F.when(
        F.col("doc_id").isNotNull(),
        F.when(empty, F.col("doc_id")).otherwise(F.coalesce("component", "doc_id")),
    )
    return result.select(
        "doc_id",
        "n_shingles",
        component_id.alias("component_id"),
        F.coalesce(component_id == F.col("doc_id"), F.lit(True)).alias("kept"),
    )


def without_copies(
    docs: DataFrame, how: Similarity = Similarity(), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row of each group of near duplicates, with all its columns: the one with the smallest id.

    Rows that share an id are one document, and one of them stays. Rows without an id all stay.
    """
    found = near_duplicates(docs, how, id_col, text_col)
    copies = stored(found.where("not kept").select(F.col("doc_id").alias("id")).distinct(), "copies")
    rest = without_ids(docs, copies, id_col)
    again = picked(docs, id=id_col).where("id is not null").groupBy("id").count().where("count > 1")
    again = stored(again.select("id"), "repeated-ids")
    if is_empty(again):
        return rest
    once = boxed(only_ids(rest, again, id_col), own=id_col).dropDuplicates(["own"]).select("row.*")
    return without_ids(rest, again, id_col).unionByName(once)
