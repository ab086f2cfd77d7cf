"""Leaks of benchmark items into documents.

Runs of two words of the items are looked up in every document. How many of them a leak must hold,
and how near to each other, follows from the scores of the alignment, so a document is left out only
where no leak can be, however often items or their parts were copied. What is left is aligned with the
item by Smith-Waterman, which scores copies with words changed, left out or put in.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, boxed, on_executors, picked, slices, stored
from .id_filter import without_ids
from .shingles import Words, bare, windows

BLOCK_BYTES = 2 << 20
# Pairs of a place in a document and an item that are held at once.
PLACES = 4 << 20


@dataclass(frozen=True)
class Alignment:
    """Runs of ``seed`` words lead to pairs; with two, every pair of a leak has one. Items of fewer
    than ``min_words`` words leak only as a whole and exactly, as half of them proves nothing. A pair of
    a longer one is a leak if its score is at least ``min_score``, where 1 is a whole and exact copy."""

    seed: int = 2
    min_words: int = 8
    match: int = 3
    mismatch: int = -1
    gap: int = -2
    min_score: float = 0.5

    def least(self, n: int) -> int:
        """The score from which on an item of n words has leaked."""
        return math.ceil(self.min_score * self.match * n - 1e-9)

    def hits(self, n: int) -> int:
        """Runs that a leak of an item of n words shares with it at least.

        ``e`` errors part the matched words into e + 1 stretches at most, and each stretch has
        seed - 1 runs fewer than words. Errors that use up a word of the item are the cheaper ones.
        """
        least = n
        for matched in range(n + 1):
            left = self.match * matched - self.least(n)
            if left < 0:
                continue
            errors = min(n - matched, left // max(self.error, 1)) if self.error else n - matched
            left -= errors * self.error
            errors = errors + left // -self.gap if self.gap else matched
            least = min(least, matched - (self.seed - 1) * min(matched, errors + 1))
        return max(least, 1)

    def span(self, n: int) -> int:
        """Words of a document that a leak of an item of n words takes at most."""
        return n + (self.match * n - self.least(n)) // -self.gap if self.gap else 1 << 30

    @property
    def error(self) -> int:
        """What a word of the item without a match costs at least."""
        return min(-self.mismatch, -self.gap)

    def possible(self, item: np.ndarray, words: np.ndarray) -> bool:
        """False if no alignment can be a leak, even if all words of the item that the document has
        stood in the item's order: the best stretch of the item is too short of them."""
        sums = np.cumsum(np.where(np.isin(item, words), self.match, -self.error))
        before = np.minimum.accumulate(np.concatenate(([0], sums[:-1])))
        return int((sums - before).max()) >= self.least(len(item))


def smith_waterman(item: np.ndarray, words: np.ndarray, how: Alignment) -> float:
    """Best local alignment of an item with words, as a part of that of an exact copy.

    Row by row; gaps along a row are a running maximum.
    """
    slope = how.gap * np.arange(len(words) + 1)
    row, best = np.zeros(len(words) + 1, np.int64), 0
    for word in item:
        step = np.where(words == word, how.match, how.mismatch)
        new = np.maximum(row + how.gap, 0)
        np.maximum(new[1:], row[:-1] + step, out=new[1:])
        row = np.maximum.accumulate(new - slope) + slope
        best = max(best, int(row.max()))
    return best / (how.match * len(item))


class Items:
    """Word hashes of a block of items, and where their runs stand."""

    def __init__(self, rows: list[tuple[int, bytes]], how: Alignment):
        words = Words(bare)
        self.ids, self.words = [], []
        # Short items by their number of words and the hash of all of them.
        self.short: dict[int, dict[int, list]] = {}
        for item_id, text in rows:
            found = words.hashes(text)
            if len(found) >= how.min_words:
                self.ids.append(item_id)
                self.words.append(found)
            elif len(found):
                whole = int(windows(found, len(found))[0])
                self.short.setdefault(len(found), {}).setdefault(whole, []).append(item_id)
        runs = [windows(w, how.seed) for w in self.words]
        every = np.concatenate(runs) if runs else np.empty(0, np.uint64)
        self.runs, run_of = np.unique(every, return_inverse=True)
        item_of = np.repeat(np.arange(len(runs)), [len(r) for r in runs])
        # Items of a run follow each other: number of the run times the number of items, plus item.
        self.pairs = np.unique(run_of * len(runs) + item_of)
        sizes = [len(w) for w in self.words]
        self.hits = np.array([how.hits(n) for n in sizes], np.int64)
        self.span = np.array([how.span(n) for n in sizes], np.int64)
        self.filter = np.zeros(1 << 20, bool)
        self.filter[self.runs & np.uint64((1 << 20) - 1)] = True

    def whole(self, words: np.ndarray) -> Iterator[int | None]:
        """Short items all of whose words stand in a document in a row."""
        for n, items in self.short.items():
            if n <= len(words):
                for found in np.intersect1d(windows(words, n), np.array(list(items), np.uint64)):
                    yield from items[int(found)]

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of a document's runs that an item has, and their numbers."""
        at = np.flatnonzero(self.filter[hashes & np.uint64((1 << 20) - 1)])
        number = np.searchsorted(self.runs, hashes[at])
        number = np.minimum(number, max(len(self.runs) - 1, 0))
        same = self.runs[number] == hashes[at] if len(at) else np.zeros(0, bool)
        return at[same], number[same]

    def places(self, hashes: np.ndarray, seed: int) -> Iterator[tuple[int, list[int]]]:
        """Items that may have leaked into a document of these runs, and where leaks may begin."""
        at, number = self.find(hashes)
        if not len(at):
            return
        n, size = len(self.ids), max(PLACES // len(at), 1)
        for first in range(0, n, size):
            lo = np.searchsorted(self.pairs, number * n + first)
            some = np.searchsorted(self.pairs, number * n + min(first + size, n)) - lo
            ends = np.cumsum(some)
            if not ends[-1]:
                continue
            pair = np.arange(ends[-1]) + np.repeat(lo - (ends - some), some)
            place = np.sort(self.pairs[pair] % n * len(hashes) + np.repeat(at, some))
            item, x = np.divmod(place, len(hashes))
            last = np.arange(len(x)) + self.hits[item] - 1
            there = last < len(x)
            last = np.where(there, last, 0)
            there &= (item[last] == item) & (x[last] - x <= self.span[item] - seed)
            item, x = item[there], x[there]
            for k in np.unique(item):
                yield int(k), x[np.searchsorted(item, k) : np.searchsorted(item, k, "right")].tolist()


def _blocks(items: DataFrame) -> Iterator[list[tuple[int, bytes]]]:
    """Items in runs of bounded size, so that what is broadcast does not grow with them."""
    block, size = [], 0
    for row in items.orderBy("item_id", "text").toLocalIterator():
        text = (row["text"] or "").encode()
        if block and size + len(text) > BLOCK_BYTES:
            yield block
            block, size = [], 0
        block.append((row["item_id"], text))
        size += len(text)
    if block:
        yield block


LEAKS = "doc_id bigint, item_id bigint, score double"


def _surroundings(at: list[int], reach: int) -> Iterator[tuple[int, int]]:
    """Stretches of a document around hits: hits nearer than ``reach`` share one."""
    start = end = None
    for x in sorted(at):
        if end is not None and x > end:
            yield start, end
            start = None
        start = max(x - reach, 0) if start is None else start
        end = x + reach
    if start is not None:
        yield start, end


def _aligned(docs: DataFrame, items, how: Alignment) -> DataFrame:
    def leaks(doc_id, words: np.ndarray):
        known = items.value
        for item_id in known.whole(words):
            yield doc_id, item_id, 1.0
        if not known.ids:
            return
        for item, at in known.places(windows(words, how.seed), how.seed):
            wanted = known.words[item]
            parts = [words[a:b] for a, b in _surroundings(at, int(known.span[item]))]
            parts = [p for p in parts if how.possible(wanted, p)]
            score = max((smith_waterman(wanted, p, how) for p in parts), default=0)
            if score >= how.min_score:
                yield doc_id, known.ids[item], score

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(bare)
        for part in slices(batches, "text"):
            found = []
            ids = part.column("doc_id").to_pylist()
            for doc_id, text in zip(ids, as_bytes(part.column("text")), strict=True):
                found += leaks(doc_id, words.hashes(text))
            columns = list(zip(*found, strict=True)) or [(), (), ()]
            types = [pa.int64(), pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                ["doc_id", "item_id", "score"],
            )

    return docs.mapInArrow(run, LEAKS)


def leaks(
    docs: DataFrame,
    items: DataFrame,
    how: Alignment = Alignment(),
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """doc_id, item_id and score of every document that holds a copy of an item; no other rows.

    Null and empty texts hold nothing, and null or empty items are in nothing. Rows without an id
    give leaks without one. Repeated rows of documents give repeated leaks, repeated items one each.
    Other columns are not carried. Items are broadcast in blocks of some MB and each block reads the
    documents once.
    """
    spark = docs.sparkSession
    on_executors(spark)
    rows = picked(docs, doc_id=id_col, text=text_col)
    rows = rows.withColumn("doc_id", F.col("doc_id").cast("bigint"))
    tests = picked(items, item_id=item_id_col, text=item_text_col)
    found = spark.createDataFrame([], LEAKS)
    for block in _blocks(tests.withColumn("item_id", F.col("item_id").cast("bigint"))):
        known = Items(block, how)
        if not known.ids and not known.short:
            continue
        shared = spark.sparkContext.broadcast(known)
        found = found.unionByName(_aligned(rows, shared, how))
    return found


def without_leaks(docs: DataFrame, items: DataFrame, how: Alignment = Alignment()) -> DataFrame:
    """The documents that hold no item. Rows without an id go by their text."""
    leaked = leaks(docs, items, how).select(F.col("doc_id").alias("id")).where("id is not null")
    named = without_ids(docs.where("doc_id is not null"), stored(leaked.distinct(), "leaked"))
    nameless = boxed(docs.where("doc_id is null"), doc_id=F.xxhash64("text"))
    texts = nameless.select("doc_id", F.col("row.text").alias("text"))
    bad = stored(leaks(texts, items, how).select(F.col("doc_id").alias("id")).distinct(), "leaked-texts")
    kept = nameless.join(bad, F.col("doc_id") == F.col("id"), "left_anti").select("row.*")
    return named.unionByName(kept)
