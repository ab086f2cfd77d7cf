"""Words of a corpus that differ by one letter, and the frequent form that each stands for.

Words that may differ by one edit meet in groups: of two words whose shorter one has ``size`` letters, either
the first half agrees or what follows it. A group that stays large is halved again in the same way
until one letter is left open, so that its size is bounded. Inside a group the sorted list is scanned
once for all its words: rows of the edit matrix, three cells wide, belong to a prefix of the list and are
shared by all entries that have this prefix, as the adjacent common prefixes tell; a range of the
list leaves the scan for a word as soon as the row of its shared prefix has no cell below two.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, is_empty, letters, on_executors, picked, stored

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
RUN = r"[A-Za-zÀ-ÿ]+"
SHORTEST = 5
FEWEST = 3
NOISE = 97
MOST = 20_000  # entries of a group that is scanned at once; groups with one open letter are smaller
CELLS = 4_000_000  # letters of the groups that are scanned together
PAIRS = 2_000_000  # rows of the edit matrix that are worked on together
FAR = 2
GROUP = ["size", "head", "tail", "bound", "start", "end"]
_PAIRS = "word string, near string, near_n bigint"


def word_counts(
    docs: DataFrame,
    shortest: int = SHORTEST,
    fewest: int = FEWEST,
    noise: int = NOISE,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(word, n): runs of letters, A-Z in lower case, with at least ``shortest`` letters, counted over all texts.

    With h the CRC-32 of ``<doc_id>:<run>``, runs of which ``noise`` divides h lose the letter h % length.
    A null text has no words, a null id reads as an empty one.
    """
    rows = picked(docs, doc_id=id_col, text=text_col)
    lower = F.translate(letters(F.col("text")), UPPER, UPPER.lower())
    runs = rows.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"),
        F.explode(F.regexp_extract_all(lower, F.lit(RUN), F.lit(0))).alias("run"),
    )
    # Shorter runs cannot become words: the only edit takes a letter away.
    runs = runs.where(F.length("run") >= shortest)
    hashed = runs.withColumn("h", F.crc32(F.concat("doc_id", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    word = F.when(F.col("h") % noise == 0, cut).otherwise(F.col("run"))
    counts = hashed.select(word.alias("word")).where(F.length("word") >= shortest)
    return counts.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= fewest)


def _key(size: Column, head: Column, tail: Column, bound: Column) -> Column:
    """A group: words whose first ``head`` and last ``tail`` letters agree, and the pairs that are its own:
    those whose common prefix is shorter than ``bound``."""
    return F.struct(size.alias("size"), head.alias("head"), tail.alias("tail"), bound.alias("bound"))


def _grouped(rows: DataFrame, keys: list[Column]) -> DataFrame:
    rows = rows.select("word", "n", F.explode(F.array(*keys)).alias("key")).select("word", "n", "key.*")
    length = F.length("word")
    ends = F.substring(F.col("word"), length - F.col("tail") + 1, F.col("tail"))
    return rows.withColumns(
        {
            "start": F.substring(F.col("word"), F.lit(1), F.col("head")),
            "end": ends,
            "middle": F.substring(F.col("word"), F.col("head") + 1, length - F.col("head") - F.col("tail")),
        }
    )


def _groups(words: DataFrame, shortest: int, most: int) -> DataFrame:
    """Every word with its groups, none of them over ``most`` entries but those with one open letter."""
    # A word is the shorter one of a pair, or equally long, or longer by a letter.
    sizes = F.array_compact(F.array(F.length("word"), F.when(F.length("word") > shortest, F.length("word") - 1)))
    rows = words.select("word", "n", F.explode(sizes).alias("size"))
    half = (F.col("size") / 2).cast("int")
    none, size = F.lit(0), F.col("size")
    rows = _grouped(rows, [_key(size, half, none, size + 2), _key(size, none, size - half, half)])
    finished = None
    while True:
        rows = stored(rows, "groups")
        left = F.col("size") - F.col("head") - F.col("tail")
        counts = rows.where(left > 1).groupBy(*GROUP).agg(F.count("*").alias("rows"))
        large = stored(counts.where(F.col("rows") > most).drop("rows"), "large-groups")
        if is_empty(large):
            return rows if finished is None else finished.unionAll(rows)
        small = rows.join(large, GROUP, "left_anti").select(rows.columns)
        finished = small if finished is None else finished.unionAll(small)
        split = F.col("head") + (left / 2).cast("int")
        first = _key(F.col("size"), split, F.col("tail"), F.col("bound"))
        second = _key(F.col("size"), F.col("head"), F.col("size") - split, F.least("bound", split))
        rows = _grouped(rows.join(large, GROUP, "left_semi"), [first, second])


def _letters_of(middles: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of each text in a row of a matrix, and the lengths."""
    lengths = np.array([len(m) for m in middles])
    table = np.zeros((len(middles), lengths.max(initial=0) + 2), np.uint32)
    inside = np.arange(table.shape[1]) < lengths[:, None]
    table[inside] = np.frombuffer("".join(middles).encode("utf-32-le"), np.uint32)
    return table, lengths


def near_pairs(group: np.ndarray, middles: list[str], asks: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(asking entry, near entry, length of their common prefix) for entries of a group at one edit.

    Entries are sorted by group and letters. ``asks`` says which of them are looked up.
    """
    table, lengths = _letters_of(middles)
    differs = table[1:] != table[:-1]
    common = np.where(differs.any(1), differs.argmax(1), table.shape[1])
    common = np.append(-1, np.where(group[1:] == group[:-1], common, -1))
    first_of = np.flatnonzero(common < 0)
    roots = first_of[np.searchsorted(first_of, np.arange(len(group)), side="right") - 1]
    askers = np.flatnonzero(asks)
    widest = np.bincount(np.searchsorted(first_of, np.arange(len(group)), side="right") - 1).max(initial=1)
    block = max(1, PAIRS // min(int(widest), 128))
    for at in range(0, len(askers), block):
        chosen = askers[at : at + block]
        yield from _scan(table, lengths, common, chosen, roots[chosen])


def _scan(table, lengths, common, word, node) -> Iterator[tuple[np.ndarray, ...]]:
    """Rows of the edit matrix for (word, prefix of the list), one letter deeper at a time.

    ``left``, ``same`` and ``right`` are the cells at one letter less, as many, and one more of the
    word than the prefix has.
    """
    n, depth = len(lengths), 0
    left = np.full(len(word), FAR, np.int8)
    same = np.zeros(len(word), np.int8)
    right = np.where(lengths[word] > 0, 1, FAR).astype(np.int8)
    begins = np.flatnonzero(common < 0)
    while len(word):
        # Prefixes one letter longer: where the list first has them, within the range of the node.
        stop = np.append(begins, n)[np.searchsorted(begins, node, side="right")]
        ended = lengths[node] == depth
        if ended.any():
            yield from _ended(table, lengths, common, depth, word[ended], node[ended], left[ended], same[ended], right[ended])
        begins = np.flatnonzero(common <= depth)
        low, high = np.searchsorted(begins, node), np.searchsorted(begins, stop)
        # A text that ends here is the first of its range and has no longer prefix.
        copies = _equal_to(table, common, lengths, node, depth)
        low = np.where(ended, np.searchsorted(begins, copies), low)
        size = np.maximum(high - low, 0)
        of = np.repeat(np.arange(len(word)), size)
        child = begins[np.repeat(low - (np.cumsum(size) - size), size) + np.arange(len(of))]
        word, left, same, right = word[of], left[of], same[of], right[of]
        letter, length = table[child, depth], lengths[word]
        wide = table.shape[1] - 1

        def cost(k: int) -> np.ndarray:
            return np.where(k < length, table[word, min(max(k, 0), wide)] != letter, FAR).astype(np.int8)  # noqa: B023

        new_left = np.minimum(same + 1, left + cost(depth - 1) if depth else FAR)
        new_same = np.minimum(np.minimum(same + cost(depth), right + 1), new_left + 1)
        new_right = np.minimum(right + cost(depth + 1), new_same + 1)
        new_left = np.where(depth <= length, new_left, FAR)
        new_same = np.where(depth + 1 <= length, new_same, FAR)
        new_right = np.where(depth + 2 <= length, new_right, FAR)
        on = np.minimum(np.minimum(new_left, new_same), new_right) < FAR
        word, node, depth = word[on], child[on], depth + 1
        left, same, right = (c[on].astype(np.int8) for c in (new_left, new_same, new_right))


def _equal_to(table, common, lengths, node, depth) -> np.ndarray:
    """Behind the entries that end at ``depth`` like the node itself."""
    after = node + 1
    more = np.append(common, -1)
    long = np.append(lengths, depth + 1)
    again = (more[np.minimum(after, len(lengths))] >= depth) & (long[np.minimum(after, len(lengths))] == depth)
    while again.any():
        after = after + again
        at = np.minimum(after, len(lengths))
        again &= (more[at] >= depth) & (long[at] == depth)
    return after


def _ended(table, lengths, common, depth, word, node, left, same, right) -> Iterator[tuple[np.ndarray, ...]]:
    """Entries of the list whose letters are used up, if the word ends in the band at one edit."""
    gap = lengths[word] - depth
    cell = np.select([gap == -1, gap == 0, gap == 1], [left, same, right], FAR)
    near = cell == 1
    word, node = word[near], node[near]
    if len(word):
        equal = table[word] == table[node]
        shared = np.where(equal.all(1), lengths[word], (~equal).argmax(1))
        yield word, node, np.minimum(shared, np.minimum(lengths[word], lengths[node]))


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near pairs of the groups of a task, which come in order."""
    held: list[tuple] = []
    cells, widest, last = 0, 0, None

    def flush(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        keys = [row[3:] for row in rows]
        new = [False, *(a != b for a, b in zip(keys[1:], keys, strict=False))]
        group = np.cumsum(new)
        words, counts, middles = [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows]
        size, head, bound = (np.array([k[i] for k in keys]) for i in (0, 1, 3))
        lengths = np.array([len(w) for w in words])
        short = lengths == size
        for a, b, shared in near_pairs(group, middles, short):
            own = head[a] + shared < bound[a]
            a, b = a[own], b[own]
            # The longer word of a pair is found by the shorter one.
            longer = ~short[b]
            left, right = np.concatenate([a, b[longer]]).tolist(), np.concatenate([b, a[longer]]).tolist()
            if left:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([words[i] for i in left]), pa.array([words[i] for i in right]), pa.array([counts[i] for i in right])],
                    ["word", "near", "near_n"],
                )

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[3:] != last:
                if cells > CELLS:
                    yield from flush(held)
                    held, cells, widest = [], 0, 0
                last = row[3:]
            held.append(row)
            widest = max(widest, len(row[2]))
            cells = widest * len(held)
    if held:
        yield from flush(held)


def near_words(words: DataFrame, shortest: int = SHORTEST, most: int = MOST) -> DataFrame:
    """(word, near, near_n): every pair of different words at exactly one edit, in both directions, once.

    ``words`` are (word, n) without repeats, none shorter than ``shortest`` letters.
    """
    on_executors(words.sparkSession)
    order = ["size", "head", "tail", "bound", "start", "end", "middle"]
    rows = _groups(words, shortest, most).select("word", "n", "middle", *GROUP)
    dealt = rows.repartition(*[F.col(c) for c in GROUP]).sortWithinPartitions(*order)
    return dealt.mapInArrow(_scanned, _PAIRS)


def _roots(forms: DataFrame, largest: int) -> DataFrame:
    """(word, root) for the words with a form. A form is at least twice as frequent as its word, so
    a chain is no longer than the logarithm of the largest count, and each round doubles what is followed."""
    jumps = stored(forms.select("word", F.col("form").alias("root")), "jumps")
    longest = max(1, math.floor(math.log2(max(2, largest))))
    for _ in range(math.ceil(math.log2(longest)) + 1):
        onward = jumps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = jumps.join(onward, "root", "left")
        after = stored(after.select("word", F.coalesce("next", "root").alias("root")), "jumps")
        dropped(jumps)
        jumps = after
    return jumps


def spelling_variants(
    docs: DataFrame,
    shortest: int = SHORTEST,
    fewest: int = FEWEST,
    noise: int = NOISE,
    most: int = MOST,
    ratio: int = 2,
    **columns,
) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of ``word_counts``.

    ``form`` is the most frequent of the words at one edit (ties: the first by code points) if it comes at
    least ``ratio`` times as often, else null; ``root`` follows forms to the last one, and is the word
    itself where there is none. Nulls, empty texts and repeated rows: see ``word_counts``; repeated
    rows count as often as they come. No words give no rows. Other columns are not carried.
    """
    words = stored(word_counts(docs, shortest, fewest, noise, **columns), "words")
    pairs = near_words(words, shortest, most)
    best = F.min(F.struct((-F.col("near_n")).alias("rank"), "near")).alias("best")
    near = pairs.groupBy("word").agg(F.count("*").alias("n_near"), best)
    near = near.select("word", "n_near", F.col("best.near").alias("form"), (-F.col("best.rank")).alias("form_n"))
    joined = words.join(near, "word", "left")
    strong = F.col("form_n") >= ratio * F.col("n")
    joined = joined.select(
        "word",
        F.when(strong, F.col("form")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(strong, F.col("form_n")).alias("form_n"),
    )
    joined = stored(joined, "forms")
    largest = joined.agg(F.max("n")).first()[0] or 1
    roots = _roots(joined.where("form is not null"), largest)
    result = joined.join(roots, "word", "left")
    return result.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
