"""Suffixes of a byte text in order, with common-prefix values, by external induced sorting.

The order of the S* suffixes (those that begin an ascending run) comes from naming their substrings and
sorting the shorter text of names by the same steps, level after level. From them queues induce the
L suffixes in ascending order and then the S suffixes in descending order. On the bytes a tuple of a
queue carries a place, the seven bytes before it, and the length of the prefix that it shares with
the tuple before it; a range minimum over the values just passed gives the value of the next tuple.
Queues, texts and sorted lists write what exceeds ``limit`` rows to files of the scratch folder and read
it back in the order in which it went in, so a text may be far larger than memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

from .common import filesystem, fresh_name

GAP = 0xFE  # ends a piece; UTF-8 has no such byte
END = np.uint64(0xFF)  # after the end of a substring, larger than all bytes
LEAD = 8  # bytes before the first piece
TAIL = 128
CARRIED = 7
LOW56 = np.uint64((1 << 56) - 1)
EIGHT = np.uint64(8)
BATCH = 1 << 16
Rows = tuple[np.ndarray, ...]


class Scratch:
    """Files of one attempt in the shared scratch folder, and the rows that may stay in memory."""

    def __init__(self, folder: str, limit: int = 1 << 20):
        self.limit, self.n_files, self.store = limit, 0, None
        self.uri = f"{folder}/{fresh_name('attempt', '')}"

    def write(self, rows: Rows) -> str:
        if self.store is None:
            self.store, self.root = filesystem(self.uri)
            self.store.create_dir(self.root, recursive=True)
        self.n_files += 1
        path = f"{self.root}/{self.n_files}"
        with self.store.open_output_stream(path) as out:
            for column in rows:
                out.write(np.ascontiguousarray(column).data)
        return path

    def read(self, path: str, n: int, kinds: list) -> Rows:
        with self.store.open_input_stream(path) as file:
            return tuple(
                np.frombuffer(file.read(n * np.dtype(kind).itemsize), kind) for kind in kinds
            )

    def forget(self, path: str) -> None:
        self.store.delete_file(path)

    def close(self) -> None:
        if self.store is not None:
            self.store.delete_dir(self.root)


class Buckets:
    """A priority queue whose priority is a small number: rows of a bucket leave in the order in which
    they came. What exceeds the limit of the scratch folder lies there."""

    def __init__(self, scratch: Scratch, n: int, kinds: list):
        self.scratch, self.kinds = scratch, kinds
        self.parts: list[list] = [[] for _ in range(n)]  # rows, or (path, number of rows)
        self.held = np.zeros(n, np.int64)

    def push(self, bucket: int, rows: Rows) -> None:
        if not len(rows[0]):
            return
        self.parts[bucket].append(rows)
        self.held[bucket] += len(rows[0])
        while self.held.sum() > self.scratch.limit:
            self._spill(int(self.held.argmax()))

    def deal(self, buckets: np.ndarray, rows: Rows) -> None:
        """Push rows by bucket, keeping their order."""
        kind = np.uint8 if len(self.parts) <= 256 else np.uint16
        order = np.argsort(buckets.astype(kind), kind="stable")
        sizes = np.bincount(buckets, minlength=len(self.parts))
        ends = np.cumsum(sizes)
        rows = tuple(column[order] for column in rows)
        for b in np.flatnonzero(sizes):
            self.push(int(b), tuple(c[ends[b] - sizes[b] : ends[b]] for c in rows))

    def _spill(self, bucket: int) -> None:
        on_disk = [p for p in self.parts[bucket] if isinstance(p[0], str)]
        rows = [p for p in self.parts[bucket] if not isinstance(p[0], str)]
        rows = tuple(np.concatenate([r[k] for r in rows]) for k in range(len(self.kinds)))
        self.parts[bucket] = [*on_disk, (self.scratch.write(rows), len(rows[0]))]
        self.held[bucket] = 0

    def pop(self, bucket: int) -> Iterator[Rows]:
        """The rows of a bucket in batches; those that come meanwhile are part of it."""
        while self.parts[bucket]:
            part = self.parts[bucket].pop(0)
            if isinstance(part[0], str):
                rows = self.scratch.read(*part, self.kinds)
                self.scratch.forget(part[0])
            else:
                rows = part
                self.held[bucket] -= len(part[0])
                small = [rows]
                while self.parts[bucket] and len(small) < 64 and not isinstance(self.parts[bucket][0][0], str):
                    small.append(self.parts[bucket].pop(0))
                    self.held[bucket] -= len(small[-1][0])
                if len(small) > 1:
                    rows = tuple(np.concatenate([r[k] for r in small]) for k in range(len(rows)))
            for at in range(0, len(rows[0]), BATCH):
                yield tuple(column[at : at + BATCH] for column in rows)

    def all(self, bucket: int) -> Rows:
        parts = list(self.pop(bucket))
        if not parts:
            return tuple(np.empty(0, kind) for kind in self.kinds)
        return tuple(np.concatenate([p[k] for p in parts]) for k in range(len(self.kinds)))


class Stack:
    """Batches that leave in the reverse order."""

    def __init__(self, scratch: Scratch, kinds: list):
        self.scratch, self.kinds, self.parts, self.held = scratch, kinds, [], 0

    def push(self, rows: Rows) -> None:
        if not len(rows[0]):
            return
        self.parts.append(rows)
        self.held += len(rows[0])
        if self.held > self.scratch.limit:
            self.parts = [
                p if isinstance(p[0], str) else (self.scratch.write(p), len(p[0])) for p in self.parts
            ]
            self.held = 0

    def pop(self) -> Iterator[Rows]:
        while self.parts:
            part = self.parts.pop()
            if isinstance(part[0], str):
                yield self.scratch.read(*part, self.kinds)
                self.scratch.forget(part[0])
            else:
                yield part


class Blocks:
    """A long column in blocks of equal size that are in memory or in files; read by sorted places."""

    BLOCK = 1 << 22

    def __init__(self, scratch: Scratch, kind, block: int | None = None):
        self.scratch, self.kind, self.block = scratch, kind, block or self.BLOCK
        self.parts: list = []
        self.n = 0

    def add(self, block: np.ndarray) -> None:
        """Every block but the last has the full size."""
        self.n += len(block)
        room = self.scratch.limit * 8 // np.dtype(self.kind).itemsize
        self.parts.append(block if self.n <= room else (self.scratch.write((block,)), len(block)))

    def part(self, k: int) -> np.ndarray:
        part = self.parts[k]
        return self.scratch.read(*part, [self.kind])[0] if isinstance(part, tuple) else part

    def at(self, places: np.ndarray) -> np.ndarray:
        if len(self.parts) == 1:
            return self.part(0)[places]
        found = np.empty(len(places), self.kind)
        which = places // self.block
        for k in np.unique(which):
            here = which == k
            found[here] = self.part(k)[places[here] - k * self.block]
        return found


class Bytes:
    """The text: pieces, each followed by GAP. Blocks overlap, so that eight bytes lie in one block."""

    step, wide, digits = 8, True, 1

    def __init__(self, scratch: Scratch, block: int = 1 << 22):
        self.scratch, self.block, self.parts = scratch, block, []
        self.open = bytearray([GAP] * LEAD)
        self.n = LEAD

    def add(self, piece: bytes) -> int:
        """Add a piece; returns its place."""
        place = self.n
        self.open += piece
        self.open.append(GAP)
        self.n += len(piece) + 1
        while len(self.open) >= self.block + TAIL:
            self._keep(bytes(self.open[: self.block + TAIL]))
            del self.open[: self.block]
        return place

    def close(self) -> Bytes:
        self._keep(bytes(self.open) + bytes(TAIL))  # the end of the text is the least symbol
        self.open = bytearray()
        return self

    def _keep(self, raw: bytes) -> None:
        data = np.frombuffer(raw, np.uint8)
        room = self.scratch.limit * 8
        self.parts.append(data if self.n <= room else (self.scratch.write((data,)), len(data)))

    def part(self, k: int) -> np.ndarray:
        part = self.parts[k]
        return self.scratch.read(*part, [np.uint8])[0] if isinstance(part, tuple) else part

    @staticmethod
    def _words(data: np.ndarray, places: np.ndarray) -> np.ndarray:
        view = np.ndarray((len(data) - 7,), ">u8", data, strides=(1,))
        return view[places].astype(np.uint64)

    def words(self, places: np.ndarray) -> np.ndarray:
        """The eight bytes from each place on, the first one highest."""
        if len(self.parts) == 1:
            return self._words(self.parts[0] if isinstance(self.parts[0], np.ndarray) else self.part(0), places)
        found = np.empty(len(places), np.uint64)
        which = np.minimum(places // self.block, len(self.parts) - 1)
        for k in np.unique(which):
            here = which == k
            found[here] = self._words(self.part(k), places[here] - k * self.block)
        return found

    def cut(self, places: np.ndarray, left: np.ndarray) -> np.ndarray:
        """``words`` with END after the first ``left`` bytes."""
        words = self.words(places)
        short = left < 8
        if short.any():
            bits = (np.uint64(8) * (np.uint64(8) - left[short].astype(np.uint64))).astype(np.uint64)
            mask = np.where(bits >= 64, ~np.uint64(0), (np.uint64(1) << (bits & np.uint64(63))) - np.uint64(1))
            words[short] |= mask
        return words

    def chunks(self) -> Iterator[tuple[int, np.ndarray]]:
        """(first place, symbols) from the last block to the first, without lead and tail."""
        for k in range(len(self.parts) - 1, -1, -1):
            first = k * self.block
            stop = self.n - first if k == len(self.parts) - 1 else self.block
            skip = LEAD if k == 0 else 0
            data = self.part(k)
            for end in range(stop, skip, -BATCH):
                at = max(skip, end - BATCH)
                yield first + at, data[at:end].astype(np.int64)


class Names:
    """A text of numbers, for the levels above the bytes."""

    step, wide, digits = 1, False, 5  # five bytes hold every number

    def __init__(self, numbers: Blocks):
        self.numbers, self.n = numbers, numbers.n

    def at(self, places: np.ndarray) -> np.ndarray:
        return self.numbers.at(places)

    def cut(self, places: np.ndarray, left: np.ndarray) -> np.ndarray:
        inside = left > 0
        found = np.full(len(places), np.iinfo(np.int64).max, np.int64)
        at = places[inside]
        found[inside] = np.where(at < self.n, self.at(np.minimum(at, self.n - 1)), -1)
        return found

    def chunks(self) -> Iterator[tuple[int, np.ndarray]]:
        for k in range(len(self.numbers.parts) - 1, -1, -1):
            yield k * self.numbers.block, self.numbers.part(k)


def _starts(text, scratch: Scratch) -> Stack:
    """Places of the S* suffixes with the length of their substrings: up to the next one, which counts,
    or the end of the text. Popped in ascending order, pushed from the end."""
    found = Stack(scratch, [np.int64, np.int64])
    after, ascends, last = -1, False, text.n  # symbol and type of the place after a chunk, next S*
    waiting = None  # type of the first place of the chunk after
    for first, symbols in text.chunks():
        step = np.sign(np.append(symbols[1:], after) - symbols)
        index = np.where(step != 0, np.arange(len(symbols)), len(symbols))
        index = np.minimum.accumulate(index[::-1])[::-1]
        s_type = np.append(step, 1 if ascends else -1)[index] > 0
        if waiting is not None and waiting[0] and not s_type[-1]:
            found.push((np.array([waiting[1]]), np.array([last - waiting[1] + 1])))
            last = waiting[1]
        places = np.flatnonzero(s_type[1:] & ~s_type[:-1]) + 1 + first
        if len(places):
            ends = np.append(places[1:], last)
            found.push((places, ends - places + 1))
            last = int(places[0])
        after, ascends = int(symbols[0]), bool(s_type[0])
        waiting = (ascends, first)
    if waiting is not None and waiting[0] and text.wide:  # the bytes follow a gap, which is larger
        found.push((np.array([waiting[1]]), np.array([last - waiting[1] + 1])))
    return found


def _dense(*keys: np.ndarray) -> np.ndarray:
    """Ranks from 0 without holes, by the first key, then the second."""
    order = np.argsort(keys[0]) if len(keys) == 1 else np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for key in keys:
        ordered = key[order]
        new[1:] |= ordered[1:] != ordered[:-1]
    ranks = np.empty(len(order), np.int64)
    ranks[order] = np.cumsum(new)
    return ranks


def _named(text, places: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Ranks of substrings; equal ones share a rank."""
    levels, depth, group = [], 0, None
    while True:
        words = text.cut(places + depth, lengths - depth)
        ranks = _dense(words) if group is None else _dense(group, words)
        # A substring that ended differs from those that go on: it has END in this word.
        on = np.flatnonzero(lengths - depth >= text.step)
        levels.append((ranks, on))
        if not len(on):
            break
        places, lengths, group, depth = places[on], lengths[on], ranks[on], depth + text.step
    result = levels.pop()[0]
    while levels:
        # Ranks of a group that splits move the later groups up.
        ranks, on = levels.pop()
        firsts = np.full(ranks.max() + 2, np.iinfo(np.int64).max)
        np.minimum.at(firsts, ranks[on], result)
        lasts = np.full(ranks.max() + 2, -1)
        np.maximum.at(lasts, ranks[on], result)
        more = np.where(lasts >= 0, lasts - firsts, 0)
        whole = ranks + (np.cumsum(more) - more)[ranks]
        whole[on] += result - firsts[ranks[on]]
        result = whole
    return result


def _sorted_substrings(text, rows: Iterator[Rows], scratch: Scratch) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(number, name, how many names end here) in the order of the substrings of (number, place, length).

    Names count on from those that ended before. Rows that exceed memory are dealt by their next symbol.
    """
    waiting = [(rows, 0)]
    while waiting:
        rows, depth = waiting.pop()
        held, size, dealt = [], 0, None
        for batch in rows:
            if depth // text.digits > batch[2][0]:  # agree up to their end
                held.append(None)
                yield batch[0], np.zeros(len(batch[0]), np.int64), 0
                continue
            if dealt is None and size + len(batch[0]) <= scratch.limit:
                held.append(batch)
                size += len(batch[0])
                continue
            if dealt is None:
                dealt = Buckets(scratch, 256, [np.int64] * 3)
                for earlier in held:
                    dealt.deal(_symbol(text, earlier, depth), earlier)
                held = []
            dealt.deal(_symbol(text, batch, depth), batch)
        if dealt is not None:
            waiting += [(dealt.pop(b), depth + 1) for b in range(255, -1, -1) if dealt.parts[b]]
        elif held and held[0] is None:
            yield np.empty(0, np.int64), np.empty(0, np.int64), 1
        elif held:
            numbers, places, lengths = (np.concatenate([h[k] for h in held]) for k in range(3))
            names = _named(text, places, lengths)
            yield numbers, names, int(names.max()) + 1


def _symbol(text, rows: Rows, depth: int) -> np.ndarray:
    """The bucket of rows that agree in all buckets before."""
    _, places, lengths = rows
    if text.wide:
        words = text.cut(places + depth, lengths - depth)
        return (words >> np.uint64(56)).astype(np.int64)
    # Names: digits of the numbers, eight bits at a time, from the highest one.
    offset, digit = depth // text.digits, text.digits - 1 - depth % text.digits
    names = text.cut(places + offset, lengths - offset)
    found = np.where(names == np.iinfo(np.int64).max, (1 << 40) - 1, names + 1)
    return (found >> (8 * digit)) & 255


def _reduced(text, scratch: Scratch) -> tuple[Blocks, Blocks, bool, int]:
    """Places of the S* suffixes in text order, their names, whether names are unique, and how many."""
    places_of = Blocks(scratch, np.int64)
    lengths_of = Blocks(scratch, np.int64)
    _in_blocks(_starts(text, scratch).pop(), (places_of, lengths_of))
    n = places_of.n
    numbers = Buckets(scratch, max(1, -(-n // Blocks.BLOCK)), [np.int64, np.int64])

    def rows() -> Iterator[Rows]:
        for k in range(len(places_of.parts)):
            places, lengths = places_of.part(k), lengths_of.part(k)
            for at in range(0, len(places), BATCH):
                chosen = places[at : at + BATCH]
                first = k * places_of.block + at
                yield np.arange(first, first + len(chosen)), chosen, lengths[at : at + BATCH]

    names = 0
    for number, name, ended in _sorted_substrings(text, rows(), scratch):
        numbers.deal(number // Blocks.BLOCK, (number, name + names))
        names += ended
    named = Blocks(scratch, np.int64)
    for b in range(len(numbers.parts)):
        number, name = numbers.all(b)
        block = np.empty(len(number), np.int64)
        block[number - b * Blocks.BLOCK] = name
        if len(block):
            named.add(block)
    return places_of, named, names == n, names


def _in_blocks(batches: Iterator[Rows], columns: tuple[Blocks, ...]) -> None:
    held, size, block = [], 0, columns[0].block
    for batch in batches:
        held.append(batch)
        size += len(batch[0])
        while size >= block:
            joined = tuple(np.concatenate([h[k] for h in held]) for k in range(len(columns)))
            for column, values in zip(columns, joined, strict=True):
                column.add(values[:block])
            held, size = [tuple(values[block:] for values in joined)], size - block
    if size:
        for k, column in enumerate(columns):
            column.add(np.concatenate([h[k] for h in held]))


def _in_order(numbers: Blocks, scratch: Scratch, n_names: int) -> Iterator[np.ndarray]:
    """Numbers of places by name, where names are unique."""
    width = max(1, -(-n_names // max(1, n_names // BATCH)))
    dealt = Buckets(scratch, -(-n_names // width) or 1, [np.int64, np.int64])
    for k in range(len(numbers.parts)):
        names = numbers.part(k)
        for at in range(0, len(names), BATCH):
            chosen = names[at : at + BATCH]
            first = k * numbers.block + at
            dealt.deal(chosen // width, (chosen, np.arange(first, first + len(chosen))))
    for b in range(len(dealt.parts)):
        names, places = dealt.all(b)
        if len(names):
            found = np.empty(len(names), np.int64)
            found[names - b * width] = places
            yield found


def _sorted_names(numbers: Blocks, scratch: Scratch, unique: bool, n_names: int) -> Iterator[np.ndarray]:
    """Places of a text of names in the order of their suffixes."""
    if unique:
        yield from _in_order(numbers, scratch, n_names)
        return
    text = Names(numbers)
    places_of, above, done, count = _reduced(text, scratch)
    seeds = (places_of.at(chosen) for chosen in _sorted_names(above, scratch, done, count)) if above.n else iter(())
    ascending = Stack(scratch, [np.int64])
    for places, induced in _induced_names(text, _with_symbol(text, seeds), scratch, 1, n_names):
        ascending.push((places[induced],))
    reverse = (batch[0][::-1] for batch in ascending.pop())
    whole = Stack(scratch, [np.int64])
    for places, _ in _induced_names(text, _with_symbol(text, reverse), scratch, -1, n_names):
        whole.push((places,))
    for batch in whole.pop():
        yield batch[0][::-1]


def _with_symbol(text: Names, batches: Iterator[np.ndarray]) -> Iterator[Rows]:
    for places in batches:
        if len(places):
            yield text.at(places), places


def _induced_names(
    text: Names, seeds: Iterator[Rows], scratch: Scratch, sign: int, n_names: int
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, which of them are induced) in ascending order, or with ``sign`` -1 descending.

    The queue holds (symbol, rank of the suffix after, place) by ranges of symbols. A range is
    opened as a whole: suffixes that it induces within itself take their rank from their source, until
    the order stands still.
    """
    width = max(1, -(-n_names // max(1, min(60_000, text.n // (1 << 15)))))
    n_ranges = -(-n_names // width)
    queue = Buckets(scratch, n_ranges, [np.int64] * 3)
    base, pending = 0, None
    if sign > 0:  # the empty suffix comes first and induces the last place
        last = np.array([text.n - 1])
        queue.deal(text.at(last) // width, (text.at(last), np.array([-1]), last))
    for step in range(n_ranges):
        b = step if sign > 0 else n_ranges - 1 - step
        low, high = b * width, min((b + 1) * width, n_names)
        symbol, key, place = queue.all(b)
        sown, pending = _seeds_in(seeds, pending, low, high)
        induced = np.ones(len(symbol) + len(sown[0]), bool)
        induced[len(symbol) :] = False
        key = np.concatenate([key, np.arange(len(sown[0]))])
        symbol, place = np.concatenate([symbol, sown[0]]), np.concatenate([place, sown[1]])
        source = np.full(len(symbol), -1)
        fresh, leaving = np.arange(len(symbol)), []
        while len(fresh):
            fresh = fresh[place[fresh] > 0]
            before = text.at(place[fresh] - 1) if len(fresh) else np.empty(0, np.int64)
            more = sign * before > sign * symbol[fresh]
            more |= induced[fresh] & (before == symbol[fresh])
            fresh, before = fresh[more], before[more]
            within = (before >= low) & (before < high)
            leaving.append((before[~within], fresh[~within]))
            fresh, before = fresh[within], before[within]
            n = len(symbol)
            symbol, place = np.concatenate([symbol, before]), np.concatenate([place, place[fresh] - 1])
            source, key = np.concatenate([source, fresh]), np.concatenate([key, np.full(len(fresh), base)])
            induced = np.concatenate([induced, np.ones(len(fresh), bool)])
            fresh = np.arange(n, len(symbol))
        if not len(symbol):
            continue
        made = np.flatnonzero(source >= 0)
        relative = symbol - low if sign > 0 else high - 1 - symbol
        fixed = (relative << 41) | (~induced).astype(np.int64) << 40
        rank = np.empty(len(symbol), np.int64)
        while True:
            order = np.argsort(fixed + key + 1)
            rank[order] = np.arange(base, base + len(order))
            after = rank[source[made]]
            if not len(made) or (after == key[made]).all():
                break
            key[made] = after
        for before, from_ in leaving:
            if len(before):
                queue.deal(before // width, (before, rank[from_], place[from_] - 1))
        base += len(order)
        yield place[order], induced[order]


def _seeds_in(seeds: Iterator[Rows], pending: Rows | None, low: int, high: int) -> tuple[Rows, Rows | None]:
    """The next seeds whose symbol lies in a range, and what was read beyond it."""
    found = []
    while True:
        if pending is None:
            pending = next(seeds, None)
            if pending is None:
                break
        inside = (pending[0] >= low) & (pending[0] < high)
        n = len(inside) if inside.all() else int(inside.argmin())
        found.append(tuple(column[:n] for column in pending))
        if n < len(inside):
            pending = tuple(column[n:] for column in pending)
            break
        pending = None
    if not found:
        return (np.empty(0, np.int64), np.empty(0, np.int64)), pending
    return tuple(np.concatenate([f[k] for f in found]) for k in range(2)), pending


def _shared(text: Bytes, left: np.ndarray, right: np.ndarray, cap: int) -> np.ndarray:
    """Length of the common prefix of suffixes, at most ``cap``."""
    found = np.zeros(len(left), np.int64)
    on = np.arange(len(left))
    while len(on):
        depth = int(found[on[0]])
        differ = text.words(np.minimum(left[on] + depth, text.n)) ^ text.words(
            np.minimum(right[on] + depth, text.n)
        )
        same = differ == 0
        rest = differ[~same]
        equal = sum((rest < np.uint64(1 << (8 * k))).astype(np.int64) for k in range(1, 8))
        found[on[~same]] += equal
        found[on[same]] += 8
        on = on[same]
        on = on[found[on] < cap]
    return np.minimum(found, cap)


def _minima(values: np.ndarray) -> list[np.ndarray]:
    table, span = [values], 1
    while 2 * span <= len(values):
        table.append(np.minimum(table[-1][:-span], table[-1][span:]))
        span *= 2
    return table


def _between(table: list[np.ndarray], first: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Minimum of the values from ``first`` to before ``stop``, which lies after it."""
    level = np.frexp((stop - first).astype(np.float64))[1] - 1
    found = np.empty(len(first), np.int64)
    for k in np.unique(level):
        here = level == k
        rows = table[k]
        found[here] = np.minimum(rows[first[here]], rows[stop[here] - (1 << k)])
    return found


class _Induction:
    """One sweep over the bytes: ascending with ``sign`` 1, descending with -1."""

    KINDS = [np.int64, np.uint64, np.uint8]

    def __init__(self, text: Bytes, scratch: Scratch, sign: int, cap: int):
        self.text, self.sign, self.cap = text, sign, cap
        self.queue = Buckets(scratch, 256, self.KINDS)
        self.since = np.full(256, -1)  # least value since a bucket got its last tuple

    def start(self) -> None:
        """The empty suffix induces the last place."""
        last = np.array([self.text.n - 1])
        symbol = int(self.text.words(last)[0] >> np.uint64(56))
        self.queue.push(symbol, (last, self.before(last), np.zeros(1, np.uint8)))
        self.since[symbol] = 0

    def before(self, places: np.ndarray) -> np.ndarray:
        """The seven bytes before each place, and their number in the highest byte."""
        return (self.text.words(places - 8) & LOW56) | np.uint64(CARRIED << 56)

    def pass_on(self, symbol: int, rows: Rows, induced: bool) -> Rows:
        """Induce what stands before a batch of tuples in order."""
        places, carried, common = rows
        empty = carried >> np.uint64(56) == 0
        if empty.any():
            carried = carried.copy()
            carried[empty] = self.before(places[empty])
        previous = (carried & np.uint64(255)).astype(np.int64)
        signed, own = self.sign * previous, self.sign * symbol
        chosen = (signed >= own) if induced else (signed > own)
        chosen &= places > LEAD
        index = np.flatnonzero(chosen)
        table = _minima(common)
        least = int(common.min())
        if not len(index):
            self.since = np.minimum(self.since, least)
            return places, carried, common
        symbols = previous[index]
        order = np.argsort(symbols.astype(np.uint8), kind="stable")
        index, symbols = index[order], symbols[order]
        new = np.append(True, symbols[1:] != symbols[:-1])
        first = np.where(new, 0, np.append(0, index[:-1] + 1))
        value = _between(table, first, index + 1)
        value[new] = np.minimum(value[new], self.since[symbols[new]])
        common_of = np.minimum(value + 1, self.cap).astype(np.uint8)
        lasts = index[np.append(new[1:], True)]
        after = np.full(len(lasts), self.cap)
        inner = lasts + 1 < len(common)
        if inner.any():
            after[inner] = _between(table, lasts[inner] + 1, np.full(inner.sum(), len(common)))
        self.since = np.minimum(self.since, least)
        self.since[symbols[new]] = after
        kept = carried[index]
        moved = ((kept & LOW56) >> EIGHT) | ((kept >> np.uint64(56)) - np.uint64(1)) << np.uint64(56)
        starts = np.append(np.flatnonzero(new), len(index))
        before = places[index] - 1
        for k, at in enumerate(starts[:-1]):
            stop = starts[k + 1]
            self.queue.push(int(symbols[at]), (before[at:stop], moved[at:stop], common_of[at:stop]))
        return places, carried, common

    def run(self, seeds: Iterator[tuple[int, Rows]]) -> Iterator[tuple[int, Rows, bool]]:
        """(symbol, tuples, whether induced) in order; seeds of a symbol come after what is induced."""
        seed = next(seeds, None)
        for step in range(256):
            symbol = step if self.sign > 0 else 255 - step
            last = None
            for rows in self.queue.pop(symbol):
                if last is None:
                    rows = (rows[0], rows[1], _first(rows[2], 0))
                last = int(rows[0][-1])
                yield symbol, self.pass_on(symbol, rows, True), True
            while seed is not None and seed[0] == symbol:
                rows, joined = seed[1], 0
                if last is not None and seed[2]:
                    joined = int(_shared(self.text, np.array([last]), rows[0][:1], self.cap)[0])
                if seed[2]:
                    rows = (rows[0], rows[1], _first(rows[2], joined))
                yield symbol, self.pass_on(symbol, rows, False), False
                seed = next(seeds, None)


def _first(values: np.ndarray, value: int) -> np.ndarray:
    values = values.copy()
    values[0] = value
    return values


def _by_symbol(batches: Iterator[Rows], text: Bytes) -> Iterator[tuple[int, Rows, bool]]:
    """Batches cut where the first byte changes: (symbol, tuples, whether the symbol is new)."""
    before = -1
    for rows in batches:
        symbols = (text.words(rows[0]) >> np.uint64(56)).astype(np.int64)
        cuts = np.flatnonzero(np.append(True, symbols[1:] != symbols[:-1]))
        for at, stop in zip(cuts, np.append(cuts[1:], len(symbols)), strict=True):
            yield int(symbols[at]), tuple(c[at:stop] for c in rows), symbols[at] != before
            before = symbols[at]


def sorted_suffixes(
    text: Bytes, scratch: Scratch, cap: int, seen: Callable | None = None
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, lengths of the prefix shared with the suffix before, at most ``cap``), descending.

    The value of the first suffix is 0. Values are exact for suffixes that share no gap.
    """
    places_of, names, unique, count = _reduced(text, scratch)
    ascending = _Induction(text, scratch, 1, cap)

    def star() -> Iterator[Rows]:
        last = None
        for numbers in _sorted_names(names, scratch, unique, count) if names.n else ():
            places = places_of.at(numbers)
            left = np.append(places[:1] if last is None else last, places[:-1])
            common = _shared(text, left, places, cap).astype(np.uint8)
            last = places[-1:]
            yield places, ascending.before(places), common

    ascending.start()
    # Each tuple of the stack has the value shared with the one before it; read backwards, the
    # value belongs to the neighbour.
    found = Stack(scratch, _Induction.KINDS)
    for _, rows, induced in ascending.run(_by_symbol(star(), text)):
        if induced:
            found.push(rows)

    def backwards() -> Iterator[Rows]:
        carry = np.zeros(1, np.uint8)
        for places, before, common in found.pop():
            turned = common[::-1]
            yield places[::-1], before[::-1], np.append(carry, turned[:-1])
            carry = turned[-1:]

    descending = _Induction(text, scratch, -1, cap)
    for _, (places, _, common), _ in descending.run(_by_symbol(backwards(), text)):
        yield places, common
