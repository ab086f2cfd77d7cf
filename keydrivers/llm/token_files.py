"""Token ids in binary files of independent zstandard frames with a trailing seek table.

One file:

* frames: little-endian unsigned 32-bit ids, one document after the other, each frame compressed on
  its own and with zstandard's checksum of its content;
* a skippable frame (0x184D2A50): number of documents, then their ids, a byte for each that says
  whether the id is null, and their numbers of tokens, compressed;
* a skippable frame (0x184D2A5E) with the seek table of the public seekable format: compressed size,
  size and checksum of each frame, then the number of frames, a flag byte and 0x8F92EAB1.

Any zstandard reader can decompress such a file. A reader that wants some documents reads the tail,
finds the frames that hold them, and decompresses only those.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keydrivers.sources import scratch_dir

from .bpe import _class_of, library, public, vocabulary
from .common import BoundedCache, as_texts, filesystem, fresh_name, picked, slices, stored

# Fixed values of the seekable format.
SKIPPABLE, SEEK_SKIPPABLE, SEEK_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
CHECKSUM_FLAG = 0x80

FRAME_TOKENS = 1 << 16
CACHE = 400_000
WORDS_IN_A_TEXT = 200

# The word pattern of the vocabulary file, with classes to fill in.
WORD = re.compile(
    "'s|'t|'re|'ve|'m|'ll|'d|[{L}]+|[{N}]|[^\\s{L}{N}]+".format(L=_class_of("L"), N=_class_of("N"))
)
# Texts on which Python and the library could differ: other scripts, combining marks, odd white
# space, the capital that becomes two letters, and whatever may begin a special string.
UNCOMMON = re.compile("[\\x00-\\x08\\x0e-\\x1f\\x7f-\\xa0\\xad\\u0130\\u0180-\\U0010ffff]|<\\|")
# The same for Arrow, which looks through a column at once.
UNCOMMON_RE2 = "[\\x00-\\x08\\x0e-\\x1f\\x7f-\\x{a0}\\x{ad}\\x{130}\\x{180}-\\x{10ffff}]|<\\|"


class WordBpe:
    """Ids as bytes, from a table of words that the library has encoded.

    For texts of common characters the library's lower-casing and words are Python's. Words not in
    the table are given to the library together; the others go to it as whole texts.
    """

    def __init__(self, blob: bytes):
        self.library = library(blob)
        vocab = self.library.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.ends[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        self.of_word = BoundedCache(self.whole, CACHE)

    def whole(self, text: str) -> bytes:
        ids = self.library.encode(text, add_special_tokens=False).ids
        return np.array(ids, dtype="<u4").tobytes()

    def learn(self, words: set[str]) -> None:
        """Encode words in runs, and cut the ids after those that end a word."""
        todo = list(words - self.of_word.keys())
        if len(todo) + len(self.of_word) > CACHE:
            self.of_word.clear()
            todo = list(words)
        runs = [todo[i : i + WORDS_IN_A_TEXT] for i in range(0, len(todo), WORDS_IN_A_TEXT)]
        joined = [" ".join(run) for run in runs]
        encoded = self.library.encode_batch_fast(joined, add_special_tokens=False)
        for run, found in zip(runs, encoded, strict=True):
            ids = np.array(found.ids, dtype="<u4")
            cuts = [0, *(4 * np.flatnonzero(self.ends[ids]) + 4).tolist()]
            if len(cuts) == len(run) + 1 and cuts[-1] == ids.nbytes:
                raw = ids.tobytes()
                pieces = [raw[i:k] for i, k in zip(cuts, cuts[1:], strict=False)]
            else:
                pieces = [self.whole(word) for word in run]
            self.of_word.update(zip(run, pieces, strict=True))

    def encode(self, texts: list[str], uncommon: list[bool] | None = None) -> list[bytes]:
        """``uncommon``: whether UNCOMMON is found in each text, where the caller knows."""
        if uncommon is None:
            uncommon = [bool(UNCOMMON.search(x)) for x in texts]
        words = [None if odd else WORD.findall(x.lower()) for x, odd in zip(texts, uncommon, strict=True)]
        self.learn(set().union(*[found for found in words if found]))
        known = self.of_word.__getitem__
        return [
            self.whole(text) if found is None else b"".join(map(known, found))
            for text, found in zip(texts, words, strict=True)
        ]


@lru_cache(maxsize=4)
def word_bpe(blob: bytes) -> WordBpe:
    return WordBpe(blob)


def _checksum(raw: bytes) -> int:
    return xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF


class Writer:
    """Write one file, document by document. A frame ends with the document that fills it; a longer
    document is cut over several frames."""

    def __init__(self, sink, frame_tokens: int = FRAME_TOKENS, level: int = 3):
        self.sink, self.limit = sink, 4 * frame_tokens
        self.pack = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.buffer, self.frames = bytearray(), []
        self.ids: list[int | None] = []
        self.counts: list[int] = []

    def add(self, doc_id: int | None, tokens: bytes) -> None:
        self.ids.append(doc_id)
        self.counts.append(len(tokens) // 4)
        self.buffer += tokens
        while len(self.buffer) >= 2 * self.limit:
            self._frame(self.limit)
        if len(self.buffer) >= self.limit:
            self._frame(len(self.buffer))

    def _frame(self, size: int) -> None:
        raw = bytes(self.buffer[:size])
        del self.buffer[:size]
        packed = self.pack.compress(raw)
        self.sink.write(packed)
        self.frames.append((len(packed), len(raw), _checksum(raw)))

    def close(self) -> None:
        if self.buffer:
            self._frame(len(self.buffer))
        nulls = np.array([i is None for i in self.ids], dtype=np.uint8)
        ids = np.array([i or 0 for i in self.ids], dtype="<i8")
        index = struct.pack("<Q", len(ids)) + ids.tobytes() + nulls.tobytes()
        index = self.pack.compress(index + np.array(self.counts, dtype="<i8").tobytes())
        self.sink.write(struct.pack("<II", SKIPPABLE, len(index)) + index)
        rows = b"".join(struct.pack("<III", *f) for f in self.frames)
        foot = struct.pack("<IBI", len(self.frames), CHECKSUM_FLAG, SEEK_MAGIC)
        self.sink.write(struct.pack("<II", SEEK_SKIPPABLE, len(rows) + len(foot)) + rows + foot)


@dataclass
class TokenFile:
    """Reader of one file; ``source`` is an open random-access file."""

    source: object

    def __post_init__(self):
        size = self.source.size()
        foot = self._read(size - 9, 9)
        frames, flags, magic = struct.unpack("<IBI", foot)
        if magic != SEEK_MAGIC or not flags & CHECKSUM_FLAG:
            raise ValueError("no seek table with checksums")
        rows = self._read(size - 9 - 12 * frames, 12 * frames)
        self.table = np.frombuffer(rows, dtype="<u4").reshape(-1, 3).astype(np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.table[:, 0])])
        self.starts = np.concatenate([[0], np.cumsum(self.table[:, 1])])
        magic, length = struct.unpack("<II", self._read(int(self.at[-1]), 8))
        if magic != SKIPPABLE:
            raise ValueError("no index of documents")
        self.unpack = zstandard.ZstdDecompressor()
        index = self.unpack.decompress(self._read(int(self.at[-1]) + 8, length))
        n = struct.unpack_from("<Q", index)[0]
        self.ids = np.frombuffer(index, "<i8", n, 8)
        self.null = np.frombuffer(index, np.uint8, n, 8 + 8 * n).astype(bool)
        self.counts = np.frombuffer(index, "<i8", n, 8 + 9 * n)
        self.offsets = np.concatenate([[0], np.cumsum(self.counts)])

    def _read(self, start: int, size: int) -> bytes:
        self.source.seek(start)
        return self.source.read(size)

    def frame(self, k: int) -> bytes:
        packed, size, checksum = (int(x) for x in self.table[k])
        raw = self.unpack.decompress(self._read(int(self.at[k]), packed), max_output_size=size)
        if len(raw) != size or _checksum(raw) != checksum:
            raise ValueError(f"frame {k} is damaged")
        return raw

    def read(self, position: int) -> bytes:
        """Ids of the document at a position of the file; decompresses only frames that hold it."""
        lo, hi = 4 * int(self.offsets[position]), 4 * int(self.offsets[position + 1])
        if lo == hi:
            return b""
        first = int(np.searchsorted(self.starts, lo, side="right")) - 1
        last = int(np.searchsorted(self.starts, hi, side="left"))
        raw = b"".join(map(self.frame, range(first, last)))
        return raw[lo - int(self.starts[first]) : hi - int(self.starts[first])]

    def documents(self) -> Iterator[tuple[int | None, int, bytes]]:
        """(id, position of its first token in the file, ids) of all documents, frame by frame."""
        frames, buffer, start = iter(range(len(self.table))), b"", 0
        for k in range(len(self.ids)):
            size = 4 * int(self.counts[k])
            parts, have = [buffer[start:]], len(buffer) - start
            if have < size:
                while have < size:
                    parts.append(self.frame(next(frames)))
                    have += len(parts[-1])
                buffer, start = b"".join(parts), 0
            yield (
                None if self.null[k] else int(self.ids[k]),
                int(self.offsets[k]),
                buffer[start : start + size],
            )
            start += size


MANIFEST = "part int, path string, n_docs bigint, n_tokens bigint, n_bytes bigint"


def write_tokens(
    docs: DataFrame,
    vocab: str | None = None,
    end_id: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Encode every text, append ``end_id``, and write files in ascending order of the ids.

    Returns the manifest, one row for each file: part, path, n_docs, n_tokens, n_bytes, base (tokens
    in the files before it). Ids go up from file to file and within each, nulls first. A null text
    counts as empty: only the end id. Repeated rows are written as often as they come, in any order
    among themselves. Other columns are not carried. Without rows there is no file.
    """
    spark = docs.sparkSession
    blob = vocabulary(spark, vocab or public("word_bpe_49k.json"))
    folder = scratch_dir(spark, "tokens")
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(blob.value)
        store, root = filesystem(folder)
        part = TaskContext.get().partitionId()
        path, sink = None, None
        for batch in slices(batches, "text"):
            if sink is None:
                name = fresh_name(f"part-{part:06d}", ".zst")
                store.create_dir(root, recursive=True)
                path, sink = f"{folder}/{name}", store.open_output_stream(f"{root}/{name}", None)
                writer = Writer(sink)
            texts = batch.column("text")
            uncommon = pc.match_substring_regex(texts, UNCOMMON_RE2).to_pylist()
            encoded = bpe.encode(as_texts(texts), uncommon)
            for doc_id, tokens in zip(batch.column("doc_id").to_pylist(), encoded, strict=True):
                writer.add(doc_id, tokens + end)
        if sink is not None:
            writer.close()
            size = sink.tell()
            sink.close()
            row = [[part], [path], [len(writer.ids)], [sum(writer.counts)], [size]]
            types = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            arrays = [pa.array(v, t) for v, t in zip(row, types, strict=True)]
            yield pa.RecordBatch.from_arrays(
                arrays, ["part", "path", "n_docs", "n_tokens", "n_bytes"]
            )

    rows = picked(docs, doc_id=id_col, text=text_col)
    rows = rows.withColumn("doc_id", F.col("doc_id").cast("bigint"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    manifest = stored(ordered.mapInArrow(run, MANIFEST), "token-manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each file: few, and short, next to what the files hold.
    return manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def _opened(path: str) -> TokenFile:
    store, at = filesystem(path)
    return TokenFile(store.open_input_file(at))


READ = "doc_id bigint, path string, position bigint, start bigint, n_tokens bigint, tokens binary"


def read_tokens(manifest: DataFrame) -> DataFrame:
    """Every document of the files, frame by frame, with checksums verified: doc_id, path, position
    in the file, start (tokens of all documents before it), n_tokens, tokens (the bytes of ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(*(batch.column(c).to_pylist() for c in ("path", "base")), strict=True):
                rows, held = [], 0
                for k, (doc_id, start, tokens) in enumerate(_opened(path).documents()):
                    rows.append((doc_id, path, k, base + start, len(tokens) // 4, tokens))
                    held += len(tokens)
                    if held > 1 << 22:
                        yield _read_batch(rows)
                        rows, held = [], 0
                yield _read_batch(rows)

    return _spread(manifest).mapInArrow(run, READ)


def read_documents(wanted: DataFrame) -> DataFrame:
    """doc_id and tokens for rows of (doc_id, path, position), as ``read_tokens`` gives them:
    decompresses the frames that hold them and no others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, file = None, None
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                if row["path"] != path:
                    path, file = row["path"], _opened(row["path"])
                rows.append((row["doc_id"], file.read(row["position"])))
            ids, tokens = zip(*rows, strict=True) if rows else ((), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(tokens, pa.binary())], ["doc_id", "tokens"]
            )

    near = wanted.select("doc_id", "path", "position").sortWithinPartitions("path", "position")
    return near.mapInArrow(run, "doc_id bigint, tokens binary")


def _read_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 6
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    arrays = [pa.array(v, t) for v, t in zip(columns, types, strict=True)]
    names = ["doc_id", "path", "position", "start", "n_tokens", "tokens"]
    return pa.RecordBatch.from_arrays(arrays, names)


def _spread(manifest: DataFrame) -> DataFrame:
    """One file to a task, as far as partitions go."""
    spark: SparkSession = manifest.sparkSession
    slots = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    return manifest.select("part", "path", "base").repartition(slots, "part")


def checksums(read: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of the ids."""
    crc = F.crc32("tokens").alias("ids_crc32")
    return read.select("doc_id", "start", "n_tokens", crc)


