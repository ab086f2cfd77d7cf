"""Web archives with a two-level capture index.

Records are written in the order of their keys (host labels from the last to the first, then the
path), one gzip member each, so that neighbours of an address lie together. Next to each archive
stands an index file: captures in key order in compressed blocks, then a sparse directory with the
first key of each block, then its place. A reader bisects the files by their first keys, the
directory of one file, and one block, and then reads the ranges of the records it wants.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keydrivers.sources import scratch_dir

from .common import filesystem, fresh_name, letters, on_executors, picked, slices, stored

BLOCK = 1000
FILES_AT_ONCE = 50_000
BATCH_BYTES = 4 << 20
READ_BYTES = 32 << 20
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PAGE = "urn:x-page:"


def capture_key(url: Column) -> Column:
    """Host labels in reverse order, a bracket, and the rest of the address after the host."""
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*(.*)$", 1)
    host = F.lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1))
    labels = F.array_join(F.reverse(F.split(host, r"\.")), ",")
    return F.concat(labels, F.lit(")"), rest)


def with_types(
    pages: DataFrame,
    smallest: int = 1000,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
) -> DataFrame:
    """page_id, url, key, payload, digest (hex SHA-1), record_type and refers_to of every row.

    Of rows with equal payloads of at least ``smallest`` bytes those with the largest id are
    responses, the others revisit it. A null payload is an empty one, a null address an empty one.
    A row without an id revisits a row that has one; among rows without ids all are responses.
    """
    rows = picked(pages, page_id=id_col, url=url_col, html=html_col)
    payload = letters(F.col("html")).cast("binary")
    rows = rows.select(
        F.col("page_id").cast("bigint"),
        letters(F.col("url")).alias("url"),
        payload.alias("payload"),
        F.sha1(payload).alias("digest"),
    )
    large = rows.where(F.octet_length("payload") >= smallest)
    groups = large.groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n"))
    # Payloads that come once need no partner; stored, the others have a known size, so that Spark
    # broadcasts them only if they are few.
    shared = stored(groups.where("n > 1 and first is not null").select("digest", "first"), "shared")
    joined = rows.join(shared, "digest", "left")
    revisit = F.coalesce(
        F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id")), F.lit(False)
    )
    return joined.select(
        "page_id",
        "url",
        capture_key(F.col("url")).alias("key"),
        "payload",
        "digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("first")).alias("refers_to"),
    )


def _record(row: dict, date: str) -> bytes:
    """One record: named fields, then the HTTP message; a revisit has the head of it alone."""
    digest = base64.b32encode(bytes.fromhex(row["digest"])).decode()
    page, head = row["page_id"], HTTP % len(row["payload"])
    revisit = row["record_type"] == "revisit"
    block = head if revisit else head + row["payload"]
    name = f"{PAGE}{page}" if page is not None else f"urn:uuid:{uuid.uuid4()}"
    fields = {
        "WARC-Type": row["record_type"],
        "WARC-Record-ID": f"<{name}>",
        "WARC-Date": date,
        "WARC-Target-URI": _one_line(row["url"]),
        "Content-Type": "application/http; msgtype=response",
        "WARC-Payload-Digest": f"sha1:{digest}",
        "Content-Length": str(len(block)),
    }
    if revisit:
        fields["WARC-Profile"] = PROFILE
        fields["WARC-Refers-To"] = f"<{PAGE}{row['refers_to']}>"
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields.items())
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


def _one_line(url: str) -> str:
    return "".join(f"%{ord(c):02X}" if c < " " or c == "\x7f" else c for c in url)


def parsed(raw: bytes) -> dict:
    """Fields and payload of a record; the digest of a full payload is verified."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(http.rpartition(b"Content-Length: ")[2])
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
    return {
        "page_id": _page(fields["WARC-Record-ID"]),
        "url": fields["WARC-Target-URI"],
        "record_type": fields["WARC-Type"],
        "payload_bytes": size,
        "payload_digest": digest,
        "refers_to": _page(fields.get("WARC-Refers-To", "")),
        "payload": None if revisit else payload,
    }


def _page(name: str) -> int | None:
    found = name.strip("<>")
    return int(found.removeprefix(PAGE)) if found.startswith(PAGE) else None


@dataclass
class _IndexWriter:
    sink: object
    directory: list = field(default_factory=list)
    lines: list = field(default_factory=list)
    at: int = 0
    n: int = 0
    first: str = ""
    last: str = ""

    def add(self, key: str, page: int | None, offset: int, length: int) -> None:
        self.first = key if not self.n else self.first
        self.last, self.n = key, self.n + 1
        self.lines.append(json.dumps([key, page, offset, length]))
        if len(self.lines) == BLOCK:
            self.flush()

    def flush(self) -> None:
        if self.lines:
            packed = zlib.compress("\n".join(self.lines).encode())
            key = json.loads(self.lines[0])[0]
            self.directory.append([key, self.at, len(packed)])
            self.sink.write(packed)
            self.at += len(packed)
            self.lines = []

    def close(self) -> None:
        self.flush()
        packed = zlib.compress(json.dumps([self.last, self.directory]).encode())
        self.sink.write(packed + struct.pack("<QQ", self.at, len(packed)))
        self.sink.close()


class Index:
    """Reader of one index file."""

    def __init__(self, path: str):
        store, at = filesystem(path)
        self.file = store.open_input_file(at)
        start, size = struct.unpack("<QQ", self._read(self.file.size() - 16, 16))
        self.last, self.directory = json.loads(zlib.decompress(self._read(start, size)))
        self.keys = [key for key, _, _ in self.directory]
        self.at: int | None = None

    def _read(self, start: int, size: int) -> bytes:
        self.file.seek(start)
        return self.file.read(size)

    def block(self, k: int) -> list[list]:
        _, start, size = self.directory[k]
        raw = zlib.decompress(self._read(start, size)).decode()
        return [json.loads(line) for line in raw.split("\n")]

    def find(self, key: str) -> Iterator[list]:
        """The captures of a key: from the last block that begins before it, as long as they last.

        The last block is kept, as keys that are asked for in order mostly lie in the same one.
        """
        k = max(bisect.bisect_left(self.keys, key) - 1, 0)
        while k < len(self.keys) and self.keys[k] <= key:
            if self.at != k:
                self.at, self.lines = k, self.block(k)
                self.line_keys = [line[0] for line in self.lines]
            found = bisect.bisect_left(self.line_keys, key), bisect.bisect_right(self.line_keys, key)
            yield from self.lines[found[0] : found[1]]
            k += 1


MANIFEST = (
    "part int, warc string, index string, n_records bigint, n_blocks bigint, n_bytes bigint, "
    "first_key string, last_key string"
)


def write_archives(pages: DataFrame, date: str = "2024-01-01T00:00:00Z", **columns) -> DataFrame:
    """Write a record for every row and index them; returns the manifest, one row for each archive.

    See ``with_types`` for nulls and equal payloads. Repeated rows are written as often as they come.
    Without rows there is no archive. A task that runs twice writes two pairs of files; the manifest
    names one of them. Other columns are not carried.
    """
    spark = pages.sparkSession
    on_executors(spark)
    folder = scratch_dir(spark, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = filesystem(folder)
        part, sink, offset = TaskContext.get().partitionId(), None, 0
        for batch in slices(batches, "payload"):
            if sink is None:
                stem = fresh_name(f"part-{part:06d}", "")
                store.create_dir(root, recursive=True)
                sink = store.open_output_stream(f"{root}/{stem}.warc.gz", None)
                index = _IndexWriter(store.open_output_stream(f"{root}/{stem}.index", None))
            for row in batch.to_pylist():
                packed = gzip.compress(_record(row, date), 6, mtime=0)
                sink.write(packed)
                index.add(row["key"], row["page_id"], offset, len(packed))
                offset += len(packed)
        if sink is not None:
            sink.close()
            index.close()
            base = f"{folder}/{stem}"
            row = {
                "part": part,
                "warc": f"{base}.warc.gz",
                "index": f"{base}.index",
                "n_records": index.n,
                "n_blocks": len(index.directory),
                "n_bytes": offset,
                "first_key": index.first,
                "last_key": index.last,
            }
            yield pa.RecordBatch.from_pylist([row], _MANIFEST_TYPES)

    rows = with_types(pages, **columns)
    ordered = rows.repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id")
    return stored(ordered.mapInArrow(run, MANIFEST), "warc-manifest")


_MANIFEST_TYPES = pa.schema(
    [("part", pa.int32())]
    + [(c, pa.string()) for c in ("warc", "index")]
    + [(c, pa.int64()) for c in ("n_records", "n_blocks", "n_bytes")]
    + [(c, pa.string()) for c in ("first_key", "last_key")]
)
RECORD = (
    "page_id bigint, url string, record_type string, payload_bytes bigint, "
    "payload_digest string, refers_to bigint"
)
_RECORD_TYPES = pa.schema(
    [
        ("page_id", pa.int64()),
        ("url", pa.string()),
        ("record_type", pa.string()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("refers_to", pa.int64()),
    ]
)
_WITH_PAYLOAD = _RECORD_TYPES.append(pa.field("payload", pa.binary()))


def _schema(payload: bool) -> str:
    return RECORD + ", payload binary" * payload


def _records(captures: Iterable[tuple[str, list]], payload: bool) -> Iterator[pa.RecordBatch]:
    """Range reads of (archive, capture) in order, in batches of bounded size.

    The digest of every payload is verified here; the payload goes on only if it is asked for.
    """
    kinds = _WITH_PAYLOAD if payload else _RECORD_TYPES
    rows, held, path, file = [], 0, None, None
    for warc, (_, _, offset, length) in captures:
        if warc != path:
            if file is not None:
                file.close()
            store, at = filesystem(warc)
            path, file = warc, store.open_input_file(at)
        file.seek(offset)
        row = parsed(gzip.decompress(file.read(length)))
        if not payload:
            del row["payload"]
        rows.append(row)
        held += len(row.get("payload") or b"") + 200
        if held > BATCH_BYTES:
            yield pa.RecordBatch.from_pylist(rows, kinds)
            rows, held = [], 0
    if file is not None:
        file.close()
    if rows:
        yield pa.RecordBatch.from_pylist(rows, kinds)


def _dealt(manifest: DataFrame) -> DataFrame:
    """Archives dealt to tasks by their bytes, about READ_BYTES each."""
    total = manifest.agg(F.sum("n_bytes"), F.count("*")).first()
    tasks = min(-(-(total[0] or 0) // READ_BYTES), total[1])
    return manifest.repartition(max(1, tasks))


def read_archives(manifest: DataFrame, payload: bool = True) -> DataFrame:
    """All records, block after block of the index: page_id, url, record_type, payload_bytes,
    payload_digest, refers_to and, if asked for, payload (null for a revisit)."""

    def captures(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list]]:
        for batch in batches:
            for row in batch.to_pylist():
                index = Index(row["index"])
                for k in range(len(index.keys)):
                    for capture in index.block(k):
                        yield row["warc"], capture

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _records(captures(batches), payload)

    return _dealt(manifest).mapInArrow(run, _schema(payload))


def lookup(manifest: DataFrame, urls: DataFrame, url_col: str = "url", payload: bool = True) -> DataFrame:
    """The records of the wanted addresses, by bisection and range reads; columns of ``read_archives``.

    Keys are dealt by range and come in order, so a task opens the few files of its range and each index
    block once. The files' first and last keys go to the tasks in runs of a bounded number of files.
    Addresses that were not captured give no rows, repeated ones give their records once; a null
    address is an empty one.
    """
    spark = manifest.sparkSession
    wanted = urls.select(capture_key(letters(F.col(f"`{url_col}`"))).alias("key"))
    wanted = wanted.distinct().repartitionByRange("key").sortWithinPartitions("key")
    found = None
    files: list = []
    ordered = manifest.orderBy("first_key", "last_key", "part")
    for row in ordered.toLocalIterator():
        files.append((row["first_key"], row["last_key"], row["warc"], row["index"]))
        if len(files) == FILES_AT_ONCE:
            part = _lookup_in(spark, wanted, files, payload)
            found, files = part if found is None else found.union(part), []
    part = _lookup_in(spark, wanted, files, payload)
    return part if found is None else found.union(part)


def _lookup_in(spark, wanted: DataFrame, files: list, payload: bool) -> DataFrame:
    shared = spark.sparkContext.broadcast(files)

    def captures(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list]]:
        files = shared.value
        lasts = [last for _, last, _, _ in files]
        at, index = None, None
        for batch in batches:
            for key in batch.column("key").to_pylist():
                k = bisect.bisect_left(lasts, key)
                while k < len(files) and files[k][0] <= key:
                    if at != k:
                        at, index = k, Index(files[k][3])
                    for capture in index.find(key):
                        yield files[k][2], capture
                    k += 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _records(captures(batches), payload)

    return wanted.mapInArrow(run, _schema(payload))
