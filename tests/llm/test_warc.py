from __future__ import annotations

import gzip
import hashlib

from keydrivers.llm import warc
from keydrivers.llm.warc import lookup, read_archives, write_archives


def expected(rows):
    groups = {}
    for page, _, html in rows:
        payload = (html or "").encode()
        if len(payload) >= 1000 and page is not None:
            groups[payload] = max(groups.get(payload, page), page)
    found = []
    for page, _, html in rows:
        payload = (html or "").encode()
        first = groups.get(payload, page)
        kind = ("response", None) if first == page else ("revisit", first)
        found.append((page, len(payload), hashlib.sha1(payload).hexdigest(), *kind))
    return sorted(found, key=repr)


def compared(pages):
    records = read_archives(write_archives(pages))
    found = [
        (r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)
        for r in records.collect()
    ]
    rows = [tuple(r) for r in pages.select("page_id", "url", "html").collect()]
    assert sorted(found, key=repr) == expected(rows)


def made_up(spark):
    long, other = "x" * 1000, "é" * 500
    rows = [(i, f"http://A{i % 7}.example.com/p?{i}#f", long if i % 3 else other) for i in range(200)]
    rows += [(900, None, None), (901, "no scheme", ""), (902, "http://h/\r\nX: y", "short" * 3)]
    rows += [(903, "http://h/", "short"), (904, "http://h/", "short"), (None, "http://z/", long)]
    rows += [(5, "http://A5.example.com/p?5#f", long), (905, "http://big/", "b" * 9_000_000)]
    return spark.createDataFrame(
        [(*r, "own") for r in rows], "page_id bigint, url string, html string, record_type string"
    )


def test_pages(spark, sf_dir):
    compared(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def test_copies_nulls_and_long_pages(spark):
    compared(made_up(spark))


def test_no_pages(spark):
    empty = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert read_archives(write_archives(empty)).count() == 0


def test_lookup_by_address(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK", 7)
    pages = made_up(spark)
    manifest = write_archives(pages.repartition(3)).cache()
    urls = ["http://a5.example.com/p?5#f", "http://h/", "http://nowhere/", "http://A6.example.com/p?6#f"]
    wanted = spark.createDataFrame([(u,) for u in urls + urls], "url string")
    found = sorted(r.page_id for r in lookup(manifest, wanted).collect())
    assert found == [5, 5, 6, 903, 904]
    monkeypatch.setattr(warc, "FILES_AT_ONCE", 1)
    assert sorted(r.page_id for r in lookup(manifest, wanted).collect()) == found


def test_archives_are_plain_gzip_members(spark):
    row = write_archives(made_up(spark).where("page_id < 20")).first()
    raw = gzip.decompress(open(row["warc"].removeprefix("file:"), "rb").read())
    assert raw.count(b"WARC/1.1\r\n") == row["n_records"]


def test_lookup_of_all_pages_equals_sequential_read(spark, sf_dir, monkeypatch):
    """Records, their order aside, with payloads and without; small blocks and files."""
    monkeypatch.setattr(warc, "BLOCK", 7)
    for pages in (made_up(spark), spark.read.parquet(f"{sf_dir}/pages.parquet")):
        manifest = write_archives(pages.repartition(5)).cache()
        sequential = sorted(map(tuple, read_archives(manifest).collect()), key=repr)
        assert sorted(map(tuple, lookup(manifest, pages).collect()), key=repr) == sequential
        short = sorted((r[:6] for r in sequential), key=repr)
        assert sorted(map(tuple, lookup(manifest, pages, payload=False).collect()), key=repr) == short
        assert sorted(map(tuple, read_archives(manifest, payload=False).collect()), key=repr) == short
        assert len(short) == pages.count()
