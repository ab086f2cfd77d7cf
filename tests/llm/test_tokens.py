from __future__ import annotations

import hashlib
import io
import random
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from keydrivers.llm.bpe import byte_bpe, library, public
from keydrivers.llm.bpe_codec import digests, encode_decode
from keydrivers.llm.token_counts import count_tokens
from keydrivers.llm.token_files import (
    UNCOMMON,
    UNCOMMON_RE2,
    TokenFile,
    Writer,
    checksums,
    read_documents,
    read_tokens,
    word_bpe,
    write_tokens,
)

ODD = [
    "a <|endoftext|> b",
    "<|endoftext|><|endoftext|>x's're  ",
    "",
    " \n\n  x \t y's don't WE'LL",
    "ſİƆȺ ½²３ 日本語 👩‍👩‍👧 é é",
]


def blob(name):
    with open(public(name), "rb") as f:
        return f.read()


@pytest.fixture(scope="module")
def texts(documents):
    random.seed(8)
    letters = "aB'sZ \n\t éÀÏ12²½日本🙂̀ \x1c\x85.#<|endoftext|>ſİƆȺ"
    found = [r.text for r in documents.limit(100).collect()] + ODD
    found += ["".join(random.choice(letters) for _ in range(random.randint(0, 60))) for _ in range(500)]
    found += ["".join(chr(random.choice([random.randint(0, 0x3000), 32])) for _ in range(40)) for _ in range(300)]
    return found


def test_byte_encoding_is_the_librarys(texts):
    bpe = byte_bpe(blob("byte_bpe_50k.json"))
    for text in texts:
        ids = bpe.library.encode(text, add_special_tokens=False).ids
        assert bpe.encode(text) == ids
        assert bpe.decode(ids) == bpe.library.decode(ids, skip_special_tokens=False)


def test_fragments_end_at_pairs_no_token_has():
    bpe = byte_bpe(blob("byte_bpe_50k.json"))
    cut = [bpe.fragments(x) for x in (b"abjqxc", b"the", b"a", b"")]
    assert [b"".join(x) for x in cut] == [b"abjqxc", b"the", b"a", b""]
    assert len(cut[0]) > 1 and cut[1] == [b"the"]
    assert not any((a[-1], b[0]) in bpe.inside for x in cut for a, b in zip(x, x[1:]))


def test_whole_tokens_encode_alone():
    bpe = byte_bpe(blob("byte_bpe_50k.json"))
    whole = bpe.whole_tokens()
    assert len(whole) > 40_000
    for text in random.sample(sorted(whole), 500):
        assert len(bpe.library.encode(text, add_special_tokens=False).ids) == 1


def test_word_encoding_is_the_librarys(texts):
    own = word_bpe(blob("word_bpe_49k.json"))
    for text, found in zip(texts, own.encode(texts), strict=True):
        ids = own.library.encode(text, add_special_tokens=False).ids
        assert struct.pack(f"<{len(ids)}I", *ids) == found


def test_codec_and_counts_of_rows(edge_docs, no_docs):
    lib = library(blob("byte_bpe_50k.json"))

    def expected(text):
        ids = lib.encode(text or "", add_special_tokens=False).ids
        decimals = ",".join(map(str, ids)).encode()
        decoded = lib.decode(ids, skip_special_tokens=False).encode()
        return len(ids), hashlib.sha256(decimals).hexdigest(), hashlib.sha256(decoded).hexdigest()

    rows = edge_docs.select("doc_id", "text").collect()
    found = sorted(map(repr, map(tuple, digests(encode_decode(edge_docs)).collect())))
    assert found == sorted(repr((r.doc_id, *expected(r.text))) for r in rows)
    counts = sorted(map(repr, map(tuple, count_tokens(edge_docs).collect())))
    sizes = [(r.doc_id, len((r.text or "").encode()), expected(r.text)[0]) for r in rows]
    assert counts == sorted(repr((*s, s[2] > 1024)) for s in sizes)
    assert encode_decode(no_docs).count() == 0 and count_tokens(no_docs).count() == 0


def test_frames_are_read_alone_and_damage_is_seen():
    sink = io.BytesIO()
    writer = Writer(sink, frame_tokens=100)
    random.seed(1)
    docs = [(i, np.random.randint(0, 49000, random.choice([0, 5, 90, 1000])).astype("<u4").tobytes()) for i in range(50)]
    for i, tokens in docs:
        writer.add(i, tokens)
    writer.close()
    raw = sink.getvalue()
    file = TokenFile(pa.BufferReader(raw))
    assert [(i, t) for i, _, t in file.documents()] == docs
    read = []
    plain = file.frame
    file.frame = lambda k: read.append(k) or plain(k)
    for k, (_, tokens) in enumerate(docs):
        read.clear()
        assert file.read(k) == tokens
        assert len(read) <= len(tokens) // 400 + 2
    import zstandard

    whole = zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read()
    assert whole == b"".join(t for _, t in docs)
    damaged = bytearray(raw)
    damaged[20] ^= 1
    with pytest.raises((ValueError, zstandard.ZstdError)):
        list(TokenFile(pa.BufferReader(bytes(damaged))).documents())


def test_token_files_round_trip(spark, edge_docs, no_docs):
    lib = library(blob("word_bpe_49k.json"))
    docs = edge_docs.repartition(3)
    manifest = write_tokens(docs)
    every = read_tokens(manifest)
    found = [tuple(r) for r in checksums(every).collect()]
    rows = sorted(
        ((r.doc_id, r.text) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0)
    )
    start, expected = 0, []
    for doc_id, text in rows:
        ids = lib.encode(text or "", add_special_tokens=False).ids + [1]
        expected.append((doc_id, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    assert sorted(found, key=lambda r: r[1]) == expected
    wanted = every.where("doc_id in (2, 4, 8)")
    tokens = {r.doc_id: bytes(r.tokens) for r in wanted.collect()}
    assert {r.doc_id: bytes(r.tokens) for r in read_documents(wanted).collect()} == tokens
    assert read_tokens(write_tokens(no_docs)).count() == 0


def test_arrow_finds_the_same_uncommon_characters():
    texts = [chr(c) for c in range(0x250)] + ["日", "\U0001f600", "\u0301", "<|", "<", "|<", "a\nb", "", "a\x00", "é<|"]
    found = pc.match_substring_regex(pa.array(texts), UNCOMMON_RE2).to_pylist()
    assert found == [bool(UNCOMMON.search(x)) for x in texts]


def test_remembered_ids_are_small():
    bpe = byte_bpe(blob("byte_bpe_50k.json"))
    text = "A sequence of some words, 1234567 <|endoftext|> and ümläuts"
    assert bpe.encode(text) == bpe.library.encode(text, add_special_tokens=False).ids
    assert all(isinstance(x, bytes) and len(x) % 4 == 0 for x in bpe.by_pre_token.values())
    assert bpe.by_pre_token.limit <= 50_000
