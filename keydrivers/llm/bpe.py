"""Byte-level BPE in tasks: pre-tokens, forced boundaries, merges, decoding.

The vocabulary is a file of the tokenizers library. Its content, whose size does not depend on the
data, is broadcast; tasks open no path.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array
from functools import lru_cache

import tiktoken

from .common import BoundedCache, on_executors

# The split pattern of byte-level BPE, with classes of letters and numbers to fill in.
SPLIT = "'(?:[sdmt]|ll|ve|re)| ?[{L}]+| ?[{N}]+| ?[^\\s{L}{N}]+|\\s+(?!\\S)|\\s+"

# Below this code point Python and the library agree on what a letter, number or space is.
COMMON = 0x250
CACHE = 50_000


def _class_of(initial: str) -> str:
    """Character class of the code points below COMMON whose Unicode category starts so."""
    inside = [c for c in range(COMMON) if unicodedata.category(chr(c))[0] == initial]
    return "".join(f"\\u{c:04x}" for c in inside)


# Control characters on which notions of white space differ, and everything above COMMON.
UNCOMMON = re.compile(f"[\\x00-\\x08\\x0e-\\x1f\\x7f-\\xa0\\xad\\u{COMMON:04x}-\\U0010ffff]")
PRE_TOKEN = re.compile(SPLIT.format(L=_class_of("L"), N=_class_of("N")))


def byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in vocabulary files: itself where it is printable, else
    the next unused code point from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def library(blob: bytes):
    """The tokenizers library on one thread: Spark already runs a task on each core."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_buffer(blob)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


class ByteBpe:
    """Encoder and decoder of one vocabulary of byte-level BPE.

    Ids are those of the library with ``add_special_tokens=False``: special strings within a text
    become their ids.
    """

    def __init__(self, blob: bytes):
        spec = json.loads(blob)
        if spec["model"]["type"] != "BPE" or (spec["pre_tokenizer"] or {}).get("type") != "ByteLevel":
            raise ValueError("not a vocabulary of byte-level BPE")
        if spec["normalizer"] or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("texts would be changed before they are split")
        letters = byte_letters()
        self.ranks = {
            bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items()
        }
        merged = [m if isinstance(m, str) else "".join(m) for m in spec["model"]["merges"]]
        ids = [spec["model"]["vocab"][m.replace(" ", "")] for m in merged]
        if ids != sorted(set(ids)):
            raise ValueError("ids do not follow the order of merges")
        self.letters = letters
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.library = library(blob)
        core = tiktoken.Encoding("bpe", pat_str=".", mergeable_ranks=self.ranks, special_tokens={})
        self.merge = core._core_bpe.encode_single_piece
        self.inside = frozenset(p for token in self.ranks for p in zip(token, token[1:], strict=False))
        # Ids as 32-bit numbers in bytes: a tuple of them takes five times the memory.
        self.by_fragment = BoundedCache(lambda x: array("i", self.merge(x)).tobytes(), CACHE)
        self.by_pre_token = BoundedCache(self.encode_pre_token, CACHE)
        self.bytes_of = {i: token for token, i in self.ranks.items()}
        self.bytes_of |= {i: content.encode() for content, i in self.special.items()}

    def fragments(self, piece: bytes) -> list[bytes]:
        """Cut where a pair of bytes stands inside no vocabulary token.

        A merge that crossed such a place would make a token with that pair inside, so no merge
        does: the fragments' ids, one after the other, are those of the piece.
        """
        inside = self.inside
        cuts = [i for i, pair in enumerate(zip(piece, piece[1:], strict=False), 1) if pair not in inside]
        return [piece[a:b] for a, b in zip([0, *cuts], [*cuts, len(piece)], strict=True)]

    def encode_pre_token(self, token: str) -> bytes:
        return b"".join(map(self.by_fragment.__getitem__, self.fragments(token.encode())))

    def forget(self) -> None:
        self.by_fragment.clear()
        self.by_pre_token.clear()

    def pre_tokens(self, text: str) -> list[str]:
        """The library's pre-tokens of a text without special strings."""
        if not UNCOMMON.search(text):
            return PRE_TOKEN.findall(text)
        found = self.library.pre_tokenizer.pre_tokenize_str(text)
        letters = self.letters
        return [bytes(letters[c] for c in token).decode() for token, _ in found]

    def segments(self, text: str):
        """(text, None) for ordinary parts and (None, id) for special strings, in order."""
        if not self.special or not any(s in text for s in self.special):
            yield text, None
            return
        for i, part in enumerate(self.special_split.split(text)):
            if i % 2:
                yield None, self.special[part]
            elif part:
                yield part, None

    def packed(self, text: str) -> bytes:
        """The ids of a text as 32-bit numbers."""
        found: list[bytes] = []
        known = self.by_pre_token.__getitem__
        for part, special in self.segments(text):
            if part is None:
                found.append(array("i", [special]).tobytes())
            else:
                found.extend(map(known, self.pre_tokens(part)))
        return b"".join(found)

    def encode(self, text: str) -> list[int]:
        return array("i", self.packed(text)).tolist()

    def decode(self, ids) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")

    def whole_tokens(self) -> dict[str, int]:
        """Pre-tokens proven to encode as one token: each string of the vocabulary that is a text,
        is one pre-token by itself, and is merged to exactly its own id."""
        found = {}
        for token, i in self.ranks.items():
            try:
                text = token.decode()
            except UnicodeDecodeError:
                continue
            if self.merge(token) == [i] and self.pre_tokens(text) == [text]:
                found[text] = 1
        return found


@lru_cache(maxsize=4)
def byte_bpe(blob: bytes) -> ByteBpe:
    """One encoder for each worker process and vocabulary."""
    return ByteBpe(blob)


def vocabulary(spark, path: str):
    """Broadcast a vocabulary file: a few MB, whatever the size of the data."""
    on_executors(spark)
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def public(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
