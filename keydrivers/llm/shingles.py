"""Words, word runs and their hashes, in tasks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import xxhash

from .common import BoundedCache

CACHE = 150_000
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers over all values, one to one."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


class Words:
    """Hashes of words: runs of bytes other than space and the controls 9 to 13, A-Z lower-cased.

    ``bytes.split`` and ``bytes.lower`` know exactly these and leave other bytes of UTF-8 alone.
    """

    def __init__(self, normal: Callable[[bytes], bytes] = bytes):
        """``normal`` gives the form of a word that is hashed."""
        self.known = BoundedCache(lambda w: xxhash.xxh3_64_intdigest(normal(w)), CACHE)

    def hashes(self, text: bytes) -> np.ndarray:
        words = text.lower().split()
        return np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))


def windows(words: np.ndarray, size: int) -> np.ndarray:
    """A hash for each run of ``size`` words, in order; none if there are fewer."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = words[:n].copy()
    for i in range(1, size):
        h *= _MULTIPLIER
        h += mixed(words[i : i + n])
    return mixed(h)


def shingle_set(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct runs; with fewer words the whole sequence is one; without words none."""
    if 0 < len(words) < size:
        # Numbers of words differ, so this is no run of ``size`` words.
        return windows(words, len(words)) ^ np.uint64(len(words))
    return np.unique(windows(words, size))


def bare(word: bytes) -> bytes:
    """A word in lower case of every script, without punctuation at its ends."""
    text = word.decode("utf-8", "replace").lower()
    return text.strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»„“”‘’…–—").encode()
