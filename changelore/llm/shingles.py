"""Hashes of words and of runs of words, for operators on repeated text."""

from __future__ import annotations

import numpy as np
import xxhash

WORDS_KEPT = 300_000
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


class ByteHashes:
    """64-bit hashes of words in UTF-8; a bounded table spares recurring words the hashing."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        out = list(map(known.get, words))
        if None in out:
            for k, h in enumerate(out):
                if h is None:
                    word = words[k]
                    out[k] = h = xxhash.xxh3_64_intdigest(word)
                    if len(known) >= WORDS_KEPT:
                        known.clear()
                    if len(word) < 100:
                        known[word] = h
        return np.array(out, dtype=np.uint64)


def byte_words(text: str | None) -> list[bytes]:
    """The words of a text in UTF-8: `bytes.split` cuts at ASCII white space and nothing else, faster than a pattern."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    x = (x ^ (x >> np.uint64(29))) * _ODD
    return x ^ (x >> np.uint64(32))


def runs(words: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    """Hashes of all runs of k neighbouring words (of word hashes); empty for shorter texts."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, np.uint64(seed), dtype=np.uint64)
    for j in range(k):
        total = (total ^ words[j : j + n]) * _ODD
        total ^= total >> np.uint64(31)
    return _mixed(total)


def member(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which values are in a sorted array; costs a search per value, not a pass over the array."""
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def window_min(values: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbouring values."""
    n = len(values) - w + 1
    if n <= 0:
        return np.zeros(0, values.dtype)
    out = values[:n].copy()
    for j in range(1, w):
        np.minimum(out, values[j : j + n], out=out)
    return out
