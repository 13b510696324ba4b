"""Sets of word shingles as sorted 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

from .common import ASCII_LOWER, claim

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixer."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M2
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words as bytes, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = WordHashes()


def words(text: str | None) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased: bytes.split() parts at just these blanks."""
    return text.encode("utf-8", "surrogatepass").translate(ASCII_LOWER).split() if text else []


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted hashes of the distinct k-word shingles; fewer words: one for the whole sequence; none: empty."""
    ws = words(text)
    if not ws:
        return np.zeros(0, np.uint64)
    claim("words", _hashes.clear)
    h = np.fromiter(map(_hashes.__getitem__, ws), np.uint64, len(ws))
    n = min(k, len(ws))
    out = h[: len(h) - n + 1] + np.uint64(n)
    for i in range(1, n):
        out = mix(out * _M1 + h[i : len(h) - n + 1 + i])
    return np.unique(mix(out))
