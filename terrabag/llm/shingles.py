"""Word shingles as sorted 64-bit sets."""

from __future__ import annotations

import numpy as np
import xxhash

_M = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], dtype=np.uint64)
_ADD = _M * np.arange(1, 6, dtype=np.uint64)
#: Word hashes that a worker remembers.
MEMORY = 400_000


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMORY:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of uint64 values that spreads every bit."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def shingle_set(text: str, words: WordHashes, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the text's word shingles.

    Words are runs other than space and \\x09-\\x0d after lower-casing A-Z. With fewer than `width` words the whole sequence is one
    shingle; without words the set is empty.
    """
    found = text.encode("utf-8").lower().split()
    n = len(found)
    if n == 0:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(words.__getitem__, found), dtype=np.uint64, count=n)
    if n < width:
        return np.array([xxhash.xxh3_64_intdigest(h.tobytes(), seed=n)], dtype=np.uint64)
    m = n - width + 1
    s = np.zeros(m, dtype=np.uint64)
    for i in range(width):
        s += mix(h[i : i + m] + _ADD[i % 5]) * _M[(i + 2) % 5]
    return np.unique(mix(s))
