"""Sets of hashed word shingles, as sorted 64-bit numbers."""

from __future__ import annotations

import numpy as np
from xxhash import xxh3_64_intdigest

_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], np.uint64)


class WordHashes(dict):
    """Word -> 64-bit hash, with a bounded cache."""

    def __init__(self, limit: int = 150_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxh3_64_intdigest(word)
        return h


def finish(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def window_hashes(words: list[bytes], width: int, hashes: WordHashes) -> np.ndarray:
    """A hash of each run of ``width`` words, in order; none if there are fewer words."""
    n = len(words)
    if n < width:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    total = np.full(n - width + 1, width, np.uint64)
    for i in range(width):
        total += h[i : n - width + 1 + i] * _MULTIPLIERS[i % len(_MULTIPLIERS)] + np.uint64(i)
        if width > len(_MULTIPLIERS):
            total = finish(total)
    return finish(total)


def shingle_set(text: bytes, size: int, hashes: WordHashes) -> np.ndarray:
    """Distinct hashes of the ``size``-word shingles, sorted; of fewer words the whole sequence is one, of none there is none.

    A-Z count as a-z; words lie between ASCII white space.
    """
    words = text.lower().split()
    return np.unique(window_hashes(words, min(size, len(words)), hashes)) if words else np.zeros(0, np.uint64)


def set_key(tokens: np.ndarray) -> int:
    """A signed 64-bit key of the set."""
    return xxh3_64_intdigest(tokens.tobytes()) - 2**63


def parity_sketch(tokens: np.ndarray) -> bytes:
    """For each value of the shingles' low bits whether an odd number of them has it; a power of two of bits, the set's size at least."""
    bits = 64
    while bits < len(tokens):
        bits *= 2
    return np.packbits(np.bincount((tokens & np.uint64(bits - 1)).view(np.int64), minlength=bits) & 1 == 1).tobytes()


def least_apart(one: bytes, other: bytes) -> int:
    """Two sets differ by as many shingles at least as their sketches, the longer folded to the shorter, differ in bits."""
    x, y = sorted((np.frombuffer(b, np.uint64) for b in (one, other)), key=len)
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())
