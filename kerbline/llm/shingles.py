"""Word shingles of texts as 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

SIZE = 5
_MULTIPLIERS = np.random.default_rng(20).integers(1, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that sums of products spread over all bits."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def words(text: str | None) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z, as UTF-8; none for null."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def word_hashes(tokens: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens))


def shingle_hashes(h: np.ndarray, size: int = SIZE) -> np.ndarray:
    """A hash for each run of `size` words, in order; fewer words are one run of their own kind; none give none."""
    n = len(h)
    if not n:
        return h
    k = min(size, n)
    total = np.full(n - k + 1, np.uint64(k))
    for i in range(k):
        total = total + h[i : n - k + 1 + i] * _MULTIPLIERS[i]
    return mix(total)


def shingle_set(text: str | None, size: int = SIZE) -> np.ndarray:
    """Sorted distinct shingle hashes of a whole text."""
    return np.unique(shingle_hashes(word_hashes(words(text)), size))
