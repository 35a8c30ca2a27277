"""Vectorized 64-bit hashes inside Spark tasks."""

from __future__ import annotations

import numpy as np
import xxhash

_KNOWN: dict = {}
#: Words remembered by a worker (results do not depend on it).
REMEMBERED = 200_000


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit numbers (splitmix64's finalizer)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list) -> np.ndarray:
    """A 64-bit hash of each word (str or bytes)."""
    known = _KNOWN
    if len(known) > REMEMBERED:
        known.clear()
    for w in set(words).difference(known):
        known[w] = xxhash.xxh3_64_intdigest(w)
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
