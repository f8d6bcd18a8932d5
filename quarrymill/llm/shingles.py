"""Hashed word shingles of texts, for use inside tasks."""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash

#: Odd multipliers of the shingle hash (fixed values: the golden ratio's 64-bit form, splitmix64's).
STEP, MIX_A, MIX_B = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mixed(h: np.ndarray) -> np.ndarray:
    """Numbers whose bits all depend on all bits of ``h``."""
    h = (h ^ (h >> np.uint64(30))) * MIX_A
    h = (h ^ (h >> np.uint64(27))) * MIX_B
    return h ^ (h >> np.uint64(31))


class Shingler:
    """Sets of 64-bit hashes of the shingles of ``size`` words."""

    def __init__(self, size: int = 5):
        self.size = size

    def __call__(self, text: bytes) -> np.ndarray:
        """The sorted distinct shingles (as signed numbers) of a UTF-8 text: A-Z lower-cased, words
        split at ASCII white space. A text of fewer words is one shingle, one without words none."""
        found = text.lower().split()
        n = len(found)
        if not n:
            return np.empty(0, np.int64)
        w = np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, n)
        size = min(self.size, n)
        h = np.full(n - size + 1, size, np.uint64)
        for k in range(size):
            h = h * STEP + w[k : n - size + 1 + k]
        return np.unique(mixed(h).view(np.int64))


def signature(shingles: np.ndarray) -> bytes:
    """128 bits that name a set of shingles."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()
