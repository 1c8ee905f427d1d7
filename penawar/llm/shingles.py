"""Word-shingle sets as sorted arrays of 64-bit hashes (used inside Arrow tasks)."""

from __future__ import annotations

import hashlib

import numpy as np
from xxhash import xxh3_64_intdigest

_MUL = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``size`` words; of fewer words, the whole sequence as one.

    bytes.lower() lowers A-Z alone and bytes.split() splits at \\x20 and \\x09-\\x0D alone."""
    words = text.lower().split() if text else []
    n = len(words)
    if n == 0:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, n)
    width = min(size, n)
    acc = np.full(n - width + 1, width, np.uint64)
    for j in range(width):
        acc = acc * _MUL + h[j:n - width + 1 + j]
    acc = np.sort(_mixed(acc))
    return acc[np.concatenate(([True], acc[1:] != acc[:-1]))]


def set_signature(shingles: np.ndarray) -> int:
    """64-bit hash of a whole set, as a signed integer."""
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)
