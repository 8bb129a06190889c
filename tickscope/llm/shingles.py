"""Word shingles of a text as 64-bit hashes, and their MinHash values; NumPy only."""

from __future__ import annotations

import hashlib

import numpy as np

WIDTH = 5  # words of a shingle
N_HASHES = 160
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_rng = np.random.default_rng(20)
_FACTORS = _rng.integers(1, 1 << 63, N_HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TERMS = _rng.integers(0, 1 << 63, N_HASHES, dtype=np.uint64) * np.uint64(2)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


class _Powers:
    """Powers of a factor modulo 2**64, as many as the longest text so far needs."""

    def __init__(self, factor: np.uint64):
        self.factor, self.values = factor, np.ones(1, np.uint64)

    def upto(self, n: int) -> np.ndarray:
        if len(self.values) < n:
            steps = np.full(max(n, 2 * len(self.values)), self.factor, np.uint64)
            steps[0] = 1
            self.values = np.multiply.accumulate(steps)
        return self.values[:n]


_up, _down = _Powers(_BASE), _Powers(_INVERSE)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str) -> np.ndarray:
    """One hash per maximal run of bytes other than ASCII white space."""
    data = np.frombuffer(text.encode(), np.uint8)
    inside = (data != 32) & ((data < 9) | (data > 13))
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mixed(data.astype(np.uint64) + np.uint64(1)) * _up.upto(len(data)))])
    raw = (sums[ends] - sums[starts]) * _down.upto(len(data))[starts]
    return _mixed(raw + (ends - starts).astype(np.uint64))


def shingle_set(text: str) -> np.ndarray:
    """Sorted distinct hashes of the five-word shingles; a text of one to four words is one shingle."""
    words = word_hashes(text)
    n = max(1, len(words) - WIDTH + 1) if len(words) else 0
    if not n:
        return words
    total = np.full(n, len(words) if len(words) < WIDTH else WIDTH, np.uint64)
    for k in range(min(WIDTH, len(words))):
        total = _mixed(total * _BASE + words[k:k + n])
    return np.unique(total)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The 16 high bits of each MinHash value."""
    least = np.full(N_HASHES, np.iinfo(np.uint64).max, np.uint64)
    for s in range(0, len(shingles), 2048):
        least = np.minimum(least, (_FACTORS[:, None] * shingles[None, s:s + 2048] + _TERMS[:, None]).min(axis=1))
    return (least >> np.uint64(48)).astype("<u2")


def set_digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()
