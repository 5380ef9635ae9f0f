"""Vectorised word hashing over UTF-8 bytes, without a Python object per word."""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POW: dict[int, np.ndarray] = {}

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def _powers(base: np.uint64, n: int) -> np.ndarray:
    have = _POW.get(int(base))
    if have is None or len(have) < n:
        size = max(n, 1 << 20)
        p = np.full(size, base, np.uint64)
        p[0] = 1
        have = _POW[int(base)] = np.multiply.accumulate(p)
    return have[:n]


def scramble(h: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit words."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """S with S[j] - S[i] = sum of values[t] * base**t over i <= t < j, modulo 2**64."""
    s = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(values)), out=s[1:])
    return s


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans, equal for equal contents wherever they stand."""
    back = _powers(_BACK, len(sums))
    h = (sums[end] - sums[start]) * back[start]
    return scramble(h ^ ((end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def words(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray = SPACE):
    """Start, end and row of every maximal run of bytes that are not in ``gap``; runs end with their row."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    solid = ~gap[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    begin = solid.copy()
    begin[1:] &= ~solid[:-1] | first[1:-1]
    stop = solid.copy()
    stop[:-1] &= ~solid[1:] | first[1:-1]
    start = np.flatnonzero(begin)
    end = np.flatnonzero(stop) + 1
    row = np.searchsorted(offsets, start, side="right") - 1
    return start, end, row


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The concatenation of start[i] .. start[i] + length[i] - 1."""
    total = int(length.sum())
    at = np.cumsum(length) - length
    return np.arange(total) + np.repeat(start - at, length)
