"""Repeated windows of a sequence: arrays that the substring operators share.

A sequence of many documents end to end has one 64-bit value per element. A window's minimiser is the leftmost
element of least priority in it, so equal windows have their minimisers at equal offsets, wherever they stand.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

BASE = 0x9E3779B97F4A7C15 | 5  # odd, so powers have inverses modulo 2 ** 64
BASE_INVERSE = pow(BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


@lru_cache(maxsize=2)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (BASE, BASE_INVERSE):
        steps = np.full(1 << bits, base, np.uint64)
        steps[0] = 1
        out.append(np.cumprod(steps, dtype=np.uint64))
    return out[0], out[1]


class Hashes:
    """Hashes of any stretch of values, from sums of values times powers of BASE modulo 2 ** 64."""

    def __init__(self, values: np.ndarray):
        up, self.down = _powers(max(16, int(len(values) + 1).bit_length()))
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[: len(values)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


def least(values: np.ndarray, width: int) -> np.ndarray:
    """For each start, where the leftmost least priority among width values is; len(values) - width + 1 of them."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    key = (mix(values) & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(values), dtype=np.uint64)
    padded = np.full(-(-len(key) // width) * width, np.uint64(2**64 - 1))
    padded[: len(key)] = key
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    found = np.minimum(back[:n], ahead[width - 1 : width - 1 + n])
    return (found & np.uint64(0xFFFFFFFF)).astype(np.int64)


def starts_inside(offsets: np.ndarray, length: int) -> np.ndarray:
    """All starts of windows of this length that lie in one document."""
    counts = np.maximum(0, np.diff(offsets) - length + 1)
    first = np.repeat(offsets[:-1], counts)
    return first + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def runs(anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-last index of each run of equal values."""
    if not len(anchor):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    return first, np.r_[first[1:], len(anchor)]


def ranges(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """start[0], ..., end[0] - 1, start[1], ..."""
    n = end - start
    return np.repeat(start, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def joined(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of intervals, as maximal ones in order; intervals that touch are one."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    new = np.r_[True, start[1:] > reach[:-1]]
    return start[new], reach[np.r_[np.flatnonzero(new)[1:] - 1, len(reach) - 1]]
