"""Sets of word shingles as arrays of 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

from .repeats import Hashes, ranges

SHINGLE = 5


def shingles(bodies: list[bytes], k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Each text's different shingle hashes, sorted, end to end, and where each text starts (one more entry for the end).
    Fewer than k words are one shingle."""
    words = [b.lower().split() for b in bodies]  # bytes: A-Z and the six ASCII white-space characters only
    n = np.array([len(w) for w in words], np.int64)
    values = np.fromiter((xxhash.xxh3_64_intdigest(w) for own in words for w in own), np.uint64, int(n.sum()))
    first = np.cumsum(n) - n
    count = np.where(n > 0, np.maximum(1, n - k + 1), 0)
    start = ranges(first, first + count)
    doc = np.repeat(np.arange(len(n)), count)
    found = Hashes(values).of(start, np.minimum(start + k, np.repeat(first + n, count)))
    order = np.lexsort((found, doc))
    found, doc = found[order], doc[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (doc[1:] != doc[:-1])
    return found[new], np.searchsorted(doc[new], np.arange(len(n) + 1))
