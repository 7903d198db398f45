"""Words and word shingles as 64-bit hashes, vectorised over whole batches.

A word is a maximal run of ASCII letters, digits and non-ASCII characters,
after folding A-Z and the Latin-1 capitals to lower case. Everything else
separates words; words never cross documents.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

IS_WORD = np.zeros(256, bool)
for _r in (range(48, 58), range(65, 91), range(97, 123), range(128, 256)):
    IS_WORD[list(_r)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    one = np.ones(1, np.uint64)
    up = np.concatenate([one, np.cumprod(np.full(n, BASE, np.uint64))])
    down = np.concatenate([one, np.cumprod(np.full(n, BASE_INVERSE, np.uint64))])
    return up, down


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << 20
    while size < n:
        size *= 2
    return _powers(size)


def fold(data: np.ndarray) -> np.ndarray:
    """Lower case for A-Z and for the two-byte Latin-1 capitals."""
    low = LOWER[data]
    if len(data) > 1:
        second = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
        low[second] += 32
    return low


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, document index, byte length) of every word of the documents
    ``data[offsets[i]:offsets[i + 1]]``, in text order."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = fold(data)
    inside = IS_WORD[low]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < n)]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = powers(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    h = (sums[end] - sums[start]) * down[start]
    doc = np.searchsorted(offsets, start, "right") - 1
    return mix(h), doc, end - start


def shingle_hashes(hashes: np.ndarray, doc: np.ndarray, n_docs: int, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document index) of every run of ``width`` words of a document;
    a document of fewer words has one shingle of them all, one of none none."""
    n = len(hashes)
    out = np.zeros(n, np.uint64)
    have = np.bincount(doc, minlength=n_docs)
    place = np.arange(n) - np.repeat(np.concatenate([[0], np.cumsum(have)[:-1]]), have)
    left = have[doc] - place
    for k in range(width):
        factor = np.uint64(pow(int(BASE), k, 1 << 64))
        upto = max(0, n - k)
        term = hashes[k:] * factor
        out[:upto] += np.where(left[:upto] > k, term, np.uint64(0))
    keep = (left >= width) | (place == 0)
    short = (have[doc] < width)
    out = mix(out + np.where(short, have[doc], width).astype(np.uint64))
    return out[keep], doc[keep]
