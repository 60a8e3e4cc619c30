"""Vectorised word and shingle hashing over UTF-8 buffers.

A word is a maximal run of bytes other than space and 0x09-0x0D, with A-Z lower-cased.
Hashes are 64 bits wide: a false match inside one pair of documents with 20,000 shingles
each has a chance of about 2e-11.
"""

from __future__ import annotations

import numpy as np

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0x9FB21C651E98DF25)


def mix(x: np.ndarray) -> np.ndarray:
    """Splitmix64's finaliser, element by element."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


with np.errstate(over="ignore"):
    _SALT = mix(np.arange(1, 65, dtype=np.uint64) * _GOLD) | np.uint64(1)
    _BYTE = mix((np.arange(256, dtype=np.uint64) + np.uint64(1000)) * _GOLD)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BYTE_LOW = _BYTE[_LOWER]
_BYTE_LOW[_SPACE] = 0
_POWERS = np.cumprod(np.full(1024, _BASE, np.uint64))


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if n > len(_POWERS):
        _POWERS = np.cumprod(np.full(2 * n, _BASE, np.uint64))
    return _POWERS


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start byte, length, hash, document) of every word, in order."""
    solid = ~_SPACE[data]
    before = np.empty(len(data), bool)
    if len(data):
        before[0] = False
        before[1:] = solid[:-1]
        before[offsets[:-1][offsets[:-1] < len(data)]] = False
    starts = np.flatnonzero(solid & ~before)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64), none
    sizes = np.add.reduceat(solid, starts, dtype=np.int64)
    doc = np.searchsorted(offsets, starts, "right") - 1
    # a word's segment for reduceat runs to the next word; the spaces between weigh nothing
    place = np.arange(starts[0], len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data))))
    powers = _powers(int(sizes.max()))
    weighted = _BYTE_LOW[data[starts[0] :]] * powers[np.minimum(place, len(powers) - 1)]
    h = np.add.reduceat(weighted, starts - starts[0])
    return starts, sizes, mix(h ^ (sizes.astype(np.uint64) * _GOLD)), doc


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """The sorted distinct ``width``-word shingle hashes of each document.

    Fewer than ``width`` words make one shingle of them all; no word makes an empty set.
    """
    _, _, h, doc = words(data, offsets)
    n = len(offsets) - 1
    bounds = np.searchsorted(doc, np.arange(n + 1))
    if len(h) >= width:
        last = len(h) - width + 1
        s = np.zeros(last, np.uint64)
        for j in range(width):
            s += mix(h[j : j + last] * _SALT[j])
        s = mix(s)
    out = []
    for i in range(n):
        lo, hi = bounds[i], bounds[i + 1]
        if hi - lo >= width:
            out.append(np.unique(s[lo : hi - width + 1]))
        elif hi > lo:
            few = np.zeros(1, np.uint64)
            for j in range(hi - lo):
                few += mix(h[lo + j : lo + j + 1] * _SALT[j])
            out.append(mix(few + np.uint64(hi - lo)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
