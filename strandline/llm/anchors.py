"""Content-defined anchors: each 200-byte string of a text has one, chosen by its own bytes alone.

An anchor is a position whose K-byte hash is the least of some W consecutive ones. A string of SPAN bytes starting at p
fixes, whatever surrounds it, which of the positions p + W - 1 ... p + 2 W - 1 are anchors, and at least one is. The first
of them owns the string, so equal strings are owned by anchors at equal offsets, and the CORE bytes round the anchor,
which lie in every string it may own, are a necessary key of equality.
"""

from __future__ import annotations

import numpy as np

SPAN, K, W = 200, 16, 62
#: Offsets of an anchor in the strings it owns; bytes before and after it that all of them share; bytes beyond those that some reach.
FIRST, LAST = W - 1, 2 * W - 2
BEFORE, AFTER = FIRST, SPAN - LAST
SIDE = LAST - FIRST
SEGMENT = 1 << 19
MARGIN = 1 << 10

#: Two independent families of hashes: a table of the bytes and a base each.
_TABLES = [np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1) for seed in (7, 8)]
_BASES = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F]
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, family: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the family's base and of its inverse, modulo 2**64."""
    if family not in _powers or len(_powers[family][0]) < n:
        size = max(n, SEGMENT + 2 * MARGIN + 64)
        up, down = (np.full(size, x, dtype=np.uint64) for x in (_BASES[family], pow(_BASES[family], -1, 1 << 64)))
        up[0] = down[0] = 1
        _powers[family] = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    up, down = _powers[family]
    return up[:n], down[:n]


class Hashes:
    """Hashes of any substrings of a buffer: differences of a running sum of table[byte] * base**i, modulo 2**64."""

    def __init__(self, b: np.ndarray, family: int = 0):
        up, self.down = powers(len(b) + 1, family)
        self.sums = np.empty(len(b) + 1, dtype=np.uint64)
        self.sums[0] = 0
        np.cumsum(_TABLES[family][b] * up[:-1], out=self.sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return (self.sums[stop] - self.sums[start]) * self.down[start]

    def grams(self, k: int) -> np.ndarray:
        return (self.sums[k:] - self.sums[:-k]) * self.down[: len(self.sums) - k]


def mixed(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads all bits."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _sliding(x: np.ndarray, w: int, f) -> np.ndarray:
    """f over each run of w elements, by doubling."""
    size, out = 1, x
    while 2 * size <= w:
        out = f(out[:-size], out[size:])
        size *= 2
    return f(out[: len(x) - w + 1], out[w - size : w - size + len(x) - w + 1]) if size < w else out


def anchor_rows(b: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Anchors of the texts b[starts[i]:starts[i + 1]] that own a string: (text, position in b, key, full, least offset, largest offset)."""
    n = len(b)
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.uint64, np.int64, np.int64))
    if n < SPAN:
        return none
    hashes = Hashes(b)
    h = np.maximum((mixed(hashes.grams(K)) >> np.uint64(32)).astype(np.uint32), 1)
    low = _sliding(h, W, np.minimum)
    # Runs that would cross the end of a text count for nothing.
    for s in starts[1:-1].tolist():
        low[max(0, s - W - K + 2) : s] = 0
    chosen = _sliding(np.concatenate([np.zeros(W - 1, np.uint32), low, np.zeros(len(h) - len(low), np.uint32)]), W, np.maximum) == h
    x = np.flatnonzero(chosen)
    t = np.searchsorted(starts, x, "right") - 1
    s, e = starts[t], starts[t + 1]
    previous = np.full(len(x), -(1 << 40))
    previous[1:] = np.where(t[1:] == t[:-1], x[:-1], -(1 << 40))
    most = np.minimum(np.minimum(x - previous + FIRST - 1, LAST), x - s)
    least = np.maximum(FIRST, x - (e - SPAN))
    ok = least <= most
    x, t, least, most = x[ok], t[ok], least[ok], most[ok]
    key = mixed(hashes.of(x - BEFORE, x + AFTER))
    full = mixed(Hashes(b, 1).of(x - most, x - least + SPAN) + (most * 256 + least).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return t, x, key, full, least, most
