"""Vectorised scans of UTF-8 text in Arrow batches: words, lines, substring hashes.

A ``Block`` is a run of whole documents of a few MB, so memory does not follow the
batch or partition size.  Hashes are 64 bits of a polynomial over random byte values,
finished with a mixer; different strings share one with a chance of about 2**-64.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
WHITE = bytes([0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
U = np.uint64


def lut(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U)
    out[0] = 1
    return np.cumprod(out, dtype=U)


class Hasher:
    """Hashes of substrings of one block from prefix sums."""

    BASE = 0x9E3779B97F4A7C15 | 5
    _tables: dict = {}

    def __init__(self, data: np.ndarray, seed: int = 1):
        n = len(data) + 1
        t = self._tables
        if len(t.get("p", ())) < n:
            m = max(n, BLOCK_BYTES + 1)
            t["p"], t["q"] = powers(self.BASE, m), powers(pow(self.BASE, -1, 1 << 64), m)
        table = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed))
        self.q = t["q"]
        self.sums = np.empty(n, U)
        self.sums[0] = 0
        np.cumsum(table[data] * t["p"][: n - 1], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.q[start] + (end - start).astype(U) * U(0xD6E8FEB86659FD93))


class Block:
    """Whole documents ``first .. first + n``: ``data`` bytes and ``off`` offsets (n + 1)."""

    def __init__(self, data: np.ndarray, off: np.ndarray, first: int):
        self.data, self.off, self.first, self.n = data, off, first, len(off) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.off[i] : self.off[i + 1]].tobytes()

    def counts(self, mask: np.ndarray) -> np.ndarray:
        """Number of marked bytes of each document."""
        sums = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=sums[1:])
        return sums[self.off[1:]] - sums[self.off[:-1]]

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends, and the number of words before each document (n + 1)."""
        inside = ~lut(WHITE)[self.data]
        edge = np.zeros(len(inside) + 1, bool)
        edge[self.off] = True
        prev, nxt = np.zeros_like(inside), np.zeros_like(inside)
        prev[1:], nxt[:-1] = inside[:-1], inside[1:]
        start = np.flatnonzero(inside & (~prev | edge[:-1]))
        end = np.flatnonzero(inside & (~nxt | edge[1:])) + 1
        return start, end, np.searchsorted(start, self.off)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and document of each \\n-split line."""
        cut = np.flatnonzero(self.data == 10)
        doc = np.searchsorted(self.off, cut, "right") - 1
        start = np.concatenate([self.off[:-1], cut + 1])
        end = np.concatenate([cut, self.off[1:]])
        sdoc = np.concatenate([np.arange(self.n), doc])
        order, order2 = np.lexsort((start, sdoc)), np.lexsort((end, np.concatenate([doc, np.arange(self.n)])))
        return start[order], end[order2], sdoc[order]


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table[data]


def blocks(column: pa.Array, limit: int = BLOCK_BYTES):
    """Cut a string column into blocks of at most ``limit`` bytes or one document; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield Block(data[off[i] : off[j]], off[i : j + 1] - off[i], i)
        i = j


def repeated(keys: np.ndarray) -> np.ndarray:
    """Mask of the keys that occur twice or more."""
    s = np.sort(keys)
    twice = np.unique(s[1:][s[1:] == s[:-1]])
    if not len(twice):
        return np.zeros(len(keys), bool)
    at = np.searchsorted(twice, keys)
    at[at == len(twice)] = 0
    return twice[at] == keys
