"""Vectorised views of Arrow string columns.

A block is a run of rows whose UTF-8 bytes fit in a bound; words, lines and
their 64-bit hashes are found for all rows of a block at once with numpy, so the
cost per byte stays near that of a few array passes. A row is never cut: a text
longer than the bound is a block of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
U = np.uint64
_B = 0x9E3779B97F4A7C15
_BINV = pow(_B, -1, 1 << 64)
_K1, _K2, _K3 = U(0xFF51AFD7ED558CCD), U(0xC4CEB9FE1A85EC53), U(0x9FB21C651E98DF25)
_POW: dict[int, np.ndarray] = {}

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Bytes of `[^\x20\x09-\x0D]+`; bytes of longer code points belong to words.
WORD = ~SPACE
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing A-Z.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of a 64-bit hash; a bijection, so it adds no collisions."""
    h = h ^ (h >> U(33))
    h = h * _K1
    h ^= h >> U(33)
    h *= _K2
    h ^= h >> U(33)
    return h


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the hash base and of its inverse modulo 2**64."""
    if 0 not in _POW or len(_POW[0]) < n:
        size = max(n, BLOCK_BYTES + 1)
        for key, base in ((0, _B), (1, _BINV)):
            table = np.full(size, U(base))
            table[0] = 1
            _POW[key] = np.cumprod(table)
    return _POW[0][:n], _POW[1][:n]


class Block:
    """Bytes of some rows: ``buf`` joined, row i at ``off[i]:off[i+1]``; null is empty and marked in ``null``."""

    def __init__(self, buf: np.ndarray, off: np.ndarray, null: np.ndarray, lo: int = 0):
        self.buf, self.off, self.null, self.lo, self.n = buf, off, null, lo, len(off) - 1
        self._prefix: np.ndarray | None = None

    def text(self, i: int) -> bytes:
        return self.buf[self.off[i] : self.off[i + 1]].tobytes()

    def lowered(self) -> "Block":
        return Block(LOWER[self.buf], self.off, self.null, self.lo)

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sum of a value per byte, for each row."""
        total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
        return total[self.off[1:]] - total[self.off[:-1]]

    def row_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.off, at, "right") - 1

    def runs(self, is_in: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and row of each maximal run of marked bytes within a row."""
        m = is_in[self.buf] if is_in.dtype == bool and len(is_in) == 256 else is_in
        if not len(m):
            e = np.zeros(0, np.int64)
            return e, e, e
        before = np.empty_like(m)
        before[0], before[1:] = False, m[:-1]
        edges = self.off[1:-1]
        before[edges[edges < len(m)]] = False
        start = np.flatnonzero(m & ~before)
        after = np.empty_like(m)
        after[-1], after[:-1] = False, m[1:]
        after[edges[(edges > 0) & (edges <= len(m))] - 1] = False
        end = np.flatnonzero(m & ~after) + 1
        return start, end, self.row_of(start)

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hash of each byte span; equal spans have equal hashes."""
        p, q = powers(len(self.buf) + 1)
        if self._prefix is None:
            total = np.empty(len(self.buf) + 1, U)
            total[0] = 0
            np.cumsum((self.buf.astype(U) + U(1)) * p[:-1], out=total[1:])
            self._prefix = total
        return mix((self._prefix[end] - self._prefix[start]) * q[start] + (end - start).astype(U) * _K3)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and row of each part between line feeds that isn't empty."""
        cut = np.flatnonzero(self.buf == 10)
        full = np.diff(self.off) > 0
        start = np.sort(np.concatenate((self.off[:-1][full], cut + 1)))
        end = np.sort(np.concatenate((cut, self.off[1:][full])))
        some = start < end  # an empty line is no line with a word
        return start[some], end[some], self.row_of(start[some])


def grams(h: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each k consecutive words of a row and the index of its first word."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U), np.zeros(0, np.int64)
    at = np.flatnonzero(row[k - 1 :] == row[:n])
    acc = np.zeros(n, U)
    for j in range(k):
        acc = acc * U(0xD6E8FEB86659FD93) + h[j : j + n]
    return mix(acc[at]), at


def view(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, offsets and null marks of an Arrow string column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    null = np.asarray(column.is_null())
    column = column.cast(pa.large_string()).fill_null("")
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64, len(column) + 1, column.offset * 8) if off is not None and off.size else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data, off, null


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Blocks of whole rows, of at most ``limit`` bytes where one row isn't longer."""
    data, off, null = view(column)
    lo, n = 0, len(null)
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        hi = min(hi, n, lo + (limit >> 3))
        yield Block(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], null[lo:hi], lo)
        lo = hi


def repeated(key: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marks of entries equal to an entry before it in the same row, and of entries with any equal."""
    n = len(key)
    later, some = np.zeros(n, bool), np.zeros(n, bool)
    if n > 1:
        k = mix(key ^ (row.astype(U) * _K3))
        order = np.argsort(k, kind="stable")
        same = (k[order][1:] == k[order][:-1]) & (row[order][1:] == row[order][:-1])
        later[order[1:][same]] = True
        some[order[1:][same]] = some[order[:-1][same]] = True
    return later, some


def distinct(key: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of each row, sorted by row and then key."""
    order = np.lexsort((key, row))
    k, r = key[order], row[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (r[1:] != r[:-1])
    return k[new], r[new]


def per_row(row: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    out = np.bincount(row, weights, n)
    return out if weights is not None and weights.dtype.kind == "f" else out.astype(np.int64)
