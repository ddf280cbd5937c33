"""Vectorised words and hashes of the texts of an Arrow batch (numpy only, no Spark)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_DEEP = 64
#: One random number for each place in a word and byte: tabulation hashing.
_TABLE = np.random.Generator(np.random.PCG64(20240501)).integers(0, 1 << 64, (_DEEP, 256), dtype=np.uint64).ravel()


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = x + np.uint64((salt * 2 + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_chunks(column, limit: int = 1 << 21) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of pieces of the column with about limit bytes; null counts as empty.

    A row is never cut: one longer than the limit makes a piece of its own.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_binary())
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1)
        b = min(b, n)
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


class Words:
    """Words of a piece: starts and ends in bytes, the first word of each row (bounds), the row of each word."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        word = ~_SPACE[data]
        begin, end = word.copy(), word.copy()
        begin[1:] &= ~word[:-1]
        end[:-1] &= ~word[1:]
        cut = offsets[1:-1]
        cut = cut[(cut > 0) & (cut < len(data))]
        begin[cut] = word[cut]
        end[cut - 1] = word[cut - 1]
        self.data, self._word = data, word
        self.starts = np.flatnonzero(begin)
        self.ends = np.flatnonzero(end) + 1
        self.bounds = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.bounds)
        self.rows = np.repeat(np.arange(len(offsets) - 1), self.counts)

    def hashes(self, lower: bool = False) -> np.ndarray:
        """A 64-bit hash of each word; lower folds A-Z first."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        bytes_ = self.data[self._word]
        if lower:
            bytes_ = _LOWER[bytes_]
        lens = self.ends - self.starts
        first = np.cumsum(lens) - lens
        place = np.arange(len(bytes_)) - np.repeat(first, lens)
        term = _TABLE[((place & (_DEEP - 1)) << 8) | bytes_]
        if lens.max() > _DEEP:
            term = term * ((place // _DEEP).astype(np.uint64) * np.uint64(2) + np.uint64(1))
        return mix(np.add.reduceat(term, first) + lens.astype(np.uint64))


def shingles(words: Words, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word runs and the word each starts at; a row with 1 to k - 1 words gives its whole sequence."""
    n = len(hashes)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(n, np.uint64)
    left = words.bounds[1:][words.rows] - np.arange(n)  # words from here to the row's end
    for j in range(k):
        part = np.zeros(n, np.uint64)
        part[: n - j] = mix(hashes[j:], j + 1)
        total += np.where(left > j, part, np.uint64(0))
    first = np.arange(n) == words.bounds[:-1][words.rows]
    keep = (left >= k) | (first & (left < k))
    return mix(total + np.minimum(left, k).astype(np.uint64))[keep], np.flatnonzero(keep)


def distinct_per_row(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each row (rows ascending)."""
    if not len(values):
        return rows, values
    order = np.lexsort((values, rows))
    rows, values = rows[order], values[order]
    keep = np.ones(len(values), bool)
    keep[1:] = (rows[1:] != rows[:-1]) | (values[1:] != values[:-1])
    return rows[keep], values[keep]
