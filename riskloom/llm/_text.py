"""Vectorised text access for Arrow batches: whole texts as one byte buffer, words and their hashes.

A text column arrives as one UTF-8 buffer with offsets. Words are found and hashed for all the texts
of a slice at once with numpy; a slice holds at most ``SLICE_BYTES`` or one text, so that memory
follows the longest text, not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20
#: The bytes that separate words: space and 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
_ODD = 0x9E3779B97F4A7C15
_BASE = 0xD6E8FEB86659FD93


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words (shift-multiply rounds)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: A random 64-bit number for each byte; the folded table gives A-Z the numbers of a-z.
BYTE_CODES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD))
FOLDED_CODES = BYTE_CODES.copy()
FOLDED_CODES[65:91] = BYTE_CODES[97:123]

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the hash base modulo 2**64, and of its inverse."""
    if len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    large = pa.large_binary()
    column = column.cast(pa.large_string()).cast(large) if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else column.cast(large)
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, or of one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


class Words:
    """The words of the texts data[offsets[i]:offsets[i+1]].

    ``start`` and ``end`` are byte places, ``first[i]:first[i+1]`` are the words of text i, ``hash``
    is a 64-bit hash of each word's bytes. ``separators`` marks bytes that are in no word.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, codes: np.ndarray = FOLDED_CODES, separators: np.ndarray = SPACE):
        n = len(data)
        inside = ~separators[data]
        before = np.empty(n, bool)
        before[:1] = False
        before[1:] = inside[:-1]
        edges = offsets[:-1][offsets[:-1] < n]
        before[edges] = False
        self.start = np.flatnonzero(inside & ~before)
        after = np.empty(n, bool)
        after[-1:] = False
        after[:-1] = inside[1:]
        after[edges[edges > 0] - 1] = False
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, offsets)
        power, inverse = powers(n + 1)
        self._sum = np.zeros(n + 1, np.uint64)
        np.cumsum(codes[data] * power[:n], out=self._sum[1:])
        self._inverse = inverse
        self.hash = self.part(self.start, self.end)

    def part(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the byte ranges start:end."""
        return mix64((self._sum[end] - self._sum[start]) * self._inverse[start] + (end - start).astype(np.uint64) * np.uint64(_ODD))

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def code_points(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Code points before each byte place of one text."""
    seen = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=seen[1:])
    return seen[places]
