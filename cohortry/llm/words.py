"""Words and word hashes of whole texts, computed over Arrow string columns without a Python loop over words.

A word is a maximal run of bytes other than space and 0x09-0x0D; A-Z are lower-cased first. Hashes have 64 bits.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_MIX_1, _MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLDEN = 0x9E3779B97F4A7C15
_BASE = 0x5851F42D4C957F2D
_WORD = 1 << 64


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * _MIX_1
    h = (h ^ (h >> np.uint64(27))) * _MIX_2
    return h ^ (h >> np.uint64(31))


def odd_factor(k: int) -> np.uint64:
    """The k-th of a row of odd factors."""
    return np.uint64((_GOLDEN * (2 * k + 3) | 1) % _WORD)


def give_back() -> None:
    """Return freed memory to the system: a worker waits between tasks and stages, and others need the room."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def text_buffers(column: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Split a string column into slices of about ``limit`` bytes (a longer text is a slice of its own).

    Yields the first row of the slice, its bytes and the offsets of its texts in them. NULL counts as empty.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    offsets = offsets[column.offset:column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        end = min(end, len(column))
        yield row, data[offsets[row]:offsets[end]], offsets[row:end + 1] - offsets[row]
        row = end
    give_back()


class WordHasher:
    """Hashes the words of byte buffers; keeps its power tables between buffers.

    ``fold`` lower-cases A-Z; ``digits`` reads every digit as 0.
    """

    def __init__(self, fold: bool = True, digits: bool = False) -> None:
        self.space = np.zeros(256, bool)
        self.space[[0x20, *range(0x09, 0x0E)]] = True
        self.lower = np.arange(256, dtype=np.uint64)
        if fold:
            self.lower[0x41:0x5B] += np.uint64(32)
        if digits:
            self.lower[0x30:0x3A] = 0x30
        self.lower += np.uint64(1)
        self.power = self.inverse = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.power) < n:
            n = max(n, 1 << 16)
            for name, base in (("power", _BASE), ("inverse", pow(_BASE, -1, _WORD))):
                factors = np.full(n, base, np.uint64)
                factors[0] = 1
                setattr(self, name, np.cumprod(factors))

    def spans(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of all words, and the index of the first word of each text (one entry more than texts)."""
        inside = ~self.space[data]
        start = inside.copy()
        start[1:] &= self.space[data[:-1]]
        begins = offsets[:-1][offsets[:-1] < len(data)]
        start[begins] = inside[begins]
        end = inside
        end[:-1] &= self.space[data[1:]] | start[1:]
        starts = np.flatnonzero(start)
        return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)

    def words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The hash of each word, and the index of the first word of each text."""
        starts, ends, first = self.spans(data, offsets)
        return self.hashes(self.lower[data], starts, ends), first

    def hashes(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The hash of each span of a sequence of values."""
        self._grow(len(values) + 1)
        total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.power[:len(values)], out=total[1:])
        found = (total[ends] - total[starts]) * self.inverse[starts]
        return mix(found + (ends - starts).astype(np.uint64) * np.uint64(_GOLDEN))


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """The hash of each run of ``size`` words; the whole sequence as one where it is shorter."""
    if len(words) == 0:
        return words
    n = min(size, len(words))
    out = np.full(len(words) - n + 1, _GOLDEN * (size - n) % _WORD, np.uint64)
    for k in range(n):
        out += words[k:len(words) - n + 1 + k] * odd_factor(k)
    return mix(out)
