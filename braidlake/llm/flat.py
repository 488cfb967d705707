"""Vectorised text primitives over Arrow batches: flat UTF-8 blocks, word bounds, range fingerprints.

Everything works on whole texts. A block is a run of consecutive rows whose UTF-8 bytes lie in one
NumPy buffer, so that the cost of a NumPy call is paid per block and not per document.
A null text counts as an empty one. A row is never split: a text above ``BLOCK`` is a block of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

BLOCK = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

#: Code units that separate words: space and U+0009..U+000D.
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BYTE_CODE = np.random.default_rng(20240607).integers(1, 2**63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def text_blocks(column: pa.Array, limit: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of the rows and the end) for consecutive blocks of a text column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    kind = pa.large_binary()
    column = column.cast(pa.large_string()).cast(kind) if pa.types.is_string(column.type) else column.cast(kind)
    n = len(column)
    if not n:
        return
    _, offset_buffer, data = column.buffers()
    offsets = np.frombuffer(offset_buffer, np.int64)[column.offset : column.offset + n + 1]
    flat = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        end = min(max(end, at + 1), n)
        yield at, end, flat[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads all 64 bits."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(32)
    return x


@lru_cache(maxsize=2)
def _powers(log2: int) -> tuple[np.ndarray, np.ndarray]:
    n = (1 << log2) + 1
    up, down = np.full(n, _BASE), np.full(n, _INV)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


class Ranges:
    """Fingerprint of any range of a token sequence in constant time (polynomial over the 64-bit ring)."""

    def __init__(self, tokens: np.ndarray):
        n = len(tokens)
        up, self._down = _powers(max(20, int(n).bit_length()))
        self._sum = np.zeros(n + 1, np.uint64)
        np.cumsum(tokens * up[:n], out=self._sum[1:])

    def raw(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self._sum[end] - self._sum[start]) * self._down[start]

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix(self.raw(start, end) ^ ((end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))

    def pair(self, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rank pair of a range: fingerprints of its first half and of what stands half its length further on."""
        start = np.asarray(start)
        half = start + np.asarray(length) // 2
        return self.of(start, half).view(np.int64), self.of(half, start + length).view(np.int64)

    def every(self, k: int) -> np.ndarray:
        """Mixed fingerprints of all ranges of k tokens."""
        n = len(self._sum) - k
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mix((self._sum[k:] - self._sum[:n]) * self._down[:n])


def byte_codes(flat: np.ndarray) -> np.ndarray:
    return _BYTE_CODE[flat]


def words(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, row offsets in words) of the runs free of separators; a run never crosses a row."""
    n = len(flat)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = ~SEPARATOR[flat]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
    return starts, ends, np.searchsorted(starts, offsets)


def word_codes(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit fingerprints of words."""
    return Ranges(byte_codes(LOWER[flat] if lower else flat)).of(starts, ends)


def sliding(values: np.ndarray, width: int, f=np.minimum) -> np.ndarray:
    """Minimum (or maximum) over each run of ``width`` values."""
    done = 1
    while done * 2 <= width:
        values = f(values[:-done], values[done:])
        done *= 2
    return values if done == width else f(values[: len(values) - (width - done)], values[width - done :])


def segments(offsets: np.ndarray, limit: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Pieces of a long row that overlap, so that each window of overlap + 1 lies whole in one piece."""
    n, at = int(offsets[-1]), 0
    while True:
        yield at, min(n, at + limit + overlap)
        at += limit
        if at + overlap >= n:
            return
