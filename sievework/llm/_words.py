"""Vectorised words and hashes over the byte buffer of an Arrow string column.

A word is a maximal run of bytes other than space and 0x09-0x0D, so the rule
``[^\\x20\\x09-\\x0D]+`` holds for UTF-8 text byte by byte.  Several documents
are handled in one numpy pass; slices are cut at document borders and hold at
most ``SLICE_BYTES`` unless one document alone is longer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 512 << 10
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LOWER_TABLE = LOWER.tobytes()

_B = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n (base is odd)."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = 1 << max(12, (n - 1).bit_length())
        inv = pow(base, -1, 1 << 64)
        both = []
        for b in (base, inv):
            p = np.full(size, b, dtype=np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        have = (both[0], both[1])
        if size <= 1 << 20:  # those of a very long text alone aren't kept
            _POWERS[base] = have
    return have[0][:n], have[1][:n]


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = _B) -> np.ndarray:
    """A hash of codes[start:end] for each span, the same wherever it stands."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    up, down = powers(base, len(codes) + 1)
    sums = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[: len(codes)], out=sums[1:])
    return (sums[ends] - sums[starts]) * down[starts]


def rolling(values: np.ndarray, width: int, base: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    """A hash of each run of ``width`` consecutive values."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    at = np.arange(n)
    return mix(span_hashes(values, at, at + width, base), width)


class Slice:
    """Some documents of a batch: rows first..last, their bytes and words."""

    __slots__ = ("first", "last", "raw", "data", "starts", "ends", "word_from")

    def __init__(self, first: int, last: int, raw: np.ndarray, bounds: np.ndarray, lower: bool, gap: np.ndarray = SPACE):
        self.first, self.last, self.raw = first, last, raw
        self.data = LOWER[raw] if lower else raw
        n = len(raw)
        letter = np.ones(n + 2, dtype=bool)
        letter[0] = letter[-1] = False
        np.logical_not(gap[raw], out=letter[1:-1])
        # a document's first byte starts a word whatever stands before it
        change = letter[1:] & ~letter[:-1]
        stop = letter[:-1] & ~letter[1:]
        inner = bounds[1:-1]
        inner = inner[(inner > 0) & (inner < n)]
        joined = inner[letter[inner] & letter[inner + 1]]
        change[joined] = True
        stop[joined] = True
        self.starts = np.flatnonzero(change[:n]) if n else np.zeros(0, dtype=np.int64)
        self.ends = np.flatnonzero(stop)
        self.word_from = np.searchsorted(self.starts, bounds)  # words of row i: word_from[i]..word_from[i+1]

    def word_hashes(self) -> np.ndarray:
        return mix(span_hashes(self.data, self.starts, self.ends) + (self.ends - self.starts).astype(np.uint64))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row bounds of a string column; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    bounds = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return data, bounds


def slices(column: pa.Array, lower: bool = False, most: int = SLICE_BYTES, gap: np.ndarray = SPACE) -> Iterator[Slice]:
    if not len(column):
        return
    data, bounds = buffers(column)
    i, n = 0, len(bounds) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + most, side="right")) - 1)
        j = min(j, n)
        yield Slice(i, j, data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i], lower, gap)
        i = j
