"""Words of many texts at once, as arrays.

A word is a run of characters other than the space and U+0009 to U+000D.  Those
are single bytes in UTF-8 and no part of any other character, so words are found
on bytes.  An Arrow column is cut into slices of whole texts, and a slice is
handled by a fixed number of array operations; memory follows the slice, which
is ``SLICE_BYTES`` or the one text that is longer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 19
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeds(n: int, seed: int) -> np.ndarray:
    """``n`` fixed odd numbers."""
    steps = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return mix(steps + np.uint64(seed)) | np.uint64(1)


BYTE_CODES = seeds(256, 11)
BASE = 0x5851F42D4C957F2D
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """``base`` to the powers 0 to ``n - 1``, modulo 2**64."""
    if base not in _powers or len(_powers[base]) < n:
        # every worker keeps them, so they are few more than needed
        steps = np.full(max(1, (n + 0xFFFF) >> 16) << 16, base, np.uint64)
        steps[0] = 1
        _powers[base] = np.cumprod(steps)
        if n > 8 * SLICE_BYTES:  # of one very long text; not kept
            return _powers.pop(base)[:n]
    return _powers[base][:n]


def rolled(codes: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """Hashes of the runs ``codes[start:end]``, equal for equal runs."""
    inverse = pow(base, -1, 1 << 64)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * powers(base, len(codes)), out=sums[1:])
    return mix((sums[end] - sums[start]) * powers(inverse, len(codes) + 1)[start])


class Words:
    """The words of a slice of texts: ``start`` and ``end`` bytes, ``text`` number."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        self.texts = len(offsets) - 1
        ink = ~SPACE[data]
        n = len(data)
        edge = np.zeros(n + 1, bool)  # a text begins here
        edge[offsets] = True
        before = np.ones(n, bool)
        before[1:] = ~ink[:-1]
        after = np.ones(n, bool)
        after[:-1] = ~ink[1:]
        self.start = np.flatnonzero(ink & (before | edge[:n]))
        self.end = np.flatnonzero(ink & (after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, offsets)  # of each text, and the end
        self.counts = np.diff(self.first)
        self.text = np.repeat(np.arange(self.texts), self.counts)

    def hashes(self, lower: bool = False) -> np.ndarray:
        codes = BYTE_CODES[LOWER[self.data]] if lower else BYTE_CODES[self.data]
        return rolled(codes, self.start, self.end, BASE)

    def window_starts(self, size: int) -> np.ndarray:
        """Numbers of the words at which ``size`` words of one text start."""
        n = len(self.start)
        if n < size:
            return np.zeros(0, np.int64)
        return np.flatnonzero(self.text[:n - size + 1] == self.text[size - 1:])


def windows(hashes: np.ndarray, starts: np.ndarray, size: int, base: int) -> np.ndarray:
    """Hashes of the ``size`` words from each of ``starts``."""
    return rolled(hashes, starts, starts + size, base)


def slices(column: pa.Array, limit: int = SLICE_BYTES
           ) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First and last row, bytes and offsets of runs of whole texts; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[
        column.offset:column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    low = 0
    while low < len(column):
        high = int(np.searchsorted(offsets, offsets[low] + limit, side="right")) - 1
        high = min(max(high, low + 1), len(column))
        yield low, high, data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low]
        low = high


def per_text(values: np.ndarray, words: Words) -> np.ndarray:
    """Sums of ``values``, one per word, by text."""
    sums = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[words.first[1:]] - sums[words.first[:-1]]


def per_text_bytes(flags: np.ndarray, words: Words) -> np.ndarray:
    """Sums of ``flags``, one per byte, by text."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[words.offsets[1:]] - sums[words.offsets[:-1]]
