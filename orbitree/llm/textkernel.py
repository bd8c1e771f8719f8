"""Vectorised word scanning shared by the text operators.

The helpers work on one slice of an Arrow text column inside a task. A *word* is a
maximal run of characters other than space and U+0009..U+000D. Those characters are
single bytes in UTF-8, so all work happens on the raw byte buffer with numpy.
Hashes are polynomial sums modulo 2**64 followed by an integer mixer; windows of words
take two independent 64-bit hashes where a false match would change a result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; one longer text is handled alone.
SLICE_BYTES = 1 << 21

_BYTE_BASE = 0x9E3779B97F4A7C15
WINDOW_BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20

_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of an odd base modulo 2**64, and of its inverse."""
    have = _tables.get(base)
    if have is None or len(have[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        made = []
        for b in (base, pow(base, -1, 1 << 64)):
            column = np.full(size, b, dtype=np.uint64)
            column[0] = 1
            made.append(np.cumprod(column, dtype=np.uint64))
        have = _tables[base] = (made[0], made[1])
    return have[0][:n], have[1][:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def mix32(x: np.ndarray) -> np.ndarray:
    """A bijection of 32-bit integers that spreads every input bit."""
    x = x ^ (x >> np.uint32(16))
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return x


def _rolled(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hashes of values[start:end], free of where the span lies."""
    up, down = powers(base, len(values) + 1)
    total = np.empty(len(values) + 1, dtype=np.uint64)
    total[0] = 0
    np.cumsum(values * up[:-1], dtype=np.uint64, out=total[1:])
    return (total[ends] - total[starts]) * down[starts]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans that do not overlap and are in order."""
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + SLICE_BYTES, side="right")))
        lo, hi = int(starts[i]), int(ends[j - 1])
        values = data[lo:hi].astype(np.uint64) + np.uint64(1)
        out[i:j] = _rolled(values, starts[i:j] - lo, ends[i:j] - lo, _BYTE_BASE)
        i = j
    return mix64(out)


@dataclass
class Words:
    """Words of consecutive texts: word i spans data[starts[i]:ends[i]], text d owns words offsets[d]:offsets[d+1]."""

    first: int
    data: np.ndarray
    text_offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    offsets: np.ndarray
    hashes: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def windows(self, k: int, base: int = WINDOW_BASES[0]) -> np.ndarray:
        """The hash of each k consecutive words; those that leave their text hold noise (see inside)."""
        n = len(self.hashes)
        if n < k:
            return np.empty(0, dtype=np.uint64)
        at = np.arange(n - k + 1)
        return mix64(_rolled(self.hashes, at, at + k, base))

    def joined(self, lo: int, hi: int) -> bytes:
        """Words lo..hi-1 joined by one space."""
        return b" ".join(self.data[s:e].tobytes() for s, e in zip(self.starts[lo:hi].tolist(), self.ends[lo:hi].tolist()))


def word_slices(column: pa.Array | pa.ChunkedArray, lower: bool = False, fold: np.ndarray | None = None) -> Iterator[Words]:
    """Scan a text column in slices of bounded size; a null text counts as empty. ``fold`` maps
    bytes before words are cut; ``lower`` folds A-Z."""
    fold = _LOWER if lower else fold
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    body = column.buffers()[2] if len(column) else None
    everything = np.frombuffer(body, dtype=np.uint8) if body is not None and body.size else np.empty(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLICE_BYTES, side="right")) - 1)
        yield _scan(i, everything[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], fold)
        i = j


def _scan(first: int, data: np.ndarray, text_offsets: np.ndarray, fold: np.ndarray | None) -> Words:
    if fold is not None:
        data = fold[data]
    n = len(data)
    if n == 0:
        none = np.empty(0, dtype=np.int64)
        return Words(first, data, text_offsets, none, none, np.zeros(len(text_offsets), np.int64), np.empty(0, np.uint64))
    space = _SPACE[data]
    before = np.empty(n, dtype=bool)
    before[0] = True
    before[1:] = space[:-1]
    after = np.empty(n, dtype=bool)
    after[-1] = True
    after[:-1] = space[1:]
    edges = text_offsets[(text_offsets > 0) & (text_offsets < n)]
    before[edges] = True
    after[edges - 1] = True
    starts = np.flatnonzero(~space & before)
    ends = np.flatnonzero(~space & after) + 1
    return Words(first, data, text_offsets, starts, ends, np.searchsorted(starts, text_offsets), span_hashes(data, starts, ends))
