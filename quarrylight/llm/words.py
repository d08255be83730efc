r"""Words, lines and windows of many texts at once, as numpy arrays over Arrow's own buffers.

A word is a run of bytes outside 0x20 and 0x09-0x0D (`[^\x20\x09-\x0D]+`); in UTF-8 those bytes are only ever white space.
Hashes are polynomials modulo 2**64 with odd multipliers, mixed at the end: the hash of any stretch comes from two prefix
sums. They depend on nothing but the content, so every executor and run agrees.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 256 << 10
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(multiplier: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """multiplier**i and its inverse**i modulo 2**64 for i < n, kept and grown as needed."""
    if multiplier not in _powers or len(_powers[multiplier][0]) < n:
        size = max(n, CHUNK_BYTES + 1024)
        both = []
        for m in (multiplier, pow(multiplier, -1, 1 << 64)):
            p = np.full(size, m, np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _powers[multiplier] = tuple(both)
    up, down = _powers[multiplier]
    return up[:n], down[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    part = h >> np.uint64(30)
    out = h ^ part
    out *= np.uint64(0xBF58476D1CE4E5B9)
    np.right_shift(out, np.uint64(27), out=part)
    out ^= part
    out *= np.uint64(0x94D049BB133111EB)
    np.right_shift(out, np.uint64(31), out=part)
    out ^= part
    return out


def prefix_sums(symbols: np.ndarray, multiplier: int) -> np.ndarray:
    """sums[i]: the polynomial of symbols[:i]; symbols: uint64, none of them 0 for its own sake."""
    up, _ = powers(multiplier, len(symbols) + 1)
    out = np.empty(len(symbols) + 1, np.uint64)
    out[0] = 0
    np.multiply(symbols, up[: len(symbols)], out=out[1:])
    np.cumsum(out[1:], out=out[1:])
    return out


def stretches(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, multiplier: int) -> np.ndarray:
    """Hashes of symbols[starts:ends]; equal content gives equal hashes wherever it lies."""
    _, down = powers(multiplier, len(sums))
    raw = (sums[ends] - sums[starts]) * down[starts]
    return mixed(raw + (ends - starts).astype(np.uint64) * np.uint64(0xFF51AFD7ED558CCD))


def windows(symbols: np.ndarray, k: int, multiplier: int = MULTIPLIERS[0]) -> np.ndarray:
    """Hash of symbols[i:i + k] for every i that has room; windows across documents are the caller's to leave out."""
    n = len(symbols) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sums = prefix_sums(symbols, multiplier)
    _, down = powers(multiplier, n)
    return mixed((sums[k:] - sums[:-k]) * down)


class Texts:
    """Some documents' texts: bytes, words and their hashes. Null texts are empty."""

    def __init__(self, column: pa.Array, lower: bool = False):
        column = column.cast(pa.large_binary())
        valid, buffer, data = None, *column.buffers()[1:]
        offsets = np.frombuffer(buffer, np.int64, len(column) + 1, column.offset * 8)
        self.n = len(column)
        raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        sizes = np.diff(offsets)
        if column.null_count:
            sizes = np.where(np.asarray(column.is_valid()), sizes, 0)
        if sizes.sum() == offsets[-1] - offsets[0]:
            self.bytes = raw[offsets[0] : offsets[-1]]
        else:
            self.bytes = np.concatenate([raw[o : o + s] for o, s in zip(offsets, sizes, strict=False)] or [raw[:0]])
        self.offsets = np.concatenate([[0], np.cumsum(sizes)])
        self._kept: dict[int, np.ndarray] = {}
        if lower:
            self.bytes = _LOWER[self.bytes]

    @cached_property
    def _edges(self) -> tuple[np.ndarray, np.ndarray]:
        inside = ~_SPACE[self.bytes]
        begin = inside.copy()
        begin[1:] &= ~inside[:-1]
        firsts = self.offsets[:-1][np.diff(self.offsets) > 0]
        begin[firsts] = inside[firsts]
        end = inside.copy()
        end[:-1] &= ~inside[1:]
        lasts = firsts[1:] - 1
        end[lasts] = inside[lasts]
        return np.flatnonzero(begin), np.flatnonzero(end) + 1

    @property
    def starts(self) -> np.ndarray:
        return self._edges[0]

    @property
    def ends(self) -> np.ndarray:
        return self._edges[1]

    @cached_property
    def word_offsets(self) -> np.ndarray:
        """Document d has words word_offsets[d]:word_offsets[d + 1]."""
        return np.searchsorted(self.starts, self.offsets)

    def _sums(self, multiplier: int) -> np.ndarray:
        if multiplier not in self._kept:
            self._kept[multiplier] = prefix_sums(self.bytes.astype(np.uint64) + np.uint64(1), multiplier)
        return self._kept[multiplier]

    def word_hashes(self, multiplier: int = MULTIPLIERS[0]) -> np.ndarray:
        return stretches(self._sums(multiplier), self.starts, self.ends, multiplier)

    def count(self, table: np.ndarray) -> np.ndarray:
        """For each document, its bytes b with table[b]."""
        sums = np.concatenate([[0], np.cumsum(table[self.bytes])])
        return sums[self.offsets[1:]] - sums[self.offsets[:-1]]

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """document, start, end and hash of each line that has a word (lines end at \\n)."""
        breaks = np.flatnonzero(self.bytes == 10)
        starts = np.union1d(breaks + 1, self.offsets[:-1])
        starts = starts[starts < len(self.bytes)]
        ends = np.minimum(np.concatenate([starts[1:], [len(self.bytes)]]), len(self.bytes))
        ends = np.where((ends > starts) & (self.bytes[ends - 1] == 10), ends - 1, ends) if len(starts) else ends
        has = np.searchsorted(self.starts, ends) > np.searchsorted(self.starts, starts)
        starts, ends = starts[has], ends[has]
        doc = np.searchsorted(self.offsets, starts, side="right") - 1
        return doc, starts, ends, stretches(self._sums(MULTIPLIERS[0]), starts, ends, MULTIPLIERS[0])

    def word_text(self, d: int) -> list[bytes]:
        return self.bytes[self.offsets[d] : self.offsets[d + 1]].tobytes().split()


def chunks(batch: pa.RecordBatch, text: int, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `limit` bytes of text each, so that arrays stay small; a longer text stands alone."""
    column = batch.column(text)
    sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0), np.int64) if len(column) else []
    at = total = 0
    for i, size in enumerate(sizes):
        if i > at and total + size > limit:
            yield batch.slice(at, i - at)
            at, total = i, 0
        total += size
    if at < len(column):
        yield batch.slice(at)


def tidy(run: Callable) -> Callable:
    """A task function that gives its memory back at the end: a worker serves many tasks, and its executor has a limit."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # only glibc has it
            ctypes.CDLL("libc.so.6").malloc_trim(0)

    return tidied


def within(offsets: np.ndarray, k: int, total: int) -> np.ndarray:
    """Which of the windows of k words starting at 0..total-k lie in one document."""
    ok = np.ones(max(total - k + 1, 0), bool)
    for back in range(1, k):
        at = offsets[1:-1] - back
        ok[at[(at >= 0) & (at < len(ok))]] = False
    return ok
