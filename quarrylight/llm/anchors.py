"""Winnowed anchors over sequences of symbols (words or bytes), whole chunks of documents at a time.

Every window of `length` consecutive symbols of one document elects an anchor: the k-gram in it with the least hash, the
last of equals. The choice depends on the window's content alone, so equal windows have equal anchors at the same place
in them. Windows that follow each other mostly elect the same occurrence; an occurrence's span is the union of the windows
that elect it. Two occurrences are of one class if their spans and the anchor's place in them are equal: then all their
windows are equal, pair by pair.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from quarrylight.llm.words import MULTIPLIERS, mixed, powers, prefix_sums, stretches

_PLACE_BITS = 28  # a chunk has fewer symbols than 2**28


@dataclass
class Anchors:
    """Occurrences in order: document, first and last window start, the anchor's place, anchor hash, class hash."""

    symbols: np.ndarray
    length: int
    doc: np.ndarray
    first: np.ndarray
    last: np.ndarray
    at: np.ndarray
    anchor: np.ndarray
    kind: np.ndarray
    sums: list[np.ndarray]  # prefix sums of the symbols for each multiplier

    def contexts(self, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Hashes of the k-gram with so many symbols before it, and behind it, as 32 bits; 0 where no window of the occurrence
        reaches that far. A window lies `half` or more before its anchor, or it reaches as far behind: so equal windows of two
        classes have one of the hashes in common. Returns left, right, half."""
        half = (self.length - k + 1) // 2
        left, right = np.zeros(len(self.at), np.int64), np.zeros(len(self.at), np.int64)
        has = np.flatnonzero(self.first <= self.at - half)
        left[has] = stretches(self.sums[0], self.at[has] - half, self.at[has] + k, MULTIPLIERS[0]) >> np.uint64(32)
        has = np.flatnonzero(self.last > self.at - half)
        right[has] = stretches(self.sums[0], self.at[has], self.at[has] + k + half, MULTIPLIERS[0]) >> np.uint64(32)
        return left, right, half

    def window_hashes(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit hashes of the windows that start there."""
        return tuple(
            stretches(s, starts, starts + self.length, m) for s, m in zip(self.sums, MULTIPLIERS, strict=True)
        )

    def starts_of(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Window starts of some occurrences, and for each the index of its occurrence."""
        sizes = self.last[which] - self.first[which] + 1
        of = np.repeat(which, sizes)
        ends = np.cumsum(sizes)
        return self.first[of] + np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes), of


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` neighbours, by doubling."""
    have, out = 1, keys
    while 2 * have <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def elect(symbols: np.ndarray, offsets: np.ndarray, length: int, k: int) -> Anchors:
    """symbols: uint64; document d is symbols[offsets[d]:offsets[d + 1]]."""
    n = len(symbols) - length + 1
    none, nothing = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    empty = Anchors(symbols, length, none, none, none, none, nothing, nothing, [np.zeros(1, np.uint64)] * 2)
    if n <= 0:
        return empty
    # starts from which a window stays in its document
    inside = np.ones(n, bool)
    for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        inside[max(lo, hi - length + 1) : hi] = False
    starts = np.flatnonzero(inside)
    if not len(starts):
        return empty
    sums = [prefix_sums(symbols, m) for m in MULTIPLIERS]
    _, down = powers(MULTIPLIERS[0], len(symbols) - k + 1)
    grams = mixed((sums[0][k:] - sums[0][:-k]) * down)
    low = np.uint64((1 << _PLACE_BITS) - 1)
    keys = grams & ~low
    keys |= low - np.arange(len(grams), dtype=np.uint64)
    place = (low - (_least(keys, length - k + 1) & low)).astype(np.int64)
    place = place[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)
    at = np.flatnonzero(new)
    first, last = starts[at], starts[np.concatenate([at[1:], [len(starts)]]) - 1]
    doc = np.searchsorted(offsets, first, side="right") - 1
    span = stretches(sums[1], first, last + length, MULTIPLIERS[1])
    kind = mixed(span + (place[at] - first).astype(np.uint64) * np.uint64(MULTIPLIERS[0]))
    return Anchors(symbols, length, doc, first, last, place[at], grams[place[at]], kind, sums)
