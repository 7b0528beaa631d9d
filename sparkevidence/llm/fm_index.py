"""An FM-index over a sequence of small integers: suffix sort, wavelet matrix, backward search.

The sequence holds runs of symbols (1 and up), each closed by a symbol 0. All searches are vectorised
over the patterns. The index keeps the Burrows-Wheeler transform as packed bit planes with sampled
ranks, and every ``sample``-th suffix position as well as each run's start.
"""

from __future__ import annotations

import numpy as np

_BLOCK = 64
_BELOW = ((np.uint64(1) << np.arange(64, dtype=np.uint64)) - np.uint64(1)).astype(np.uint64)


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Order of all suffixes; a suffix ends at its separator, equal ones follow by position."""
    n = len(symbols)
    rank = symbols.astype(np.int64)
    stop = np.flatnonzero(symbols == 0)
    # each separator is a symbol of its own, so no two suffixes stay equal
    rank[rank > 0] += n
    rank[stop] = np.arange(len(stop))
    order = np.argsort(rank, kind="stable")
    sorted_rank = rank[order]
    head = np.concatenate(([True], sorted_rank[1:] != sorted_rank[:-1])) if n else np.empty(0, bool)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    open_at = np.flatnonzero(~(head & np.append(head[1:], True))) if n else np.empty(0, np.int64)
    step = 1
    while len(open_at):
        at = order[open_at]
        after = at + step
        second = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        key = rank[at] * np.int64(n + 2) + second
        by = np.argsort(key, kind="stable")
        key, order[open_at] = key[by], at[by]
        head = np.concatenate(([True], key[1:] != key[:-1]))
        new = open_at[np.maximum.accumulate(np.where(head, np.arange(len(key)), 0))]
        rank[order[open_at]] = new
        open_at = open_at[~(head & np.append(head[1:], True))]
        step *= 2
    return order


class WaveletMatrix:
    """Ranks of symbols in a sequence by one packed bit plane for each bit, highest first."""

    def __init__(self, values: np.ndarray, bits: int):
        self.n, self.bits = len(values), bits
        self.planes, self.ranks, self.zeros = [], [], []
        for bit in range(bits - 1, -1, -1):
            ones = (values >> bit & 1).astype(bool)
            padded = np.zeros((self.n // _BLOCK + 1) * _BLOCK, dtype=bool)
            padded[: self.n] = ones
            plane = np.packbits(padded, bitorder="little").view(np.uint64)
            self.planes.append(plane)
            count = np.bitwise_count(plane).astype(np.int64)
            self.ranks.append(np.concatenate(([0], np.cumsum(count)))[:-1])
            self.zeros.append(self.n - int(ones.sum()))
            values = np.concatenate((values[~ones], values[ones]))

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        block, rest = at >> 6, at & 63
        return self.ranks[level][block] + np.bitwise_count(self.planes[level][block] & _BELOW[rest])

    def bounds(
        self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of ``symbol`` before low and before high on the last plane, and its first place."""
        start = np.zeros_like(low)
        for level in range(self.bits):
            ones = (symbol >> (self.bits - 1 - level) & 1).astype(bool)
            out = []
            for at in (low, high, start):
                up = self._ones(level, at)
                out.append(np.where(ones, self.zeros[level] + up, at - up))
            low, high, start = out
        return low, high, start

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols at some places and how often each occurs before its place."""
        start, symbol = np.zeros_like(at), np.zeros_like(at)
        for level in range(self.bits):
            block, rest = at >> 6, (at & 63).astype(np.uint64)
            ones = (self.planes[level][block] >> rest & np.uint64(1)).astype(bool)
            symbol = symbol << 1 | ones
            for name in ("at", "start"):
                value = at if name == "at" else start
                up = self._ones(level, value)
                value = np.where(ones, self.zeros[level] + up, value - up)
                if name == "at":
                    at = value
                else:
                    start = value
        return symbol, at - start


class FMIndex:
    def __init__(self, symbols: np.ndarray, sample: int = 16):
        self.n = len(symbols)
        order = suffix_order(symbols)
        self.sigma = int(symbols.max(initial=0)) + 1
        counts = np.bincount(symbols, minlength=self.sigma)
        self.first = np.concatenate(([0], np.cumsum(counts)))
        last = symbols[order - 1] if self.n else symbols
        self.bwt = WaveletMatrix(last.astype(np.int64), max(1, int(self.sigma - 1).bit_length()))
        self.sample = sample
        kept = (order % sample == 0) | (last == 0)
        self.marked = np.flatnonzero(kept)
        self.position = order[kept]
        self.order = order

    def compact(self) -> FMIndex:
        """Drop the full suffix order; what is left is the compressed index."""
        self.order = None
        return self

    def extend(
        self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the patterns with one more symbol before them (one backward step)."""
        low, high, start = self.bwt.bounds(symbol, low, high)
        return self.first[symbol] + low - start, self.first[symbol] + high - start

    def search(
        self, text: np.ndarray, end: np.ndarray, length: np.ndarray, stop_at_one: bool = False
    ) -> tuple[np.ndarray, np.ndarray]:
        """Suffix intervals of the patterns ``text[end - length : end]``; empty ones have low >= high.

        Symbols of 0 or beyond the alphabet occur nowhere. With ``stop_at_one`` a search ends when
        one suffix is left, for patterns that are known to occur.
        """
        least = int(stop_at_one)
        low, high = np.zeros(len(end), np.int64), np.full(len(end), self.n, np.int64)
        for step in range(int(length.max(initial=0))):
            alive = np.flatnonzero((length > step) & (high - low > least))
            symbol = text[end[alive] - 1 - step]
            known = (symbol > 0) & (symbol < self.sigma)
            high[alive[~known]] = low[alive[~known]]
            alive, symbol = alive[known], symbol[known]
            if step == 0:
                low[alive], high[alive] = self.first[symbol], self.first[symbol + 1]
            else:
                low[alive], high[alive] = self.extend(symbol, low[alive], high[alive])
        return low, high

    def locate(self, place: np.ndarray) -> np.ndarray:
        """Text positions of suffixes, walking back to the next sampled one."""
        out, steps = np.full(len(place), -1, np.int64), np.zeros(len(place), np.int64)
        at, left = place.copy(), np.arange(len(place))
        while len(left):
            found = np.searchsorted(self.marked, at[left])
            hit = (found < len(self.marked)) & (
                self.marked[np.minimum(found, len(self.marked) - 1)] == at[left]
            )
            done = left[hit]
            out[done] = self.position[found[hit]] + steps[done]
            left = left[~hit]
            symbol, before = self.bwt.access(at[left])
            at[left] = self.first[symbol] + before
            steps[left] += 1
        return out
