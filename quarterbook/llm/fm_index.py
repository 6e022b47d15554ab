"""A compressed FM-index over words: suffix array, Burrows-Wheeler transform in a wavelet matrix, backward search.

All queries of a call go through the index side by side: each backward step maps the borders of every
query's interval through the levels of the wavelet matrix.
"""

from __future__ import annotations

import numpy as np


class Bits:
    """A bit vector in words of 64 bits, with the ones before each word."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(np.concatenate([bits, np.zeros(64 - len(bits) % 64, bits.dtype)]), bitorder="little").view("<u8")
        self.words = packed
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)])[:-1].astype(np.int32)
        self.zeros = len(bits) - int(bits.sum())

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        at = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[at] + np.bitwise_count(self.words[at] & mask)


class Wavelet:
    """Rank of symbols over a sequence of numbers below `limit`."""

    def __init__(self, sequence: np.ndarray, limit: int):
        self.levels = []
        for k in reversed(range(max(1, (limit - 1).bit_length()))):
            bits = (sequence >> k) & 1
            self.levels.append((k, Bits(bits)))
            sequence = np.concatenate([sequence[bits == 0], sequence[bits == 1]])
        self.base = self.walk(np.arange(limit), np.zeros(limit, np.int32))

    def walk(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for k, bits in self.levels:
            ones = bits.ones(i)
            i = np.where((symbol >> k) & 1, ones + np.int32(bits.zeros), i - ones)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often the symbol stands before position i."""
        return self.walk(symbol, i) - self.base[symbol]


class FMIndex:
    """An index of texts, rows of symbols from 1 that follow each other; a text's suffixes end at its border, so no match goes over it."""

    def __init__(self, symbols: np.ndarray, lengths: np.ndarray):
        self.limit = 1 + int(symbols.max(initial=0))
        n = len(symbols) + len(lengths)
        sequence, owner = np.zeros(n, np.int64), np.repeat(np.arange(len(lengths)), lengths + 1)
        inside = np.ones(n, bool)
        ends = np.cumsum(lengths + 1) - 1
        inside[ends] = False
        sequence[inside] = symbols
        suffixes = self._sorted(sequence, ends, int(lengths.max(initial=0)) + 1)
        self.owner = owner[suffixes]
        before = sequence[suffixes - 1]
        before[suffixes == 0] = 0
        self.wavelet = Wavelet(before, self.limit)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(sequence, minlength=self.limit))]).astype(np.int32)

    @staticmethod
    def _sorted(sequence: np.ndarray, ends: np.ndarray, longest: int) -> np.ndarray:
        """The suffix array by prefix doubling; borders are ordered by place, so ranks differ after `longest` symbols."""
        n = len(sequence)
        key = sequence + len(ends)
        key[ends] = np.arange(len(ends))
        order = np.argsort(key, kind="stable")
        reach = 1
        while True:
            ordered = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.concatenate([[0], (ordered[1:] != ordered[:-1]).astype(np.int64)]))
            if reach >= longest or rank[order[-1]] == n - 1:
                return order
            after = np.zeros(n, np.int64)
            after[: n - reach] = rank[reach:] + 1
            key = rank * (n + 1) + after
            order = np.argsort(key, kind="stable")
            reach *= 2

    def matches(self, queries: np.ndarray, ends: np.ndarray, most: int, fewest: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics: for each end (exclusive) in the row of symbols `queries`, the length, up to `most`, of the longest match
        that ends there in at least `fewest` places, and its interval of suffixes [low, high). Symbol 0 and symbols outside the index match nothing.
        """
        length = np.zeros(len(ends), np.int32)
        low, high = np.zeros(len(ends), np.int32), np.full(len(ends), self.first[-1], np.int32)
        live = np.arange(len(ends))
        for step in range(most):
            at = ends[live] - 1 - step
            symbol = np.where(at >= 0, queries[at], 0)
            on = (symbol > 0) & (symbol < self.limit)
            live, symbol = live[on], symbol[on]
            both = self.wavelet.rank(np.concatenate([symbol, symbol]), np.concatenate([low[live], high[live]])) + np.concatenate([self.first[symbol]] * 2)
            a, b = both[: len(live)], both[len(live) :]
            on = b - a >= fewest
            live = live[on]
            low[live], high[live] = a[on], b[on]
            length[live] += 1
            if not len(live):
                break
        return length, low, high
