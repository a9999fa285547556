"""A compressed FM-index over the words of a shard: wavelet matrix, sampled places, backward search for many patterns at a time."""

from __future__ import annotations

import numpy as np

#: Of a segment's places, one in so many is kept; others are reached from it by steps backwards.
RATE = 8


class Bits:
    """A packed bit vector with rank: 64 bits a word, a running count a word."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, dtype=np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)]).astype(np.uint32)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """How many of the first `at` bits are set."""
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        low = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[word].astype(np.int64) + np.bitwise_count(low)

    def get(self, at: np.ndarray) -> np.ndarray:
        return ((self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)


class FMIndex:
    """Counts and locates patterns in segments, laid end to end as symbols 1.. with a separator 0 after each.

    Kept are the wavelet matrix of the symbols before each suffix and the places of one in RATE suffixes of a segment; neither the
    suffix array nor the text is. Separators differ in the order of suffixes, so that no comparison goes beyond a segment.
    """

    def __init__(self, text: np.ndarray, symbols: int, inside: np.ndarray):
        suffixes = _suffix_order(text, int(inside.max(initial=0)) + 1)
        marked = inside[suffixes] % RATE == 0
        self.marked, self.places = Bits(marked), suffixes[marked].astype(np.uint32)
        column = text[suffixes - 1].astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols + 1))])
        self.levels = []
        for level in range(max(1, int(symbols).bit_length()) - 1, -1, -1):
            bit = (column >> level) & 1
            self.levels.append((level, Bits(bit), int(len(bit) - bit.sum())))
            column = np.concatenate([column[bit == 0], column[bit == 1]])
        self.base = self._down(np.arange(symbols + 1), np.zeros(symbols + 1, dtype=np.int64))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, bits, zeros in self.levels:
            ones = bits.rank(at)
            at = np.where((symbol >> level) & 1, zeros + ones, at - ones)
        return at

    def _before(self, at: np.ndarray) -> np.ndarray:
        """The row of the suffix one place earlier, for rows whose suffix doesn't start a segment."""
        symbol = np.zeros(len(at), dtype=np.int64)
        for level, bits, zeros in self.levels:
            one, ones = bits.get(at), bits.rank(at)
            symbol |= one.astype(np.int64) << level
            at = np.where(one, zeros + ones, at - ones)
        return self.starts[symbol] + at - self.base[symbol]

    def step(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The bound of the suffixes that start with symbol and go on as those before bound `at`."""
        return self.starts[symbol] + self._down(symbol, at) - self.base[symbol]

    def matching(self, stream: np.ndarray, ends: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(length, lo, hi) for each end in a stream: its matching statistic up to `longest`, and the rows that match so far.

        That is how many symbols of the stream up to its end occur twice or more in the text, found by backward search, a symbol a
        step for all ends at once. An end whose matches have come down to one is given up there.
        """
        length, lo, hi = (np.zeros(len(ends), dtype=np.int64) for _ in range(3))
        open_ = np.arange(len(ends))
        below, above = np.zeros(len(ends), dtype=np.int64), np.full(len(ends), self.starts[-1])
        for n in range(1, longest + 1):
            symbol = stream[ends[open_] - n]
            below, above = (self.starts[symbol], self.starts[symbol + 1]) if n == 1 else (self.step(symbol, below), self.step(symbol, above))
            more = above - below > 1
            open_, below, above = open_[more], below[more], above[more]
            length[open_], lo[open_], hi[open_] = n, below, above
        return length, lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The places of the suffixes in these rows."""
        out, open_, at = np.zeros(len(rows), dtype=np.int64), np.arange(len(rows)), rows
        for steps in range(RATE):
            known = self.marked.get(at)
            out[open_[known]] = self.places[self.marked.rank(at[known])].astype(np.int64) + steps
            open_, at = open_[~known], self._before(at[~known])
        return out


def _suffix_order(text: np.ndarray, longest: int) -> np.ndarray:
    """The suffixes in order, by doubling; separators count as different symbols below all others, in order of place."""
    ends = np.flatnonzero(text == 0)
    rank = text.astype(np.int64) + len(ends)
    rank[ends] = np.arange(len(ends))
    have = 1
    while have <= longest:
        after = np.zeros(len(rank), dtype=np.int64)
        after[:-have] = rank[have:] + 1
        rank = np.unique(rank * (int(after.max(initial=0)) + 1) + after, return_inverse=True)[1].astype(np.int64)
        have *= 2
    return np.argsort(rank, kind="stable")
