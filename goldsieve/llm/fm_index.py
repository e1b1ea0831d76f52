"""A compressed full-text index of word sequences, searched backwards.

The sequences are joined with separators and sorted by suffix; the index is the
Burrows-Wheeler transform of that order in a wavelet tree of packed bits, one bit
vector per level with a count before each 64-bit word.  A backward step takes the rows of
all suffixes that start with a string to those of the string with a word before it, at two
ranks per level.  Steps are taken for many strings at a time with numpy.

:meth:`Index.matching` streams sequences against the index and gives their matching
statistics: for each place, the length of the longest run of words from there that
the index holds at least ``least`` times.  It goes from the last word to the first: a
word that cannot be put before the match shortens the match at its far end to its
parent interval, which the longest common prefixes of neighbouring suffixes tell.
"""

from __future__ import annotations

import numpy as np


class WaveletTree:
    """Ranks of symbols in a sequence, from bit vectors of all levels side by side."""

    def __init__(self, symbols: np.ndarray, count: int):
        self.size = len(symbols)
        self._shifts = range(max(1, int(count - 1).bit_length()) - 1, -1, -1)
        self._words, self._before, self._zeros = [], [], []
        for shift in self._shifts:
            bits = ((symbols >> shift) & 1).astype(bool)
            packed = np.zeros((self.size // 64 + 1) * 8, np.uint8)
            packed[: (self.size + 7) // 8] = np.packbits(bits, bitorder="little")
            words = packed.view("<u8")
            before = np.zeros(len(words) + 1, np.int64)
            np.cumsum(np.bitwise_count(words), out=before[1:])
            self._words.append(words)
            self._before.append(before)
            self._zeros.append(self.size - int(before[-1]))
            symbols = np.concatenate((symbols[~bits], symbols[bits]))
        every = np.arange(count)
        self._first = self._down(every, np.zeros(count, np.int64))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for shift, words, before, zeros in zip(self._shifts, self._words, self._before, self._zeros):
            word = at >> 6
            below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            ones = before[word] + np.bitwise_count(words[word] & below)
            at = np.where((symbol >> shift) & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        return self._down(symbol, at) - self._first[symbol]


def suffix_order(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order, and the common prefix length of each with the one before it.

    Zeros are separators: each is a symbol of its own, so no prefix crosses one.
    Ranks of 1, 2, 4, .. symbols are kept; the common prefixes are read from them.
    """
    size = len(symbols)
    apart = symbols == 0
    rank = np.where(apart, np.cumsum(apart) - 1, symbols + int(apart.sum()) - 1)
    _, rank = np.unique(rank, return_inverse=True)
    ranks = [rank.astype(np.int64)]
    order = np.argsort(ranks[0], kind="stable")
    while int(ranks[-1].max(initial=-1)) < size - 1:
        width, rank = 1 << (len(ranks) - 1), ranks[-1]
        key = rank * (size + 1)
        key[: size - width] += rank[width:] + 1
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        new = np.zeros(size, np.int64)
        new[order[1:]] = np.cumsum(ordered[1:] != ordered[:-1])
        ranks.append(new)
    one, two, common = order[:-1].copy(), order[1:].copy(), np.zeros(max(0, size - 1), np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        inside = np.flatnonzero(np.maximum(one, two) < size)
        same = inside[ranks[level][one[inside]] == ranks[level][two[inside]]]
        for part in (one, two, common):
            part[same] += 1 << level
    return order, np.concatenate(([-1], common, [-1]))


def _nearest_smaller(values: np.ndarray) -> np.ndarray:
    """For each place the nearest earlier one with a smaller value; the first is its own."""
    nearest = np.maximum(np.arange(len(values)) - 1, 0)
    open_ = np.flatnonzero(values[nearest] >= values)
    while len(open_):
        nearest[open_] = nearest[nearest[open_]]
        open_ = open_[(values[nearest[open_]] >= values[open_]) & (nearest[open_] > 0)]
    return nearest


class Index:
    """FM-index of sequences of symbols from 1 to ``count - 1``, each closed by a zero."""

    def __init__(self, symbols: np.ndarray, count: int):
        order, self._common = suffix_order(symbols)
        self.size = len(symbols)
        self._tree = WaveletTree(symbols[order - 1], count)
        self._less = np.concatenate(([0], np.cumsum(np.bincount(symbols, minlength=count))))
        self._up = _nearest_smaller(self._common)
        self._down = self.size - _nearest_smaller(self._common[::-1])[::-1]

    def step(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of ``symbol`` followed by the strings of rows ``low`` to ``high``."""
        found = self._tree.rank(np.concatenate((symbol, symbol)), np.concatenate((low, high)))
        first = self._less[symbol]
        return first + found[: len(symbol)], first + found[len(symbol) :]

    def parent(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The next wider rows that share a prefix, and its length; all rows share none."""
        left, right = self._common[low], self._common[high]
        depth = np.maximum(left, right)
        root = depth <= 0
        low = np.where(root, 0, np.where(left == depth, self._up[low], low))
        high = np.where(root, self.size, np.where(right == depth, self._down[high], high))
        return low, high, np.maximum(depth, 0)

    def matching(self, symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray, least: int = 2) -> np.ndarray:
        """Matching statistics of the sequences ``symbols[start:end]``, all side by side."""
        longest = np.zeros(len(symbols), np.int64)
        at = ends - 1
        some = at >= starts
        at, starts = at[some], starts[some]
        low, high, depth = np.zeros_like(at), np.full_like(at, self.size), np.zeros_like(at)
        while len(at):
            new_low, new_high = self.step(symbols[at], low, high)
            grown = new_high - new_low >= least
            short = ~grown & (depth > 0)
            low, high = np.where(grown, new_low, low), np.where(grown, new_high, high)
            depth = depth + grown
            longest[at[grown]] = depth[grown]
            at = at - ~short
            if short.any():
                low[short], high[short], depth[short] = self.parent(low[short], high[short])
            left = at >= starts
            if not left.all():
                at, starts, low, high, depth = at[left], starts[left], low[left], high[left], depth[left]
        return longest
