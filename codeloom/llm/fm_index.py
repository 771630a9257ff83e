"""A compressed full-text index over sequences of words.

The Burrows-Wheeler transform is taken of suffixes in the order of their first 16 symbols, which is
all that patterns of up to 15 symbols need, and kept as a wavelet matrix of bit vectors with counts.
Backward search extends a match to the left by two rank queries on it. Any sequences can be streamed
through the index from their ends: their matching statistics, the longest matches that start at each
place, are kept up by cutting a match at its right end where it cannot be extended, for which the
common prefixes of neighbouring suffixes are at hand. Matches are counted up to ``width`` symbols,
and what is reported are the intervals of matches of the full width.
"""

from __future__ import annotations

import numpy as np


class WaveletMatrix:
    """Rank queries over a sequence of small integers: a bit vector for each binary digit."""

    def __init__(self, symbols: np.ndarray, n_symbols: int):
        self.levels = max(1, int(n_symbols - 1).bit_length())
        self.bits, self.counts, self.zeros = [], [], []
        rest = symbols.astype(np.int64)
        for level in range(self.levels - 1, -1, -1):
            bit = (rest >> level & 1).astype(bool)
            packed = np.packbits(np.concatenate([bit, np.zeros(-len(bit) % 64 + 64, bool)]), bitorder="little").view(np.uint64)
            self.bits.append(packed)
            self.counts.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed))]).astype(np.int64))
            self.zeros.append(len(bit) - int(bit.sum()))
            rest = np.concatenate([rest[~bit], rest[bit]])
        self.first = self._walk(np.arange(n_symbols), np.zeros(n_symbols, np.int64))

    def _walk(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k in range(self.levels):
            word = at >> 6
            below = self.bits[k][word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
            ones = self.counts[k][word] + np.bitwise_count(below)
            at = np.where(symbol >> (self.levels - 1 - k) & 1, self.zeros[k] + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        return self._walk(symbol, at) - self.first[symbol]


class FMIndex:
    """Over sequences given as one array of symbols from 0 on, each with a number (its document)."""

    def __init__(self, words: np.ndarray, lengths: np.ndarray, numbers: np.ndarray, width: int = 13):
        if not 2 <= width <= 15:
            raise ValueError("width must be from 2 to 15")
        self.width = width
        self.n_codes = int(words.max(initial=-1)) + 2
        # Code 0 ends every sequence.
        text = np.zeros(len(words) + len(lengths), np.int64)
        text[np.arange(len(words)) + np.repeat(np.arange(len(lengths)), lengths)] = words + 1
        self.n = n = len(text)
        rank, k = text, 1
        while k < 16:
            rank, k = self._paired(rank, k), 2 * k
        order = np.argsort(rank, kind="stable")
        self.bwt = WaveletMatrix(text[order - 1], self.n_codes)
        self.below = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=self.n_codes))])[:-1]
        # How many symbols each suffix has in common with the one before it, up to the width; ends are not in common.
        self.common = np.zeros(n, np.uint8)
        alive = np.arange(1, n)
        for j in range(width):
            here = text[np.minimum(order[alive] + j, n - 1)]
            alive = alive[(here == text[np.minimum(order[alive - 1] + j, n - 1)]) & (here > 0)]
            self.common[alive] += 1
        self._groups: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.least = np.minimum.reduceat(np.repeat(numbers, lengths + 1)[order], self._group(width)[1][:-1]) if n else numbers

    @staticmethod
    def _paired(ranks: np.ndarray, by: int) -> np.ndarray:
        """Ranks of pairs of a place's rank and that of the place ``by`` later."""
        later = np.zeros_like(ranks)
        later[: max(0, len(ranks) - by)] = ranks[by:]
        return np.unique(ranks * (int(later.max(initial=0)) + 1) + later, return_inverse=True)[1]

    def _group(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Suffixes that agree in ``length`` symbols stand together: the number of each one's group, and where groups begin, with the end."""
        if length not in self._groups:
            new = self.common < length
            new[:1] = True
            self._groups[length] = np.cumsum(new, dtype=np.int32) - 1, np.append(np.flatnonzero(new), self.n)
        return self._groups[length]

    def _cut(self, low: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of the first ``length`` symbols of matches whose intervals begin at ``low``."""
        if length == 0:
            return np.zeros_like(low), np.full_like(low, self.n)
        group, bounds = self._group(length)
        return bounds[group[low]], bounds[group[low] + 1]

    def _extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.below[symbol] + self.bwt.rank(symbol, low), self.below[symbol] + self.bwt.rank(symbol, high)

    def stream(self, words: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Send sequences through the index, each from its end.

        For every place of ``words``: the least number among all indexed sequences that hold the
        ``width`` symbols which start there, or a very large one where none does or fewer are left.
        Symbols that the index does not know, and those below 0, match nothing.
        """
        out = np.full(len(words), np.iinfo(np.int64).max)
        order = np.argsort(-lengths, kind="stable")
        ends = np.cumsum(lengths)
        at, left = (ends - 1)[order], lengths[order]
        low, high, have = np.zeros(len(order), np.int64), np.full(len(order), self.n, np.int64), np.zeros(len(order), np.int64)
        for step in range(1, int(left.max(initial=0)) + 1):
            n = int(np.searchsorted(-left, -step, side="right"))  # sequences with so many symbols
            at, low, high, have = at[:n], low[:n], high[:n], have[:n]
            symbol = words[at] + 1
            symbol[(symbol < 1) | (symbol >= self.n_codes)] = 0
            full = np.flatnonzero(have == self.width)
            if len(full):
                low[full], high[full] = self._cut(low[full], self.width - 1)
                have[full] -= 1
            new_low, new_high = self._extend(symbol, low, high)
            failed = np.flatnonzero((new_high <= new_low) & (symbol > 0))
            while len(failed):  # shorter matches, until one can be extended or nothing is left
                failed = failed[have[failed] > 0]
                have[failed] -= 1
                for length in np.unique(have[failed]).tolist():
                    own = failed[have[failed] == length]
                    low[own], high[own] = self._cut(low[own], length)
                new_low[failed], new_high[failed] = self._extend(symbol[failed], low[failed], high[failed])
                failed = failed[new_high[failed] <= new_low[failed]]
            none = (symbol == 0) | (new_high <= new_low)
            low, high, have = np.where(none, 0, new_low), np.where(none, self.n, new_high), np.where(none, 0, have + 1)
            whole = np.flatnonzero(have == self.width)
            out[at[whole]] = self.least[self._group(self.width)[0][low[whole]]]
            at = at - 1
        return out
