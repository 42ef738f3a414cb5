"""A compressed FM-index over sequences of words, on numpy arrays.

The sequences are laid one after another with a separator 0 between them. Suffixes are sorted by their first ``DEPTH``
symbols only, which is enough for patterns of less than ``DEPTH`` words: equal ones stay in any order. The transform
(the symbol before each suffix) is kept in a wavelet matrix: one bit vector for each bit of the alphabet, with counts
of ones for each 64 bits, 1.5 bits for each. Of the sorted suffixes only the runs of equal first ``length`` symbols are
kept: where each begins, and the least value of the sequences in it, four bytes each. Neither the text nor the suffix
array is. An index of words of 15 bits has 3 bytes a symbol, 8 a run at most, and 16 a distinct word.
"""

from __future__ import annotations

import numpy as np

DEPTH = 16


class Bits:
    """A bit vector with rank."""

    def __init__(self, bits: np.ndarray):
        words = np.packbits(bits, bitorder="little")
        self.words = np.concatenate([words, np.zeros(-len(words) % 8 + 8, np.uint8)]).view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int32)[:-1]]).astype(np.int32)

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word = at >> 6
        low = self.words[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[word] + np.bitwise_count(low)


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, top: int):
        self.levels: list[tuple[int, Bits, int]] = []
        for shift in range(max(1, int(top).bit_length()) - 1, -1, -1):
            bits = (symbols >> shift & 1).astype(bool)
            self.levels.append((shift, Bits(bits), int(len(bits) - bits.sum())))
            symbols = np.concatenate([symbols[~bits], symbols[bits]])
        every = np.arange(top + 1, dtype=np.int64)
        self.start = self.walk(every, np.zeros(top + 1, np.int64))

    def walk(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for shift, bits, zeros in self.levels:
            ones = bits.ones(at)
            at = np.where(symbol >> shift & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Times that each symbol is before each place."""
        return self.walk(symbol, at) - self.start[symbol]


class FMIndex:
    """Index over ``sequences`` (arrays of symbols from 1 to ``top``), each with a value, their order where none are given.

    length: of the patterns that are told apart; runs of equal first ``length`` symbols are the index's units.
    """

    def __init__(self, sequences: list[np.ndarray], top: int, length: int = DEPTH - 1, values: np.ndarray | None = None):
        zero = np.zeros(1, np.int64)
        text = np.concatenate([x for s in sequences for x in (s, zero)])
        n = len(text)
        sizes = np.array([len(s) + 1 for s in sequences])
        rank, depth = text.copy(), 1
        while depth < DEPTH:
            key = rank * (rank.max() + 1)
            key[: max(0, n - depth)] += rank[depth:]
            order = np.argsort(key)
            step = np.concatenate([[0], (np.diff(key[order]) != 0).astype(np.int64)])
            rank[order] = np.cumsum(step)
            depth *= 2
        suffix = np.argsort(rank)
        del rank
        self.size = n
        self.counts = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=top + 1))])
        self.bwt = WaveletMatrix(text[suffix - 1], top)
        self.starts = self._runs(text, suffix, length)
        values = np.arange(len(sequences)) if values is None else values
        kinds, number = np.unique(values, return_inverse=True)  # values by number: four bytes a run
        self.kinds, self.least = kinds, np.minimum.reduceat(number[np.repeat(np.arange(len(sequences)), sizes)[suffix]], self.starts[:-1]).astype(np.int32)

    @staticmethod
    def _runs(text: np.ndarray, suffix: np.ndarray, length: int) -> np.ndarray:
        """Where, in the sorted suffixes, runs of equal first ``length`` symbols begin; the number of rows at the end."""
        padded = np.concatenate([text, np.zeros(length, np.int64)])
        new = np.zeros(len(suffix), bool)
        new[0] = True
        for k in range(length):
            new[1:] |= padded[suffix[1:] + k] != padded[suffix[:-1] + k]
        return np.append(np.flatnonzero(new), len(suffix)).astype(np.int32)

    def run_of(self, row: np.ndarray) -> np.ndarray:
        """The number of the run of each row."""
        return np.searchsorted(self.starts, row, "right") - 1

    def least_value(self, row: np.ndarray) -> np.ndarray:
        """The least value of the sequences that have, anywhere, the first ``length`` symbols of each row."""
        return self.kinds[self.least[self.run_of(row)]]

    @property
    def nbytes(self) -> int:
        levels = sum(b.words.nbytes + b.before.nbytes for _, b, _ in self.bwt.levels)
        return levels + self.bwt.start.nbytes + self.counts.nbytes + self.starts.nbytes + self.least.nbytes + self.kinds.nbytes

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows of symbol + pattern, from the rows of the patterns: one step of backward search."""
        first = self.counts[symbol]
        return first + self.bwt.rank(symbol, low), first + self.bwt.rank(symbol, high)

    def search(self, pattern: np.ndarray) -> tuple[int, int]:
        """The rows of one pattern, of fewer than ``DEPTH`` words."""
        low, high = np.zeros(1, np.int64), np.array([self.size])
        for symbol in pattern[::-1]:
            if not 0 < symbol < len(self.counts) - 1 or high[0] <= low[0]:
                return 0, 0
            low, high = self.extend(np.array([symbol]), low, high)
        return int(low[0]), int(high[0])

    def statistics_table(self, patterns: list[np.ndarray], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``matching_statistics`` as tables, a row a pattern, aligned at their ends: lengths, low and high rows; and the patterns' sizes."""
        sizes = np.fromiter(map(len, patterns), np.int64, len(patterns))
        most = int(sizes.max(initial=0))
        table = np.zeros((len(patterns), most), np.int64)
        table[np.arange(most)[None, :] >= most - sizes[:, None]] = np.concatenate(patterns) if len(patterns) else 0
        out, lows, highs = (np.zeros((len(patterns), most), np.int64) for _ in range(3))
        size = np.zeros(len(patterns), np.int64)
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.size)
        for col in range(most - 1, -1, -1):
            live = np.flatnonzero(sizes >= most - col)
            symbol = table[live, col]
            known = (symbol > 0) & (symbol < len(self.counts) - 1)
            symbol = np.where(known, symbol, 0)
            a, b = self.extend(symbol, low[live], high[live])
            fresh = (a >= b) | ~known
            a, b = np.where(fresh, self.counts[symbol], a), np.where(fresh, self.counts[symbol + 1], b)
            grown = np.where(known & (a < b), np.where(fresh, 1, size[live] + 1), 0)
            for i in np.flatnonzero(fresh & (grown > 0) & (size[live] > 1)).tolist():
                for n in range(min(int(size[live[i]]), length), 1, -1):
                    x, y = self.search(table[live[i], col : col + n])
                    if x < y:
                        a[i], b[i], grown[i] = x, y, n
                        break
            a, b = np.where(grown > 0, a, 0), np.where(grown > 0, b, self.size)
            cut = grown >= length
            if cut.any():
                g = self.run_of(a[cut])
                a[cut], b[cut] = self.starts[g], self.starts[g + 1]
            low[live], high[live], size[live] = a, b, np.minimum(grown, length)
            out[live, col], lows[live, col], highs[live, col] = size[live], a, b
        return out, lows, highs, sizes

    def matching_statistics(self, patterns: list[np.ndarray], length: int) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
        """For each place of each pattern: the length of the longest match that starts there, up to ``length`` (the index's), and its rows.

        Patterns are read backwards, all at once. A match of ``length`` words that grows by one in front is cut to its
        first ``length``: its rows are then those of the run of equal first ``length`` symbols. Where a match can't grow,
        shorter ones are searched from there.
        """
        *tables, sizes = self.statistics_table(patterns, length)
        return tuple([t[i, t.shape[1] - int(n) :] for i, n in enumerate(sizes)] for t in tables)
