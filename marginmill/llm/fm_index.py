"""FM-index over a sequence of symbols: suffix order, Burrows-Wheeler transform in a wavelet matrix, sampled positions.

All operations take whole arrays of queries. Symbols are whole numbers from 1; 0 ends the sequence.
"""

import numpy as np

SAMPLE = 16


def suffix_order(sequence: np.ndarray) -> np.ndarray:
    """Starts of all suffixes in sorted order, by prefix doubling; the sequence ends with its only 0."""
    n = len(sequence)
    rank = sequence.astype(np.int64)
    width = 1
    while True:
        follow = np.zeros(n, np.int64)
        follow[: n - width] = rank[width:] + 1
        key = rank * (int(follow.max()) + 1) + follow
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        new = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            return order
        width *= 2


class WaveletMatrix:
    """How often a symbol occurs before a place. One bit vector per bit of a symbol, highest first, in words of 64
    bits with the count of ones before each word."""

    def __init__(self, symbols: np.ndarray):
        self.levels = max(1, int(symbols.max()).bit_length())
        self.bits, self.before, self.zeros = [], [], []
        current = symbols
        for level in range(self.levels - 1, -1, -1):
            bit = (current >> level & 1).astype(np.uint8)
            packed = np.packbits(np.concatenate((bit, np.zeros(64 + -len(bit) % 64, np.uint8))), bitorder="little").view(np.uint64)
            self.bits.append(packed)
            self.before.append(np.concatenate(([0], np.cumsum(np.bitwise_count(packed), dtype=np.int64))))
            self.zeros.append(int(len(bit) - bit.sum()))
            current = np.concatenate((current[bit == 0], current[bit == 1]))
        #: Where the symbols of each kind begin after the last level.
        self.first = np.full(1 << self.levels, -1, np.int64)
        if len(current):
            begins = np.flatnonzero(np.concatenate(([True], current[1:] != current[:-1])))
            self.first[current[begins]] = begins

    def _ones(self, depth: int, place: np.ndarray) -> np.ndarray:
        word = place >> 6
        mask = (np.uint64(1) << (place & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[depth][word] + np.bitwise_count(self.bits[depth][word] & mask)

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each place; the symbols must occur."""
        place = place.astype(np.int64)
        for depth in range(self.levels):
            ones = self._ones(depth, place)
            bit = symbol >> (self.levels - 1 - depth) & 1
            place = np.where(bit == 1, self.zeros[depth] + ones, place - ones)
        return place - self.first[symbol]


class FMIndex:
    """Index of a sequence of symbols below `n_symbols`."""

    def __init__(self, sequence: np.ndarray, n_symbols: int):
        sequence = np.concatenate((sequence.astype(np.int64), [0]))
        order = suffix_order(sequence)
        self.transformed = sequence[order - 1]
        self.tree = WaveletMatrix(self.transformed)
        counts = np.bincount(sequence, minlength=n_symbols + 1)
        #: Rows of suffixes that begin with a symbol: smaller[s] to smaller[s + 1].
        self.smaller = np.concatenate(([0], np.cumsum(counts)))
        sampled = order % SAMPLE == 0
        self.sample_rows = np.flatnonzero(sampled)
        self.samples = order[self.sample_rows]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search: the rows low to high of the suffixes that begin with each pattern (a row of `patterns`,
        as many symbols as `lengths` says). Nothing is found for high <= low."""
        last = patterns[np.arange(len(patterns)), lengths - 1]
        low, high = self.smaller[last].copy(), self.smaller[last + 1].copy()
        for back in range(2, patterns.shape[1] + 1):
            open_ = np.flatnonzero((low < high) & (lengths >= back))
            if not len(open_):
                break
            symbol = patterns[open_, lengths[open_] - back]
            some = self.smaller[symbol + 1] > self.smaller[symbol]
            high[open_[~some]] = low[open_[~some]]
            open_, symbol = open_[some], symbol[some]
            low[open_] = self.smaller[symbol] + self.tree.rank(symbol, low[open_])
            high[open_] = self.smaller[symbol] + self.tree.rank(symbol, high[open_])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Where the suffixes of these rows begin: step back to the next sampled position."""
        place = np.full(len(rows), -1, np.int64)
        steps = np.zeros(len(rows), np.int64)
        rows = rows.copy()
        left = np.arange(len(rows))
        while len(left):
            at = np.searchsorted(self.sample_rows, rows[left])
            known = self.sample_rows[np.minimum(at, len(self.sample_rows) - 1)] == rows[left]
            place[left[known]] = self.samples[at[known]] + steps[left[known]]
            left = left[~known]
            symbol = self.transformed[rows[left]]
            rows[left] = self.smaller[symbol] + self.tree.rank(symbol, rows[left])
            steps[left] += 1
        return place
