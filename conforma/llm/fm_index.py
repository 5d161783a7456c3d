"""An FM-index over one training shard, in numpy.

Symbols are small integers; 0 is a separator that no phrase contains. Each separator counts as a
different symbol, ordered by place, so suffix order is settled inside a segment and no phrase can
cross one.
"""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Prefix doubling; only suffixes whose order is still open are sorted again."""
    n = len(symbols)
    separators = symbols == 0
    n_sep = int(separators.sum())
    rank = np.where(separators, np.cumsum(separators) - 1, n_sep - 1 + symbols).astype(np.int64)
    base = int(rank.max()) + 2
    padded = np.concatenate([rank + 1, np.zeros(3, np.int64)])
    width = 3 if base < 1 << 20 else 2
    key = padded[:n]
    for step in range(1, width):
        key = key * base + padded[step : n + step]
    order = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order], open_ = _ranks(key[order], np.arange(n))
    todo, reach = order[open_], width
    while len(todo):
        ahead = todo + reach
        second = np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        first = rank[todo]
        by = np.lexsort((second, first))
        todo, first, second = todo[by], first[by], second[by]
        key = first * (n + 2) + second
        starts = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]]))
        within = np.arange(len(todo)) - np.repeat(starts, np.diff(np.append(starts, len(todo))))
        new, open_ = _ranks(key, first + within)
        rank[todo] = new
        todo, reach = todo[open_], reach * 2
    sa = np.empty(n, np.int64)
    sa[rank] = np.arange(n)
    return sa


def _ranks(keys: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sorted keys: each one's rank (the place of its run's first) and whether it has ties."""
    first = np.concatenate([[True], keys[1:] != keys[:-1]])
    starts = np.flatnonzero(first)
    lengths = np.diff(np.append(starts, len(keys)))
    return np.repeat(places[starts], lengths), np.repeat(lengths > 1, lengths)


class WaveletMatrix:
    """Rank of any symbol before any place, by one bit vector for each bit of a symbol."""

    def __init__(self, symbols: np.ndarray, n_symbols: int):
        self.bits = max(1, int(n_symbols - 1).bit_length())
        self.levels = []
        n, current = len(symbols), symbols.astype(np.uint32)
        for level in range(self.bits - 1, -1, -1):
            ones = ((current >> np.uint32(level)) & np.uint32(1)).astype(bool)
            packed = np.zeros((n // 64 + 1) * 8, np.uint8)
            raw = np.packbits(ones, bitorder="little")
            packed[: len(raw)] = raw
            blocks = packed.view("<u8")
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(blocks), dtype=np.int64)[:-1]])
            self.levels.append((level, blocks, before, n - int(ones.sum())))
            current = np.concatenate([current[~ones], current[ones]])
        self.base = self._descend(np.arange(n_symbols), np.zeros(n_symbols, np.int64))

    @staticmethod
    def _ones(blocks: np.ndarray, before: np.ndarray, i: np.ndarray) -> np.ndarray:
        block, bit = i >> 6, (i & 63).astype(np.uint64)
        mask = (np.uint64(1) << bit) - np.uint64(1)
        return before[block] + np.bitwise_count(blocks[block] & mask)

    def _descend(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for level, blocks, before, zeros in self.levels:
            ones = self._ones(blocks, before, i)
            i = np.where((symbol >> level) & 1, zeros + ones, i - ones)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        return self._descend(symbol, i) - self.base[symbol]

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place, and its rank there."""
        symbol = np.zeros(len(i), np.int64)
        for level, blocks, before, zeros in self.levels:
            bit = ((blocks[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64)
            ones = self._ones(blocks, before, i)
            i = np.where(bit, zeros + ones, i - ones)
            symbol |= bit << level
        return symbol, i - self.base[symbol]


class FMIndex:
    def __init__(self, symbols: np.ndarray, n_symbols: int, sample_rate: int = 8):
        """symbols ends in 0. Every sample_rate-th suffix position is kept, and those after 0."""
        sa = suffix_array(symbols)
        last = symbols[sa - 1]
        self.n = len(symbols)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=n_symbols))])
        self.wavelet = WaveletMatrix(last, n_symbols)
        self.sampled = np.flatnonzero((sa % sample_rate == 0) | (last == 0))
        self.positions = sa[self.sampled].astype(np.int32)

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of all phrases (rows of symbols, filled up with 0): their row ranges."""
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), self.n, np.int64)
        live = np.arange(len(phrases))
        for step in range(phrases.shape[1] if len(phrases) else 0):
            live = live[(lengths[live] > step) & (low[live] < high[live])]
            if not len(live):
                break
            symbol = phrases[live, lengths[live] - 1 - step]
            low[live] = self.before[symbol] + self.wavelet.rank(symbol, low[live])
            high[live] = self.before[symbol] + self.wavelet.rank(symbol, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: step back through the text to a sampled row."""
        found, steps = np.empty(len(rows), np.int64), np.zeros(len(rows), np.int64)
        live, at = np.arange(len(rows)), rows.astype(np.int64)
        while len(live):
            place = np.minimum(np.searchsorted(self.sampled, at), len(self.sampled) - 1)
            hit = self.sampled[place] == at
            found[live[hit]] = self.positions[place[hit]] + steps[live[hit]]
            live, at = live[~hit], at[~hit]
            steps[live] += 1
            symbol, rank = self.wavelet.access(at)
            at = self.before[symbol] + rank
        return found
