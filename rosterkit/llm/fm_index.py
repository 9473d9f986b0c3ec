"""FM-index over a sequence of word numbers, searched for many phrases at once in numpy."""

from __future__ import annotations

import numpy as np

SAMPLE = 16


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Starts of the suffixes in order, by prefix doubling; every 0 is an end of its own, ordered by place."""
    n = len(symbols)
    ends = symbols == 0
    rank = symbols.astype(np.int64) + int(ends.sum())
    rank[ends] = np.arange(int(ends.sum()))
    step = 1
    while True:
        after = np.zeros(n, dtype=np.int64)
        after[:n - step] = rank[step:] + 1
        key = rank * (int(rank.max(initial=0)) + int(after.max(initial=0)) + 2) + after
        order = np.argsort(key, kind="stable")
        key = key[order]
        ranks = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
        rank = np.empty(n, dtype=np.int64)
        rank[order] = ranks
        step *= 2
        if ranks[-1] == n - 1 or step >= n:
            return order


class WaveletTree:
    """Occurrences of a symbol before a place, by one zero count for each bit of the symbols."""

    def __init__(self, symbols: np.ndarray, kinds: int):
        self.bits = max(1, int(kinds - 1).bit_length())
        self.zeros, self.split = [], []
        for bit in range(self.bits - 1, -1, -1):
            ones = (symbols >> bit & 1).astype(bool)
            self.zeros.append(np.concatenate([[0], np.cumsum(~ones)]).astype(np.int32))
            self.split.append(int(self.zeros[-1][-1]))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        start = np.zeros_like(place)
        for level, (zeros, split) in enumerate(zip(self.zeros, self.split)):
            one = (symbol >> (self.bits - 1 - level) & 1).astype(bool)
            below, first = zeros[place], zeros[start]
            place = np.where(one, split + place - below, below)
            start = np.where(one, split + start - first, first)
        return place - start


class FMIndex:
    """Index of runs of word numbers (1 and up), each run followed by a 0."""

    def __init__(self, symbols: np.ndarray, kinds: int):
        order = suffix_order(symbols)
        self.before = symbols[order - 1]
        self.tree = WaveletTree(self.before, kinds)
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=kinds))])[:kinds]
        self.sampled = (order % SAMPLE == 0) | (self.before == 0)
        self.place = np.cumsum(self.sampled) - 1
        self.samples = order[self.sampled]
        self.size = len(symbols)

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward search of the rows of ``phrases``: those found, and their first and last + 1 suffix rank."""
        alive = np.arange(len(phrases))
        low, high = np.zeros(len(phrases), dtype=np.int64), np.full(len(phrases), self.size, dtype=np.int64)
        for column in range(phrases.shape[1] - 1, -1, -1):
            symbol = phrases[alive, column]
            low = self.smaller[symbol] + self.tree.rank(symbol, low)
            high = self.smaller[symbol] + self.tree.rank(symbol, high)
            found = high > low
            alive, low, high = alive[found], low[found], high[found]
        return alive, low, high

    def locate(self, ranks: np.ndarray) -> np.ndarray:
        """Text places of suffix ranks: step back until a sampled suffix, run starts among them."""
        out, steps = np.empty(len(ranks), dtype=np.int64), 0
        at, waiting = ranks.copy(), np.arange(len(ranks))
        while len(waiting):
            done = self.sampled[at]
            out[waiting[done]] = self.samples[self.place[at[done]]] + steps
            waiting, at = waiting[~done], at[~done]
            symbol = self.before[at]
            at = self.smaller[symbol] + self.tree.rank(symbol, at)
            steps += 1
        return out
