"""An FM-index over a sequence of symbols: backward search in a wavelet matrix, sampled positions."""

from __future__ import annotations

import numpy as np

SAMPLING = 8


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Order of all suffixes; the last symbol must be the only smallest one."""
    n = len(symbols)
    _, rank = np.unique(symbols, return_inverse=True)
    rank = rank.astype(np.int64)
    length = 1
    while True:
        # Runs off the end count as smaller than anything.
        after = np.zeros(n, np.int64)
        after[: n - length] = rank[length:] + 1 if length < n else 0
        pair = rank * (n + 1) + after
        order = np.argsort(pair, kind="stable")
        sorted_pair = pair[order]
        fresh = np.concatenate([[0], np.cumsum(sorted_pair[1:] != sorted_pair[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        if fresh[-1] == n - 1:
            return order
        length *= 2


class WaveletMatrix:
    """Rank of any symbol before any position, one bit of the symbol per level."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.levels = []
        now = symbols
        for bit in range(bits - 1, -1, -1):
            ones = (now >> bit) & 1
            zeros_before = np.concatenate([[0], np.cumsum(1 - ones)]).astype(np.int32)
            self.levels.append((bit, zeros_before, int(zeros_before[-1])))
            now = np.concatenate([now[ones == 0], now[ones == 1]])

    def rank(self, symbol: np.ndarray, position: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each position."""
        low = np.zeros_like(position)
        for bit, zeros, total in self.levels:
            one = ((symbol >> bit) & 1).astype(bool)
            low_zeros, high_zeros = zeros[low], zeros[position]
            low = np.where(one, total + low - low_zeros, low_zeros)
            position = np.where(one, total + position - high_zeros, high_zeros)
        return position - low


class FMIndex:
    """Built over symbols >= 1; ``locate`` answers positions in that sequence."""

    def __init__(self, symbols: np.ndarray):
        text = np.append(symbols, 0).astype(np.int64)
        order = suffix_array(text)
        self.transform = text[order - 1]
        self.size = len(text)
        highest = int(text.max())
        counts = np.bincount(text, minlength=highest + 2)
        self.smaller = np.concatenate([[0], np.cumsum(counts)])
        self.highest = highest
        self.wavelet = WaveletMatrix(self.transform, max(1, highest.bit_length()))
        sampled = order % SAMPLING == 0
        self.sampled_before = np.concatenate([[0], np.cumsum(sampled)]).astype(np.int32)
        self.sampled = sampled
        self.samples = order[sampled]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows [low, high) of each phrase (rows of one length), by backward search."""
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), self.size, np.int64)
        alive = np.arange(len(phrases))
        for column in range(phrases.shape[1] - 1, -1, -1):
            symbol = phrases[alive, column]
            known = symbol <= self.highest
            high[alive[~known]] = low[alive[~known]]
            alive, symbol = alive[known], symbol[known]
            low[alive] = self.smaller[symbol] + self.wavelet.rank(symbol, low[alive])
            high[alive] = self.smaller[symbol] + self.wavelet.rank(symbol, high[alive])
            alive = alive[low[alive] < high[alive]]
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of rows: steps back through the text to the next sampled one."""
        rows = rows.copy()
        found = np.zeros(len(rows), np.int64)
        walking = np.arange(len(rows))
        steps = 0
        while len(walking):
            here = rows[walking]
            there = self.sampled[here]
            done = walking[there]
            found[done] = self.samples[self.sampled_before[rows[done]]] + steps
            walking, here = walking[~there], here[~there]
            symbol = self.transform[here]
            rows[walking] = self.smaller[symbol] + self.wavelet.rank(symbol, here)
            steps += 1
        return found
