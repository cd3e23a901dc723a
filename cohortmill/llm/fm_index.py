"""FM-index over word symbols: suffix order, wavelet-tree ranks and sampled positions."""

from __future__ import annotations

import numpy as np


def suffix_order(first: np.ndarray) -> np.ndarray:
    """Positions of all suffixes in order, by prefix doubling; every text ends in a symbol that occurs once."""
    n = len(first)
    rank = first.astype(np.int64)
    order = np.argsort(rank, kind="stable")
    step = 1
    while True:
        key = rank * (int(rank.max()) + 2)
        key[:n - step] += rank[step:] + 1
        order = np.argsort(key)
        new = np.empty(n, np.int64)
        ordered = key[order]
        new[order] = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
        rank = new
        step *= 2
        if rank[order[-1]] == n - 1 or step >= n:
            return order


class WaveletTree:
    """Rank of symbols in a sequence, levels stored as bits with a count per 64 bits."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.n = len(symbols)
        self.bits = max(1, int(sigma - 1).bit_length())
        self.levels = []
        s = symbols
        for level in range(self.bits - 1, -1, -1):
            bit = (s >> level) & 1 == 1
            padded = np.zeros((self.n // 64 + 1) * 64, np.uint8)
            padded[:self.n] = bit
            words = np.packbits(padded, bitorder="little").view(np.uint64)
            counts = np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)))
            zeros = self.n - int(counts[-1])
            self.levels.append((level, words, counts, zeros))
            s = np.concatenate((s[~bit], s[bit]))

    @staticmethod
    def _ones(words: np.ndarray, counts: np.ndarray, i: np.ndarray) -> np.ndarray:
        block, rest = i >> 6, (i & 63).astype(np.uint64)
        return counts[block] + np.bitwise_count(words[block] & ((np.uint64(1) << rest) - np.uint64(1)))

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of symbol c before place i, elementwise."""
        lo, hi = np.zeros(len(i), np.int64), i.astype(np.int64)
        for level, words, counts, zeros in self.levels:
            bit = (c >> level) & 1 == 1
            a, b = self._ones(words, counts, lo), self._ones(words, counts, hi)
            lo, hi = np.where(bit, zeros + a, lo - a), np.where(bit, zeros + b, hi - b)
        return hi - lo

    def at(self, i: np.ndarray) -> np.ndarray:
        """Symbols at places i."""
        i, c = i.astype(np.int64), np.zeros(len(i), np.int64)
        for level, words, counts, zeros in self.levels:
            bit = (words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) == 1
            ones = self._ones(words, counts, i)
            i, c = np.where(bit, zeros + ones, i - ones), c | (bit.astype(np.int64) << level)
        return c


class FMIndex:
    """Index of texts over symbols 1 to sigma - 1. ``texts`` holds them one after another, each closed by a 0."""

    def __init__(self, texts: np.ndarray, sigma: int, sample: int = 16):
        n = len(texts)
        close = np.flatnonzero(texts == 0)
        first = texts.astype(np.int64) + len(close) - 1
        first[close] = np.arange(len(close))  # closing symbols differ, so no comparison runs past a text
        order = suffix_order(first)
        before = np.where(order > 0, texts[order - 1], 0).astype(np.int64)
        self.tree = WaveletTree(before, sigma)
        self.below = np.concatenate(([0], np.cumsum(np.bincount(texts, minlength=sigma))))  # suffixes that begin with a smaller symbol
        known = (order % sample == 0) | (before == 0)  # every sample-th position and each text's first
        self.known_rows = np.flatnonzero(known)
        self.known_at = order[self.known_rows]
        self.n = n

    def ranges(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of equally long phrases (one a row): suffix ranges [lo, hi)."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        alive = np.arange(len(phrases))
        for k in range(phrases.shape[1] - 1, -1, -1):
            if not len(alive):
                break
            c = phrases[alive, k].astype(np.int64)
            lo[alive] = self.below[c] + self.tree.rank(c, lo[alive])
            hi[alive] = self.below[c] + self.tree.rank(c, hi[alive])
            alive = alive[lo[alive] < hi[alive]]
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: steps to the left until a sampled position."""
        rows, out = rows.astype(np.int64), np.empty(len(rows), np.int64)
        todo, steps = np.arange(len(rows)), 0
        while len(todo):
            r = rows[todo]
            k = np.minimum(np.searchsorted(self.known_rows, r), len(self.known_rows) - 1)
            hit = self.known_rows[k] == r
            out[todo[hit]] = self.known_at[k[hit]] + steps
            todo, r = todo[~hit], r[~hit]
            c = self.tree.at(r)
            rows[todo] = self.below[c] + self.tree.rank(c, r)
            steps += 1
        return out
