"""An FM-index over the word ids of one shard: suffix array, wavelet matrix ranks, sampled suffix positions."""

from __future__ import annotations

import numpy as np


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffixes of s in order, by prefix doubling."""
    n, width = len(s), 1
    rank = np.unique(s, return_inverse=True)[1].astype(np.int64)
    while True:
        ahead = np.zeros(n, np.int64)
        ahead[: n - width] = rank[width:] + 1
        key = rank * (n + 1) + ahead
        order = np.argsort(key, kind="stable")
        steps = np.empty(n, np.int64)
        steps[0] = 0
        np.cumsum(key[order[1:]] != key[order[:-1]], out=steps[1:])
        rank[order] = steps
        width *= 2
        if steps[-1] == n - 1 or width >= n:
            return order


class WaveletMatrix:
    """rank(c, i): how often c occurs before i; access(i): the symbol at i.  Both take arrays."""

    def __init__(self, s: np.ndarray, symbols: int):
        self.levels = []
        for bit in range(max(1, int(symbols - 1).bit_length()) - 1, -1, -1):
            ones = (s >> bit) & 1
            count = np.zeros(len(s) + 1, np.int32)
            np.cumsum(ones, out=count[1:])
            self.levels.append((bit, count, len(s) - int(count[-1])))
            s = np.concatenate([s[ones == 0], s[ones == 1]])

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        begin = np.zeros_like(i)
        for bit, count, zeros in self.levels:
            one = ((c >> bit) & 1).astype(bool)
            ci, cb = count[i], count[begin]
            i, begin = np.where(one, zeros + ci, i - ci), np.where(one, zeros + cb, begin - cb)
        return i - begin

    def access(self, i: np.ndarray) -> np.ndarray:
        c = np.zeros(len(i), np.int64)
        for bit, count, zeros in self.levels:
            one = count[i + 1] - count[i]
            c |= one.astype(np.int64) << bit
            i = np.where(one == 1, zeros + count[i], i - count[i])
        return c


class FMIndex:
    """Symbols are 1 and more; 0 ends the text.  Every `sample`-th text position keeps its suffix position."""

    def __init__(self, s: np.ndarray, symbols: int, sample: int = 8):
        s = np.append(s, 0).astype(np.int64)
        order = suffix_array(s)
        self.bwt = WaveletMatrix(s[order - 1], symbols)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=symbols))]).astype(np.int64)
        marked = order % sample == 0
        self.marks = np.concatenate([[0], np.cumsum(marked)])
        self.positions = order[marked]
        self.n = len(s)

    def count(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges [lo, hi) of all patterns (rows of a right-padded matrix), by backward search."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for j in range(patterns.shape[1] - 1, -1, -1):
            at = np.flatnonzero((lengths > j) & (hi > lo))
            if len(at):
                c = patterns[at, j]
                lo[at], hi[at] = self.first[c] + self.bwt.rank(c, lo[at]), self.first[c] + self.bwt.rank(c, hi[at])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: walk back through the text to the next sampled position."""
        out, at, walked = np.zeros(len(rows), np.int64), np.arange(len(rows)), 0
        while len(rows):
            hit = self.marks[rows + 1] > self.marks[rows]
            out[at[hit]] = self.positions[self.marks[rows[hit]]] + walked
            rows, at, walked = rows[~hit], at[~hit], walked + 1
            c = self.bwt.access(rows)
            rows = self.first[c] + self.bwt.rank(c, rows)
        return out
