"""An FM-index over numbered words: a wavelet matrix of the Burrows-Wheeler transform, with packed bits and block counts.

Searches run for many patterns at once: a step extends every pattern by one word to the left. Suffixes are sorted by their
first ``depth`` words only, which is enough for patterns of up to ``depth`` words.
"""

from __future__ import annotations

import numpy as np


class WaveletMatrix:
    """Rank of a symbol before a position; one packed bit row per level, with a count per 64 bits."""

    def __init__(self, symbols: np.ndarray, levels: int):
        self.levels, self.bits, self.ones, self.zeros = levels, [], [], []
        now = symbols
        for level in range(levels - 1, -1, -1):
            bit = ((now >> level) & 1).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            words = np.zeros(len(now) // 64 + 1, np.uint64)
            words.view(np.uint8)[: len(packed)] = packed
            self.bits.append(words)
            self.ones.append((np.cumsum(np.bitwise_count(words), dtype=np.int64) - np.bitwise_count(words)).astype(np.uint32))
            self.zeros.append(int(len(now) - bit.sum()))
            now = np.concatenate((now[~bit], now[bit]))
        start = np.flatnonzero(np.concatenate(([True], now[1:] != now[:-1])))
        self.start = np.zeros(1 << levels, np.int64)  # of each symbol's run below the last level
        self.start[now[start]] = start

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often ``symbol`` (one that occurs) stands before ``at``."""
        for k in range(self.levels):
            block = at >> 6
            below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            ones = self.ones[k][block].astype(np.int64) + np.bitwise_count(self.bits[k][block] & below)
            at = np.where((symbol >> (self.levels - 1 - k)) & 1 == 1, self.zeros[k] + ones, at - ones)
        return at - self.start[symbol]


class FMIndex:
    """Of a text of word numbers from 1; 0 separates passages and is never searched."""

    def __init__(self, text: np.ndarray, depth: int):
        self.depth, n = depth, len(text)
        rank, reach = text.astype(np.int64), 1
        self.order = np.argsort(rank, kind="stable")
        while reach < depth:
            key = rank * (int(rank.max()) + 1) + np.roll(rank, -reach)  # the text is read as a ring: passages end at a separator
            self.order = np.argsort(key, kind="stable")
            got = key[self.order]
            rank = np.empty(n, np.int64)
            rank[self.order] = np.cumsum(np.concatenate(([0], got[1:] != got[:-1])))
            reach *= 2
        self.size = n
        self.before = np.concatenate(([0], np.cumsum(np.bincount(text))))
        self.wavelet = WaveletMatrix(text[self.order - 1].astype(np.int64), max(1, int(text.max()).bit_length()))

    def step(self, words: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows of patterns with ``words`` put in front."""
        base = self.before[words]
        return base + self.wavelet.rank(words, lo), base + self.wavelet.rank(words, hi)

    def matching(self, text: np.ndarray, ends: np.ndarray, upto: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each end in ``text`` (exclusive): the length of the longest match that ends there, ``upto`` words at most, and
        its rows. Words must be known to the index or 0; a match never holds a 0."""
        length = np.zeros(len(ends), np.int64)
        lo, hi = np.zeros(len(ends), np.int64), np.full(len(ends), self.size, np.int64)
        live = np.arange(len(ends))
        for k in range(min(upto, self.depth)):
            live = live[ends[live] - k > 0]
            word = text[ends[live] - 1 - k]
            live, word = live[word > 0], word[word > 0]
            a, b = self.step(word, lo[live], hi[live])
            found = b > a
            live = live[found]
            lo[live], hi[live], length[live] = a[found], b[found], k + 1
        return length, lo, hi

    def first_places(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The smallest text position among each range of rows. Ranges are equal or apart."""
        starts, at = np.unique(lo, return_inverse=True)
        if not len(starts):
            return lo
        ends = np.empty_like(starts)
        ends[at] = hi
        cuts = np.stack((starts, ends), 1).ravel()
        return np.minimum.reduceat(np.append(self.order, self.size), cuts)[::2][at]
