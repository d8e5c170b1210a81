"""A compressed FM-index over words: wavelet matrix of the Burrows-Wheeler transform, rank by packed bits."""

from __future__ import annotations

import numpy as np


class Bits:
    """A bit vector with rank: 64 bits a word and a count before each word."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(len(bits) // 64 * 64 + 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.zeros(len(self.words) + 1, np.int32)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        w = i >> 6
        return self.before[w] + np.bitwise_count(self.words[w] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)))


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, sigma: int):
        self.levels: list[tuple[int, Bits, int]] = []
        x = symbols
        for level in range(max(1, int(sigma - 1).bit_length()) - 1, -1, -1):
            one = (x >> level & 1).astype(bool)
            self.levels.append((level, Bits(one), int(len(x) - one.sum())))
            x = np.concatenate([x[~one], x[one]])
        self.first = self._walk(np.arange(sigma), np.zeros(sigma, np.int64))

    def _walk(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for level, bits, zeros in self.levels:
            ones = bits.rank(i)
            i = np.where(c >> level & 1, zeros + ones, i - ones)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol c occurs before place i."""
        return self._walk(c, i) - self.first[c]


def _dense(key: np.ndarray) -> np.ndarray:
    """The rank of each number among the different ones."""
    order = np.argsort(key)
    k = key[order]
    rank = np.empty(len(key), np.int64)
    rank[order] = np.cumsum(np.r_[0, (k[1:] != k[:-1]).astype(np.int64)])
    return rank


def _after(rank: np.ndarray, places: int) -> np.ndarray:
    """Ranks so many places further on, from 1; 0 beyond the end."""
    out = np.zeros(len(rank), np.int64)
    if places < len(rank):
        out[: len(rank) - places] = rank[places:] + 1
    return out


def _joined(parts: list[np.ndarray], n: int) -> np.ndarray:
    """Numbers in the order of tuples of ranks, each at most n."""
    key, top = parts[0], n + 1
    for p in parts[1:]:
        if top > (1 << 62) // (n + 2):
            key, top = _dense(key), n + 1
        key, top = key * (n + 2) + p, top * (n + 2)
    return key


class FMIndex:
    """symbols: whole numbers below sigma, 0 for borders. Suffixes are ordered by window + 1 symbols, so that intervals of
    patterns up to that length are exact. What stays is the wavelet matrix, and for the classes of suffixes that agree in
    window symbols their borders and the least of the values of their places."""

    def __init__(self, symbols: np.ndarray, sigma: int, window: int, values: np.ndarray):
        n, ranks, size = len(symbols), {1: symbols.astype(np.int64)}, 1
        while 3 * size <= window + 1:  # ranks of stretches of 1, 3, 9, ... symbols
            ranks[3 * size] = _dense(_joined([_after(ranks[size], k * size) for k in range(3)], n + 1))
            size *= 3

        def stretch(length: int) -> list[np.ndarray]:
            parts, at = [], 0
            for s in sorted(ranks, reverse=True):
                while length - at >= s:
                    parts.append(_after(ranks[s], at))
                    at += s
            return parts

        order = np.argsort(_joined(stretch(window + 1), n + 1))
        self.bwt = WaveletMatrix(symbols[order - 1], sigma)
        self.before = np.r_[0, np.cumsum(np.bincount(symbols, minlength=sigma))]
        new = np.r_[True, np.zeros(n - 1, bool)]
        for part in stretch(window):
            new[1:] |= np.diff(part[order]) != 0
        self.start = np.flatnonzero(new)  # where each class starts
        self.end = np.r_[self.start[1:], n]
        self.of = (np.cumsum(new) - 1).astype(np.int32)  # the class of each place
        self.least = np.minimum.reduceat(values[order], self.start)

    def extend(self, c: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A step of backward search: the intervals of c followed by the patterns of the given intervals."""
        return self.before[c] + self.bwt.rank(c, low), self.before[c] + self.bwt.rank(c, high)
