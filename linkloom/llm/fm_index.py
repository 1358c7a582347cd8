"""A full-text index over one shard of word codes: suffix order, its BWT in a wavelet matrix, samples."""

from __future__ import annotations

import numpy as np

_SAMPLE = 8


def suffix_order(seq: np.ndarray) -> np.ndarray:
    """Order of all suffixes by prefix doubling. Code 0 separates: each 0 is a sign of its own."""
    n = len(seq)
    breaks = seq == 0
    key = np.where(breaks, 0, seq.astype(np.int64) + breaks.sum())
    key[breaks] = np.arange(breaks.sum())
    order = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int64)
    step = 1
    while True:
        sorted_key = key[order]
        new = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
        rank[order] = new
        if n == 0 or new[-1] == n - 1:
            return order
        after = np.full(n, -1, np.int64)
        after[: n - step] = rank[step:]
        key = rank * (n + 1) + after + 1
        order = np.argsort(key)
        step *= 2


class WaveletMatrix:
    """rank of any code before any place, for whole arrays of questions at once."""

    def __init__(self, seq: np.ndarray, codes: int):
        self.bits = max(1, int(codes).bit_length())
        self.words, self.before, self.zeros = [], [], []
        for level in reversed(range(self.bits)):
            bit = (seq >> level) & 1
            packed = np.zeros((len(seq) // 64 + 1) * 64, np.uint8)
            packed[: len(seq)] = bit
            words = np.packbits(packed, bitorder="little").view(np.uint64)
            counts = np.bitwise_count(words).astype(np.int64)
            self.words.append(words)
            self.before.append(np.concatenate([[0], np.cumsum(counts)[:-1]]))
            self.zeros.append(int(len(seq) - counts.sum()))
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        block = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[level][block] + np.bitwise_count(self.words[level][block] & mask)

    def rank(self, code: np.ndarray, at: np.ndarray) -> np.ndarray:
        start = np.zeros_like(at)
        for k in range(self.bits):
            one = ((code >> (self.bits - 1 - k)) & 1).astype(bool)
            a, s = self._ones(k, at), self._ones(k, start)
            at = np.where(one, self.zeros[k] + a, at - a)
            start = np.where(one, self.zeros[k] + s, start - s)
        return at - start


class FMIndex:
    def __init__(self, seq: np.ndarray, codes: int):
        """seq: codes 1..codes, and 0 between runs; it must begin and end with 0."""
        order = suffix_order(seq)
        self.last = seq[order - 1].astype(np.int64)  # the sign before each suffix
        self.below = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=codes + 1))])
        self.matrix = WaveletMatrix(self.last, codes)
        # places right after a separator are sampled too, so that no walk back crosses one
        kept = (order % _SAMPLE == 0) | (self.last == 0)
        self.kept = kept
        self.place = np.where(kept, order, -1)[kept]
        self.index = np.cumsum(kept) - 1

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Phrases of one length, one a row, to their ranges of the suffix order, by backward search."""
        lo = np.zeros(len(phrases), np.int64)
        hi = np.full(len(phrases), len(self.last), np.int64)
        for k in reversed(range(phrases.shape[1])):
            live = np.flatnonzero(lo < hi)
            code = phrases[live, k]
            first = self.below[code]
            lo[live], hi[live] = first + self.matrix.rank(code, lo[live]), first + self.matrix.rank(code, hi[live])
        return lo, np.maximum(lo, hi)

    def locate(self, at: np.ndarray) -> np.ndarray:
        """Places in the shard of entries of the suffix order: walk back to a sample, then count."""
        out, todo, steps = np.zeros(len(at), np.int64), np.arange(len(at)), 0
        while len(todo):
            there = self.kept[at]
            out[todo[there]] = self.place[self.index[at[there]]] + steps
            todo, at = todo[~there], at[~there]
            code = self.last[at]
            at = self.below[code] + self.matrix.rank(code, at)
            steps += 1
        return out
