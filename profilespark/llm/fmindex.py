"""An FM-index over a sequence of integers, all its queries on whole arrays of patterns at once."""

from __future__ import annotations

import numpy as np


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Suffix array by doubling; only suffixes whose place is not yet settled are sorted again.

    seq ends with a value that is smaller than all others and occurs once.
    """
    n = len(seq)
    wide = np.zeros(n + 2, np.int64)
    wide[:n] = seq
    base = int(wide.max()) + 1
    k = 3 if base < 1 << 20 else 1
    key = (wide[:n] * base + wide[1 : n + 1]) * base + wide[2 : n + 2] if k == 3 else wide[:n]
    sa = np.argsort(key, kind="stable")
    key = key[sa]
    new = np.empty(n, bool)
    new[0], new[1:] = True, key[1:] != key[:-1]
    start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[sa] = start
    open_ = ~(new & np.append(new[1:], True))
    active = np.flatnonzero(open_)
    while len(active):
        suffix = sa[active]
        key = rank[suffix] * (n + 1) + rank[np.minimum(suffix + k, n)] + 1
        order = np.argsort(key, kind="stable")
        suffix, key = suffix[order], key[order]
        sa[active] = suffix
        new = np.empty(len(active), bool)
        new[0], new[1:] = True, key[1:] != key[:-1]
        rank[suffix] = active[np.maximum.accumulate(np.where(new, np.arange(len(active)), 0))]
        active = active[~(new & np.append(new[1:], True))]
        k *= 2
    return sa


class Bits:
    """A bit vector with rank over 64-bit words."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        padded = np.zeros((n // 64 + 1) * 64, np.uint8)
        padded[:n] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.concatenate(([0], np.cumsum(ones)[:-1]))
        self.ones = int(ones.sum())

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before position i."""
        w = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & mask)

    def get(self, i: np.ndarray) -> np.ndarray:
        return ((self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)


class FMIndex:
    """Wavelet-tree ranks over the Burrows-Wheeler transform, suffix positions sampled every `step` places."""

    def __init__(self, seq: np.ndarray, step: int = 16):
        seq = np.asarray(seq, np.int64)
        self.n, self.step = len(seq), step
        sa = suffix_array(seq)
        bwt = seq[sa - 1]
        self.size = int(seq.max()) + 1
        self.c = np.concatenate(([0], np.cumsum(np.bincount(seq, minlength=self.size))))
        self.levels: list[tuple[int, Bits, int]] = []
        cur = bwt
        for shift in range(max(1, (self.size - 1).bit_length()) - 1, -1, -1):
            bit = ((cur >> shift) & 1).astype(bool)
            bits = Bits(bit)
            self.levels.append((shift, bits, self.n - bits.ones))
            cur = np.concatenate((cur[~bit], cur[bit]))
        self.at_zero = self._down(np.arange(self.size), np.zeros(self.size, np.int64))
        sampled = sa % step == 0
        self.sampled, self.samples = Bits(sampled), sa[sampled]

    def _down(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for shift, bits, zeros in self.levels:
            ones = bits.rank(i)
            i = np.where((c >> shift) & 1, zeros + ones, i - ones)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often symbol c stands before row i of the transform."""
        return self._down(c, i) - self.at_zero[c]

    def symbol(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol in row i of the transform, and its rank there."""
        c = np.zeros(len(i), np.int64)
        j = i
        for shift, bits, zeros in self.levels:
            one, ones = bits.get(j), bits.rank(j)
            c |= one.astype(np.int64) << shift
            j = np.where(one, zeros + ones, j - ones)
        return c, j - self.at_zero[c]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges [lo, hi) of the suffixes that begin with each pattern (rows of one length)."""
        m, length = patterns.shape
        lo, hi = np.zeros(m, np.int64), np.zeros(m, np.int64)
        alive = np.arange(m)
        a, b = np.zeros(m, np.int64), np.full(m, self.n, np.int64)
        for k in range(length - 1, -1, -1):
            c = patterns[alive, k]
            a = self.c[c] + self.rank(c, a)
            b = self.c[c] + self.rank(c, b)
            keep = a < b
            alive, a, b = alive[keep], a[keep], b[keep]
            if not len(alive):
                break
        lo[alive], hi[alive] = a, b
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions in the sequence of the suffixes in these rows."""
        out = np.zeros(len(rows), np.int64)
        todo, cur, steps = np.arange(len(rows)), rows.copy(), 0
        while len(todo):
            hit = self.sampled.get(cur)
            out[todo[hit]] = self.samples[self.sampled.rank(cur[hit])] + steps
            todo, cur = todo[~hit], cur[~hit]
            c, r = self.symbol(cur)
            cur, steps = self.c[c] + r, steps + 1
        return out
