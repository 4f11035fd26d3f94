"""A compressed full-text index over numpy arrays: wavelet matrix of the Burrows-Wheeler transform, sampled positions.

All operations take arrays of intervals or positions, so that a search runs for thousands of patterns at once.
"""

from __future__ import annotations

import io

import numpy as np
import zstandard

SAMPLE = 8


class Bits:
    """A bit vector with constant-time rank: packed words and running counts."""

    def __init__(self, words: np.ndarray, counts: np.ndarray):
        self.words, self.counts = words, counts

    @staticmethod
    def of(bits: np.ndarray) -> Bits:
        n = len(bits) // 64 + 1
        padded = np.zeros(n * 64, np.uint8)
        padded[: len(bits)] = bits
        words = np.packbits(padded, bitorder="little").view(np.uint64)
        return Bits(words, np.concatenate([[0], np.cumsum(np.bitwise_count(words))]).astype(np.uint32))

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Set bits before position ``i``."""
        w = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.counts[w].astype(np.int64) + np.bitwise_count(self.words[w] & mask)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """By doubling of ranks."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    k = 1
    while True:
        key = rank * (n + 1)
        key[: n - k] += rank[k:] + 1
        order = np.argsort(key, kind="stable")
        s = key[order]
        new = np.concatenate([[0], np.cumsum(s[1:] != s[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1 or k >= n:
            return order
        k *= 2


class FmIndex:
    """Index of several documents. Symbol 1 ends each document, a single 0 the text; neither occurs in a pattern."""

    def __init__(self, alphabet, text, starts, levels, zeros, shift, marks, samples, n):
        self.alphabet, self.text, self.starts, self.levels, self.zeros, self.shift, self.marks, self.samples, self.n = alphabet, text, starts, levels, zeros, shift, marks, samples, n

    @staticmethod
    def build(cps: np.ndarray, offsets: np.ndarray) -> FmIndex:
        alphabet = np.unique(cps)
        docs = len(offsets) - 1
        text = np.ones(len(cps) + docs + 1, np.int64)
        text[-1] = 0
        at = np.arange(len(cps)) + np.repeat(np.arange(docs), np.diff(offsets))
        text[at] = np.searchsorted(alphabet, cps) + 2
        n = len(text)
        sa = suffix_array(text)
        bwt = text[sa - 1]
        sigma = len(alphabet) + 2
        depth = max(1, int(sigma - 1).bit_length())
        levels, zeros, cur = [], [], bwt
        for lv in range(depth - 1, -1, -1):
            bit = (cur >> lv & 1).astype(bool)
            levels.append(Bits.of(bit))
            zeros.append(int((~bit).sum()))
            cur = np.concatenate([cur[~bit], cur[bit]])
        first = np.searchsorted(np.sort(bwt), np.arange(sigma))
        home = np.zeros(sigma, np.int64)  # where each symbol begins in the last level
        at = np.flatnonzero(np.append(True, cur[1:] != cur[:-1]))
        home[cur[at]] = at
        marks = sa % SAMPLE == 0
        return FmIndex(alphabet, text.astype(np.uint16 if sigma < 65536 else np.uint32), offsets + np.arange(docs + 1), levels, zeros, first - home, Bits.of(marks), sa[marks].astype(np.uint32), n)

    def save(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, alphabet=self.alphabet, text=self.text, starts=self.starts, words=np.array([b.words for b in self.levels]), counts=np.array([b.counts for b in self.levels]), zeros=self.zeros, shift=self.shift, mw=self.marks.words, mc=self.marks.counts, samples=self.samples, n=self.n)
        return zstandard.compress(out.getvalue())

    @staticmethod
    def load(data: bytes) -> FmIndex:
        z = np.load(io.BytesIO(zstandard.decompress(data)))
        return FmIndex(z["alphabet"], z["text"], z["starts"], [Bits(w, c) for w, c in zip(z["words"], z["counts"])], z["zeros"].tolist(), z["shift"], Bits(z["mw"], z["mc"]), z["samples"], int(z["n"]))

    def symbols(self, cps: np.ndarray) -> np.ndarray:
        """The index's symbols of code points, -1 for those that no document has."""
        if not len(self.alphabet):
            return np.full(len(cps), -1)
        i = np.minimum(np.searchsorted(self.alphabet, cps), len(self.alphabet) - 1)
        return np.where(self.alphabet[i] == cps, i + 2, -1)

    def _step(self, i: np.ndarray, c: np.ndarray) -> np.ndarray:
        depth = len(self.levels)
        for lv, (bits, z) in enumerate(zip(self.levels, self.zeros)):
            one = (c >> (depth - 1 - lv) & 1).astype(bool)
            r = bits.rank(i)
            i = np.where(one, z + r, i - r)
        return i + self.shift[c]

    def _back(self, i: np.ndarray) -> np.ndarray:
        """Rows of the suffixes that begin one symbol earlier."""
        c = np.zeros(len(i), np.int64)
        for bits, z in zip(self.levels, self.zeros):
            one, r = bits.get(i), bits.rank(i)
            c = c << 1 | one
            i = np.where(one, z + r, i - r)
        return i + self.shift[c]

    def search(self, symbols: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the patterns ``symbols[begin:end]``, by backward search of all of them at once."""
        lo, hi = np.zeros(len(begin), np.int64), np.full(len(begin), self.n, np.int64)
        live = np.arange(len(begin))
        at = end.astype(np.int64) - 1
        while len(live):
            live = live[at[live] >= begin[live]]
            c = symbols[at[live]]
            dead = live[c < 0]
            hi[dead] = lo[dead]
            live, c = live[c >= 0], c[c >= 0]
            lo[live], hi[live] = self._step(lo[live], c), self._step(hi[live], c)
            at[live] -= 1
            live = live[lo[live] < hi[live]]
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows."""
        rows, steps, out = rows.copy(), np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        live = np.arange(len(rows))
        while len(live):
            hit = self.marks.get(rows[live])
            h = live[hit]
            out[h] = self.samples[self.marks.rank(rows[h])] + steps[h]
            live = live[~hit]
            rows[live] = self._back(rows[live])
            steps[live] += 1
        return out % self.n
