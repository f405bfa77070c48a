"""Elias-Fano sequences and an n-gram trie of memory-mapped levels.

A monotone sequence of n values below u takes about 2 + log2(u / n) bits a
value: the low bits are packed, the high bits are a unary bit vector whose
cumulative popcounts give random access.
"""

from __future__ import annotations

import numpy as np

_ONE = np.uint64(1)
#: searches done at once, to bound their memory
PART = 100_000
_POPCOUNT = np.array([bin(i).count("1") for i in range(256)], np.uint8)
#: position of the k-th set bit of a byte
_SELECT = np.array([[([j for j in range(8) if b >> j & 1] + [0] * 8)[k] for k in range(8)] for b in range(256)], np.uint8)


class EliasFano:
    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, ranks: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.ranks = n, low_bits, low, high, ranks

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        """``values``: uint64, never falling."""
        n = len(values)
        top = int(values[-1]) + 1 if n else 1
        bits = max(0, (top // max(n, 1)).bit_length() - 1)
        low = np.zeros((n * bits + 63) // 64 + 1, np.uint64)
        if bits:
            part = values & np.uint64((1 << bits) - 1)
            at = np.arange(n, dtype=np.uint64) * np.uint64(bits)
            word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            np.bitwise_or.at(low, word, part << shift)
            over = np.flatnonzero(shift + np.uint64(bits) > np.uint64(64))
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (np.uint64(64) - shift[over]))
        ones = (values >> np.uint64(bits)) + np.arange(n, dtype=np.uint64)
        size = int(ones[-1]) // 64 + 1 if n else 1
        high = np.zeros(size, np.uint64)
        np.bitwise_or.at(high, (ones >> np.uint64(6)).astype(np.int64), _ONE << (ones & np.uint64(63)))
        ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(high), dtype=np.int64)]).astype(np.int64)
        return cls(n, bits, low, high, ranks)

    def parts(self) -> list[np.ndarray]:
        return [np.array([self.n, self.low_bits], np.int64), self.low, self.high, self.ranks]

    @classmethod
    def of(cls, parts: list[np.ndarray]) -> EliasFano:
        return cls(int(parts[0][0]), int(parts[0][1]), *parts[1:])

    def access(self, i: np.ndarray) -> np.ndarray:
        """The i-th values."""
        word = np.searchsorted(self.ranks, i, side="right") - 1
        left = (i - self.ranks[word]).astype(np.int64)
        chunk = np.ascontiguousarray(self.high[word]).view(np.uint8).reshape(-1, 8)
        sums = np.cumsum(_POPCOUNT[chunk], axis=1, dtype=np.uint8)
        byte = (sums <= left[:, None].astype(np.uint8)).sum(axis=1)
        rows = np.arange(len(i))
        left -= np.where(byte > 0, sums[rows, byte - 1], 0).astype(np.int64)
        bit = word * 64 + byte * 8 + _SELECT[chunk[rows, byte], left]
        out = (bit - i).astype(np.uint64)
        b = self.low_bits
        if b:
            at = i.astype(np.uint64) * np.uint64(b)
            word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            part = self.low[word] >> shift
            over = shift + np.uint64(b) > np.uint64(64)
            part = np.where(over, part | (self.low[word + 1] << ((np.uint64(64) - shift) & np.uint64(63))), part)
            out = (out << np.uint64(b)) | (part & np.uint64((1 << b) - 1))
        return out

    def successor(self, values: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """For each value the first position in [start, stop) with an element not below it, or stop."""
        if len(values) > PART:
            cuts = range(0, len(values), PART)
            return np.concatenate([self.successor(values[k : k + PART], start[k : k + PART], stop[k : k + PART]) for k in cuts])
        a, b = start.astype(np.int64).copy(), stop.astype(np.int64).copy()
        live = np.flatnonzero(a < b)
        while len(live):
            mid = (a[live] + b[live]) >> 1
            less = self.access(mid) < values[live]
            a[live[less]] = mid[less] + 1
            b[live[~less]] = mid[~less]
            live = live[a[live] < b[live]]
        return a


def quantise(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """16-bit codes and (lowest, step)."""
    if not len(values):
        return np.zeros(0, np.uint16), np.array([0.0, 1.0])
    low, high = float(values.min()), float(values.max())
    step = max((high - low) / 65535, 1e-12)
    return np.round((values - low) / step).astype(np.uint16), np.array([low, step])


class Trie:
    """Two levels: words, and below each the words it was seen after.

    Words are 64-bit, contexts 32-bit hashes.  The second level is one monotone
    sequence: a word's contexts are shifted by the last value of the word before,
    so a search looks in a word's own range for the shifted context.
    """

    def __init__(self, parts: list[np.ndarray]):
        self.words, self.pointers, self.contexts = (EliasFano.of(parts[k : k + 4]) for k in (0, 4, 8))
        self.counts, self.codes, self.scale = parts[12:15]

    @classmethod
    def parts(cls, words: np.ndarray, counts: np.ndarray, sizes: np.ndarray, contexts: np.ndarray, scores: np.ndarray) -> list[np.ndarray]:
        """words rising, ``sizes`` contexts of each (rising in a word), a score for each context."""
        ends = np.cumsum(sizes)
        lasts = contexts[ends - 1].astype(np.uint64) if len(ends) else np.zeros(0, np.uint64)
        shift = np.concatenate([[np.uint64(0)], np.cumsum(lasts + _ONE, dtype=np.uint64)])
        values = contexts.astype(np.uint64) + np.repeat(shift[:-1], sizes)
        pointers = np.concatenate([[0], ends]).astype(np.uint64)
        codes, scale = quantise(scores)
        found: list[np.ndarray] = []
        for seq in (words, pointers, values):
            found += EliasFano.build(seq.astype(np.uint64)).parts()
        return [*found, counts.astype(np.int64), codes, scale]

    @classmethod
    def write(cls, parts: list[np.ndarray], file) -> list[tuple]:
        where = []
        for p in parts:
            file.write(b"\0" * (-file.tell() % 8))
            where.append((file.tell(), p.dtype.str, len(p)))
            file.write(np.ascontiguousarray(p).tobytes())
        file.write(b"\0" * 8)
        file.flush()
        return where

    @classmethod
    def mapped(cls, path: str, where: list[tuple]) -> Trie:
        data = np.memmap(path, np.uint8, "r")
        return cls([data[at : at + n * np.dtype(kind).itemsize].view(kind) for at, kind, n in where])

    def find(self, words: np.ndarray) -> np.ndarray:
        """Ranks of the words, -1 for unknown ones."""
        n = self.words.n
        if not n:
            return np.full(len(words), -1)
        at = self.words.successor(words, np.zeros(len(words), np.int64), np.full(len(words), n))
        got = self.words.access(np.minimum(at, n - 1)) == words
        return np.where(got & (at < n), at, -1)

    def scores(self, ranks: np.ndarray, contexts: np.ndarray) -> np.ndarray:
        """Stored scores of (word, context), NaN where the pair is not stored."""
        out = np.full(len(ranks), np.nan)
        if not self.contexts.n:
            return out
        rows = np.flatnonzero(ranks >= 0)
        r = ranks[rows]
        start, stop = self.pointers.access(r).astype(np.int64), self.pointers.access(r + 1).astype(np.int64)
        shift = np.where(start > 0, self.contexts.access(np.maximum(start - 1, 0)) + _ONE, np.uint64(0))
        target = contexts[rows].astype(np.uint64) + shift
        at = self.contexts.successor(target, start, stop)
        hit = at < stop
        hit[hit] = self.contexts.access(at[hit]) == target[hit]
        out[rows[hit]] = self.scale[0] + self.codes[at[hit]].astype(float) * self.scale[1]
        return out
