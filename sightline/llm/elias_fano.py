"""Elias-Fano sequences in numpy arrays that can be memory-mapped, with vectorised access and search."""

from __future__ import annotations

import numpy as np

#: Elements whose low bits are packed at once.
CHUNK = 1 << 16


def _pack_low(values: np.ndarray, bits: int) -> np.ndarray:
    """The lowest bits of each value, one after another, in 64-bit words with one to spare."""
    out = np.zeros((len(values) * bits + 63) // 64 + 1, "<u8")
    raw, shifts = out.view(np.uint8), np.arange(bits)
    for at in range(0, len(values) if bits else 0, CHUNK):
        part = np.packbits(((values[at : at + CHUNK, None] >> shifts) & 1).astype(np.uint8).reshape(-1), bitorder="little")
        raw[at * bits // 8 : at * bits // 8 + len(part)] = part
    return out


def _select(words: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The place of the one of this rank in each 64-bit word, by halving."""
    words, rank, place = words.copy(), rank.copy(), np.zeros(len(words), np.int64)
    for half in (32, 16, 8, 4, 2, 1):
        ones = np.bitwise_count(words & np.uint64((1 << half) - 1)).astype(np.int64)
        above = rank >= ones
        rank -= ones * above
        place += half * above
        words >>= np.uint64(half) * above.astype(np.uint64)
    return place


class EliasFano:
    """A non-decreasing sequence of integers below 2**62: low bits packed, high bits in unary (for each high value a one an element, then a zero)."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray) -> None:
        self.n, self.low_bits, self.low, self.high, self.ones = n, low_bits, low, high, ones
        self.zeros: np.ndarray | None = None

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.int64)
        n = len(values)
        top = int(values[-1]) if n else 0
        bits = max(0, int(np.floor(np.log2(max(1, top) / max(1, n))))) if n else 0
        upper = values >> bits
        length = n + (int(upper[-1]) if n else 0) + 1
        flags = np.zeros(-(-length // 64) * 64, np.uint8)
        flags[upper + np.arange(n)] = 1
        high = np.packbits(flags, bitorder="little").view("<u8")
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(high), dtype=np.int64)])
        return cls(n, bits, _pack_low(values, bits), high, ones)

    def parts(self) -> list[np.ndarray]:
        """Five numbers and three arrays, all of eight bytes an element."""
        return [np.array([self.n, self.low_bits, len(self.low), len(self.high), len(self.ones)], "<i8"), self.low, self.high, self.ones.astype("<i8")]

    @classmethod
    def view(cls, raw: np.ndarray, at: int) -> tuple[EliasFano, int]:
        """The sequence that parts() wrote at a place of a byte array, and where it ends."""
        n, bits, n_low, n_high, n_ones = np.frombuffer(raw, "<i8", 5, at).tolist()
        at += 40
        low, high = np.frombuffer(raw, "<u8", n_low, at), np.frombuffer(raw, "<u8", n_high, at + 8 * n_low)
        at += 8 * (n_low + n_high)
        return cls(n, bits, low, high, np.frombuffer(raw, "<i8", n_ones, at)), at + 8 * n_ones

    def _place(self, k: np.ndarray, zeros: bool) -> np.ndarray:
        """Places of the k-th ones or zeros."""
        if zeros and self.zeros is None:
            self.zeros = np.arange(len(self.ones)) * 64 - self.ones
        before = self.zeros if zeros else self.ones
        word = np.searchsorted(before, k, "right") - 1
        bits = self.high[word]
        return word * 64 + _select(~bits if zeros else bits, k - before[word])

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.int64)
        bit = i * self.low_bits
        word, shift = bit >> 6, (bit & 63).astype(np.uint64)
        # shifted twice, since a shift by 64 is not defined
        found = self.low[word] >> shift | self.low[word + 1] << (np.uint64(63) - shift) << np.uint64(1)
        return (found & np.uint64((1 << self.low_bits) - 1)).astype(np.int64)

    def access(self, i: np.ndarray) -> np.ndarray:
        i = np.asarray(i, np.int64)
        if not len(i):
            return i
        return (self._place(i, False) - i) << self.low_bits | self._low(i)

    def find(self, x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The place of each x among the elements lo..hi-1, or -1."""
        x, out = np.asarray(x, np.int64), np.full(len(x), -1, np.int64)
        upper = x >> self.low_bits
        todo = np.flatnonzero((lo < hi) & (upper < len(self.high) * 64 - self.n))
        if not len(todo):
            return out
        u = upper[todo]
        start = np.zeros(len(todo), np.int64)
        later = u > 0
        start[later] = self._place(u[later] - 1, True) - (u[later] - 1)
        end = np.minimum(self._place(u, True) - u, hi[todo])
        at = np.maximum(start, lo[todo])
        want = x[todo] & ((1 << self.low_bits) - 1)
        # low bits rise within a high value, so its elements are halved
        top = end.copy()
        while (open_ := np.flatnonzero(at < top)).size:
            mid = (at[open_] + top[open_]) >> 1
            less = self._low(mid) < want[open_]
            at[open_[less]] = mid[less] + 1
            top[open_[~less]] = mid[~less]
        inside = np.flatnonzero(at < end)
        hit = inside[self._low(at[inside]) == want[inside]]
        out[todo[hit]] = at[hit]
        return out
