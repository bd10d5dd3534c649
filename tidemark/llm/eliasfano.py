"""Elias-Fano sequences over numpy arrays, asked in whole batches."""

from __future__ import annotations

import numpy as np

U = np.uint64
_ONES, _HIGH = U(0x0101010101010101), U(0x8080808080808080)
#: Place of the r-th set bit of a byte, at 8 * byte + r.
_PLACE = np.array([([i for i in range(8) if b >> i & 1] + [0] * 8)[r] for b in range(256) for r in range(8)], np.uint64)


def encode(values: np.ndarray, universe: int) -> dict[str, np.ndarray]:
    """Arrays of a non-decreasing sequence of values below `universe`."""
    n = len(values)
    values = values.astype(np.uint64)
    bits = max(0, (universe // max(n, 1)).bit_length() - 1)
    high = (values >> U(bits)).astype(np.int64)
    size = n + (universe >> bits) + 65
    flags = np.zeros(-(-size // 64) * 64, bool)
    flags[high + np.arange(n)] = True
    upper = np.packbits(flags, bitorder="little").view(np.uint64)
    ones = np.concatenate([[0], np.cumsum(np.bitwise_count(upper))]).astype(np.uint32)
    lower = np.zeros(n * bits // 64 + 2, np.uint64)
    if bits:
        low = values & U((1 << bits) - 1)
        at = np.arange(n, dtype=np.uint64) * U(bits)
        word, off = (at >> U(6)).astype(np.int64), at & U(63)
        np.bitwise_or.at(lower, word, low << off)
        over = off + U(bits) > U(64)
        np.bitwise_or.at(lower, word[over] + 1, low[over] >> (U(64) - off[over]))
    return {"meta": np.array([n, bits], np.int64), "upper": upper, "ones": ones, "lower": lower}


def _in_word(word: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Place of the r-th set bit of each word: the byte by its prefix counts, all eight compared at once, then a table."""
    x = word - ((word >> U(1)) & U(0x5555555555555555))
    x = (x & U(0x3333333333333333)) + ((x >> U(2)) & U(0x3333333333333333))
    x = ((x + (x >> U(4))) & U(0x0F0F0F0F0F0F0F0F)) * _ONES
    r = r.astype(np.uint64)
    shift = np.bitwise_count(((r * _ONES | _HIGH) - x) & _HIGH).astype(np.uint64) << U(3)
    inside = r - (((x << U(8)) >> shift) & U(255))
    return (shift + _PLACE[((word >> shift) & U(255)) << U(3) | inside]).astype(np.int64)


class EliasFano:
    def __init__(self, arrays: dict[str, np.ndarray]):
        self.n, self.bits = (int(x) for x in arrays["meta"])
        self.upper, self.ones, self.lower = arrays["upper"], arrays["ones"], arrays["lower"]
        self.zeros = np.arange(len(self.ones), dtype=np.int64) * 64 - self.ones

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.uint64) * U(self.bits)
        word, off = (at >> U(6)).astype(np.int64), at & U(63)
        left = (U(64) - off) & U(63)
        rest = np.where(off > 0, self.lower[word + 1] << left, U(0))
        return ((self.lower[word] >> off) | rest) & U((1 << self.bits) - 1)

    def last(self) -> int:
        return int(self.access(np.array([self.n - 1]))[0]) if self.n else -1

    def access(self, i: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.ones, i.astype(np.uint32), "right") - 1
        place = word * 64 + _in_word(self.upper[word], i - self.ones[word])
        return ((place - i).astype(np.uint64) << U(self.bits)) | self._low(i)

    def _bucket(self, b: np.ndarray) -> np.ndarray:
        """Elements whose high part is below b."""
        k = np.maximum(b - 1, 0)
        word = np.searchsorted(self.zeros, k, "right") - 1
        place = word * 64 + _in_word(~self.upper[word], k - self.zeros[word])
        return np.where(b > 0, place - k, 0)

    def find(self, x: np.ndarray) -> np.ndarray:
        """Place of each value, -1 where the successor is another value. Values must be below the universe."""
        if not self.n or not len(x):
            return np.full(len(x), -1)
        b = (x >> U(self.bits)).astype(np.int64)
        both = self._bucket(np.concatenate([b, b + 1]))
        lo, end = both[: len(b)], both[len(b) :]
        want = x & U((1 << self.bits) - 1)
        a, z = lo.copy(), end.copy()
        left = np.flatnonzero(a < z)
        while len(left):  # most buckets hold an element or two, so few places are left after the first steps
            x, y = a[left], z[left]
            mid = (x + y) >> 1
            less = self._low(mid) < want[left]
            x, y = np.where(less, mid + 1, x), np.where(less, y, mid)
            a[left], z[left] = x, y
            left = left[x < y]
        ok = a < end
        ok[ok] = self._low(a[ok]) == want[ok]
        return np.where(ok, a, -1)
