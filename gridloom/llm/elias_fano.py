"""Ascending integers in little space, queried in place: an Elias-Fano sequence over arrays that may be memory-mapped."""

from __future__ import annotations

import numpy as np

_EACH, _TOP = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)  # a one, and a sign, in each byte
#: The place of the k-th one of each byte.
_IN_BYTE = np.zeros((256, 8), np.uint8)
for _b in range(256):
    for _k, _i in enumerate(i for i in range(8) if _b >> i & 1):
        _IN_BYTE[_b, _k] = _i


class EliasFano:
    """values[i] is split: its lower bits stand packed, its upper part is the number of zeros before the i-th one of a bit vector."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray) -> None:
        self.n, self.l, self.low, self.high, self.ones = n, low_bits, low, high, ones

    @classmethod
    def encode(cls, values: np.ndarray, bound: int) -> EliasFano:
        """values: ascending, below bound."""
        n = len(values)
        values = values.astype(np.uint64)
        l = max(0, (bound // max(1, n)).bit_length() - 1)
        size = n + (bound >> l) + 2
        bits = np.zeros(-(-size // 64) * 64, np.uint8)
        bits[(values >> np.uint64(l)).astype(np.int64) + np.arange(n)] = 1
        high = np.packbits(bits, bitorder="little").view(np.uint64)
        low = np.zeros(-(-n * l // 64) + 2, np.uint64)
        if l and n:
            at = np.arange(n, dtype=np.int64) * l
            part, shift = values & np.uint64((1 << l) - 1), (at % 64).astype(np.uint64)
            np.bitwise_or.at(low, at // 64, part << shift)
            over = np.flatnonzero(at % 64 + l > 64)
            np.bitwise_or.at(low, at[over] // 64 + 1, part[over] >> (np.uint64(64) - shift[over]))
        return cls(n, l, low, high, np.concatenate([[0], np.cumsum(np.bitwise_count(high), dtype=np.int64)]).astype(np.uint32))

    def arrays(self) -> list[np.ndarray]:
        return [self.low, self.high, self.ones]

    def _select(self, k: np.ndarray, ones: bool) -> np.ndarray:
        """The place of the k-th one, or zero, counted from 0."""
        before = self.ones.astype(np.int64) if ones else np.arange(len(self.ones), dtype=np.int64) * 64 - self.ones
        word = np.searchsorted(before, k, side="right") - 1
        rest = (k - before[word]).astype(np.uint64)
        x = self.high[word] if ones else ~self.high[word]
        # how many ones there are up to each byte, in the byte itself
        sums = x - ((x >> np.uint64(1)) & np.uint64(0x5555555555555555))
        sums = (sums & np.uint64(0x3333333333333333)) + ((sums >> np.uint64(2)) & np.uint64(0x3333333333333333))
        sums = ((sums + (sums >> np.uint64(4))) & np.uint64(0x0F0F0F0F0F0F0F0F)) * _EACH
        shift = np.bitwise_count((((rest * _EACH) | _TOP) - sums) & _TOP).astype(np.uint64) * np.uint64(8)
        rest -= ((sums << np.uint64(8)) >> shift) & np.uint64(0xFF)
        return word * 64 + shift.astype(np.int64) + _IN_BYTE[(x >> shift) & np.uint64(0xFF), rest]

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.l:
            return np.zeros(len(i), np.uint64)
        at = i * self.l
        word, shift = at // 64, (at % 64).astype(np.uint64)
        out = self.low[word] >> shift
        over = at % 64 + self.l > 64
        out[over] |= self.low[word[over] + 1] << (np.uint64(64) - shift[over])
        return out & np.uint64((1 << self.l) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        i = np.asarray(i, np.int64)
        return ((self._select(i, True) - i).astype(np.uint64) << np.uint64(self.l)) | self._low(i)

    def find(self, low: np.ndarray, high: np.ndarray, value: np.ndarray) -> np.ndarray:
        """The place of value among places low to high - 1, or -1: the successor search within a context's range."""
        out = np.full(len(value), -1, np.int64)
        if not self.n:
            return out
        upper = (value >> np.uint64(self.l)).astype(np.int64)
        # values with the same upper part lie between two zeros
        first = np.where(upper > 0, self._select(np.maximum(upper - 1, 0), False) - np.maximum(upper - 1, 0), 0)
        last = self._select(upper, False) - upper
        first, last = np.maximum(first, low), np.minimum(last, high)
        part = value & np.uint64((1 << self.l) - 1)
        left = np.flatnonzero(first < last)
        end = last[left]
        a, b = first[left], end.copy()
        while len(left):
            middle = (a + b) // 2
            less = self._low(middle) < part[left]
            a, b = np.where(less, middle + 1, a), np.where(less, b, middle)
            done = a >= b
            found = left[done][(a[done] < end[done])]
            at = a[done][(a[done] < end[done])]
            same = self._low(at) == part[found]
            out[found[same]] = at[same]
            left, end, a, b = left[~done], end[~done], a[~done], b[~done]
        return out
