"""Elias-Fano sequences in flat buffers, read by numpy in batches.

A non-decreasing sequence of n values below u is kept as its low bits, packed, and the
counts of its high parts in unary: about 2 + log2(u/n) bits a value. The buffers are read
in place, so a worker holds them once and builds nothing from them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_ONE = np.uint64(1)


@dataclass(frozen=True)
class EliasFano:
    size: int
    low_bits: int
    low: np.ndarray
    high: np.ndarray
    ones: np.ndarray

    @staticmethod
    def of(values: np.ndarray, universe: int) -> EliasFano:
        """From non-decreasing values below ``universe``."""
        values = np.asarray(values, np.uint64)
        n = len(values)
        bits = max(0, int(np.log2(max(universe, 1) / max(n, 1))))
        packed = np.zeros(n * bits // 64 + 2, np.uint64)
        at = np.arange(n, dtype=np.uint64) * np.uint64(bits)
        if bits:
            part = values & np.uint64((1 << bits) - 1)
            word, shift = at >> np.uint64(6), at & np.uint64(63)
            np.bitwise_or.at(packed, word.astype(np.int64), part << shift)
            over = np.flatnonzero(shift + np.uint64(bits) > 64)
            np.bitwise_or.at(packed, word[over].astype(np.int64) + 1, part[over] >> (np.uint64(64) - shift[over]))
        tops = (values >> np.uint64(bits)).astype(np.int64)
        length = n + (int(universe) >> bits) + 2
        marks = np.zeros(-(-length // 64) * 64, np.uint8)
        marks[tops + np.arange(n)] = 1
        words = np.packbits(marks, bitorder="little").view("<u8").astype(np.uint64)
        ones = np.append(0, np.cumsum(np.bitwise_count(words))).astype(np.uint32)
        return EliasFano(n, bits, packed, words, ones)

    @property
    def nbytes(self) -> int:
        return self.low.nbytes + self.high.nbytes + self.ones.nbytes

    def _select(self, count: np.ndarray, ones: bool) -> np.ndarray:
        """Position of the one (or zero) with the given number, from 0."""
        before = self.ones.astype(np.int64) if ones else np.arange(len(self.ones)) * 64 - self.ones
        word = np.searchsorted(before, count, "right") - 1
        bits = self.high[word] if ones else ~self.high[word]
        rest = count - before[word]
        place = np.zeros(len(count), np.int64)
        for width in (32, 16, 8, 4, 2, 1):
            lower = bits & np.uint64((1 << width) - 1)
            inside = np.bitwise_count(lower).astype(np.int64)
            up = rest >= inside
            rest -= np.where(up, inside, 0)
            place += np.where(up, width, 0)
            bits = np.where(up, bits >> np.uint64(width), lower)
        return word * 64 + place

    def _lows(self, index: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(index), np.uint64)
        at = index.astype(np.uint64) * np.uint64(self.low_bits)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        first = self.low[word] >> shift
        second = np.where(shift > 0, self.low[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        return (first | second) & np.uint64((1 << self.low_bits) - 1)

    def get(self, index: np.ndarray) -> np.ndarray:
        """The values at some places."""
        index = np.asarray(index, np.int64)
        high = (self._select(index, True) - index).astype(np.uint64)
        return (high << np.uint64(self.low_bits)) | self._lows(index)

    def successor(self, values: np.ndarray) -> np.ndarray:
        """Place of the first value that is not less than each given one; ``size`` where none is."""
        return self.find(values)[0]

    def find(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each value's successor, and whether that is the value itself.

        The high part names a run of values; inside, places are halved by their low bits.
        """
        values = np.asarray(values, np.uint64)
        high = (values >> np.uint64(self.low_bits)).astype(np.int64)
        low = values & np.uint64((1 << self.low_bits) - 1)
        start = np.zeros(len(values), np.int64)
        later = high > 0
        start[later] = self._select(high[later] - 1, False) - (high[later] - 1)
        end = self._select(high, False) - high
        stop = end.copy()
        while True:
            open_ = np.flatnonzero(start < stop)
            if not len(open_):
                found = start < end
                inside = np.flatnonzero(found)
                found[inside] = self._lows(start[inside]) == low[inside]
                return start, found
            middle = (start[open_] + stop[open_]) >> 1
            less = self._lows(middle) < low[open_]
            start[open_] = np.where(less, middle + 1, start[open_])
            stop[open_] = np.where(less, stop[open_], middle)
