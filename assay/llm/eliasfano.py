"""Elias-Fano coding of monotone sequences with vectorised successor search."""

from __future__ import annotations

import tempfile

import numpy as np


def mapped(array: np.ndarray) -> np.ndarray:
    """The array in a memory-mapped file that vanishes with its last user."""
    if not array.size:
        return array
    with tempfile.TemporaryFile() as f:
        array.tofile(f)
        f.flush()
        return np.memmap(f, array.dtype, "r", shape=array.shape)


class EliasFano:
    """Strictly increasing unsigned 64-bit values: low bits packed side by side,
    high bits as unary gaps, about ``2 + log2(universe / n)`` bits each."""

    def __init__(self, values: np.ndarray):
        values = np.asarray(values, np.uint64)
        self.n = n = len(values)
        top = int(values[-1]) if n else 0
        self.low_bits = l = max(0, min(56, (top // max(1, n)).bit_length() - 1))
        low = values & np.uint64((1 << l) - 1)
        width = (l + 7) // 8
        bits = np.unpackbits(low.astype("<u8").view(np.uint8).reshape(n, 8)[:, :width], axis=1, bitorder="little")[:, :l] if l else np.empty((n, 0), np.uint8)
        self.low = mapped(np.r_[np.packbits(bits.ravel(), bitorder="little"), np.zeros(8, np.uint8)])
        high = (values >> np.uint64(l)).astype(np.int64)
        self.last_high = int(high[-1]) if n else -1
        unary = np.zeros((n + self.last_high + 2 + 63) // 64 * 64 + 64, np.uint8)
        unary[high + np.arange(n)] = 1
        words = np.packbits(unary, bitorder="little").view("<u8")
        self.words = mapped(words)
        self.zeros = mapped(np.cumsum(64 - np.bitwise_count(words).astype(np.int64)).astype(np.uint64))

    def _select_zero(self, k: np.ndarray) -> np.ndarray:
        """Place of the zero number ``k`` (from 0) in the unary part."""
        word = np.searchsorted(self.zeros, k.astype(np.uint64), side="right")
        left = k - np.where(word > 0, self.zeros[word - 1].astype(np.int64), 0)
        bits = ~self.words[word]
        place = word.astype(np.int64) * 64
        for width in (32, 16, 8, 4, 2, 1):
            there = np.bitwise_count(bits & np.uint64((1 << width) - 1)).astype(np.int64)
            on = left >= there
            left -= np.where(on, there, 0)
            bits = np.where(on, bits >> np.uint64(width), bits)
            place += np.where(on, width, 0)
        return place

    def _low(self, at: np.ndarray) -> np.ndarray:
        bit = at * self.low_bits
        window = self.low[(bit >> 3)[:, None] + np.arange(8)]
        return (np.ascontiguousarray(window).view("<u8").ravel() >> (bit & 7).astype(np.uint64)) & np.uint64((1 << self.low_bits) - 1)

    def successor(self, x: np.ndarray) -> np.ndarray:
        """Index of the first value that is not less than ``x``; n if none is."""
        x = np.asarray(x, np.uint64)
        out = np.full(len(x), self.n, np.int64)
        high = (x >> np.uint64(self.low_bits)).astype(np.int64)
        todo = np.flatnonzero(high <= self.last_high)
        h, low = high[todo], x[todo] & np.uint64((1 << self.low_bits) - 1)
        begin = np.where(h > 0, self._select_zero(np.maximum(h - 1, 0)) + 1 - h, 0)
        end = self._select_zero(h) - h
        while True:
            open_ = np.flatnonzero(begin < end)
            if not len(open_):
                break
            middle = (begin[open_] + end[open_]) >> 1
            less = self._low(middle) < low[open_]
            begin[open_] = np.where(less, middle + 1, begin[open_])
            end[open_] = np.where(less, end[open_], middle)
        out[todo] = begin
        return out

    def value(self, at: np.ndarray) -> np.ndarray:
        """The values at the given indexes."""
        at = np.asarray(at, np.int64)
        total = np.arange(1, len(self.words) + 1, dtype=np.int64) * 64 - self.zeros.astype(np.int64)
        word = np.searchsorted(total, at, side="right")
        left = at - np.where(word > 0, total[word - 1], 0)
        bits = self.words[word].copy()
        place = word.astype(np.int64) * 64
        for width in (32, 16, 8, 4, 2, 1):
            there = np.bitwise_count(bits & np.uint64((1 << width) - 1)).astype(np.int64)
            on = left >= there
            left -= np.where(on, there, 0)
            bits = np.where(on, bits >> np.uint64(width), bits)
            place += np.where(on, width, 0)
        return ((place - at).astype(np.uint64) << np.uint64(self.low_bits)) | self._low(at)

    def find(self, x: np.ndarray) -> np.ndarray:
        """Index of each ``x``, -1 where it is no value."""
        if not self.n:
            return np.full(len(x), -1, np.int64)
        at = self.successor(x)
        inside = np.flatnonzero(at < self.n)
        out = np.full(len(x), -1, np.int64)
        hit = self.value(at[inside]) == np.asarray(x, np.uint64)[inside]
        out[inside[hit]] = at[inside[hit]]
        return out
