"""Elias-Fano sequences in numpy: low bits packed, high parts as a bit array in unary."""

from __future__ import annotations

import numpy as np

ONE, SIX, ALL = np.uint64(1), np.uint64(6), np.uint64(63)


def _select(words: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Place of the set bit number ``rank`` of each 64-bit word."""
    place = np.zeros(len(words), np.uint64)
    left = ranks.astype(np.int64)
    for width in (32, 16, 8, 4, 2, 1):
        low = (words >> place) & np.uint64((1 << width) - 1)
        ones = np.bitwise_count(low).astype(np.int64)
        up = left >= ones
        left = np.where(up, left - ones, left)
        place = np.where(up, place + np.uint64(width), place)
    return place.astype(np.int64)


class EliasFano:
    """An ascending sequence of unsigned integers that can be searched as it lies."""

    def __init__(self, n: int, shift: int, low: np.ndarray, high: np.ndarray):
        self.n, self.shift, self.low, self.high = n, shift, low, high
        ones = np.bitwise_count(high).astype(np.int64)
        self.ones = np.cumsum(ones) - ones  # set bits before each word
        self.zeros = np.arange(len(high)) * 64 - self.ones

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = values.astype(np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        shift = max(0, (top // n).bit_length() - 1) if n else 0
        low = np.zeros(n * shift // 64 + 2, np.uint64)
        if shift and n:
            bits = values & np.uint64((1 << shift) - 1)
            at = np.arange(n, dtype=np.uint64) * np.uint64(shift)
            word, bit = (at >> SIX).astype(np.int64), at & ALL
            np.bitwise_or.at(low, word, bits << bit)
            over = bit + np.uint64(shift) > 64
            np.bitwise_or.at(low, word[over] + 1, bits[over] >> (np.uint64(64) - bit[over]))
        at = (values >> np.uint64(shift)) + np.arange(n, dtype=np.uint64)
        high = np.zeros((n + (top >> shift)) // 64 + 2, np.uint64)
        np.bitwise_or.at(high, (at >> SIX).astype(np.int64), ONE << (at & ALL))
        return cls(n, shift, low, high)

    def tobytes(self) -> bytes:
        return np.array([self.n, self.shift, len(self.low), len(self.high)], np.uint64).tobytes() + self.low.tobytes() + self.high.tobytes()

    @classmethod
    def at(cls, buffer, offset: int) -> tuple[EliasFano, int]:
        """The sequence that lies at ``offset`` of a buffer, without a copy; and the end of it."""
        n, shift, low, high = np.frombuffer(buffer, np.uint64, 4, offset).tolist()
        middle = offset + 32 + 8 * low
        views = np.frombuffer(buffer, np.uint64, low, offset + 32), np.frombuffer(buffer, np.uint64, high, middle)
        return cls(n, shift, *views), middle + 8 * high

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.shift:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.uint64) * np.uint64(self.shift)
        word, bit = (at >> SIX).astype(np.int64), at & ALL
        first = self.low[word] >> bit
        rest = np.where(bit > 0, self.low[word + 1] << ((np.uint64(64) - bit) & ALL), np.uint64(0))
        return (first | rest) & np.uint64((1 << self.shift) - 1)

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        """The values at the places ``i``."""
        word = np.searchsorted(self.ones, i, "right") - 1
        at = word * 64 + _select(self.high[word], i - self.ones[word])
        return ((at - i).astype(np.uint64) << np.uint64(self.shift)) | self._low(i)

    def _before(self, part: np.ndarray) -> np.ndarray:
        """How many values have a high part below ``part``."""
        out = np.zeros(len(part), np.int64)
        some = np.flatnonzero(part > 0)
        rank = part[some] - 1
        word = np.searchsorted(self.zeros, rank, "right") - 1
        at = word * 64 + _select(~self.high[word], rank - self.zeros[word])
        out[some] = at - rank
        return out

    def successor(self, x: np.ndarray) -> np.ndarray:
        """The place of the first value that is at least x (n if there is none)."""
        x = x.astype(np.uint64)
        parts = len(self.high) * 64 - self.n  # zeros, so high parts below this can be asked for
        part = (x >> np.uint64(self.shift)).astype(np.int64)
        beyond = part >= parts - 1
        part = np.minimum(part, parts - 2)
        a, b = self._before(part), self._before(part + 1)
        want = x & np.uint64((1 << self.shift) - 1)
        while True:
            open_ = np.flatnonzero(a < b)
            if not len(open_):
                break
            middle = (a[open_] + b[open_]) >> 1
            below = self._low(middle) < want[open_]
            a[open_[below]] = middle[below] + 1
            b[open_[~below]] = middle[~below]
        return np.where(beyond, self.n, a)
