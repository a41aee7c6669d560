"""Minimal perfect hash over 128-bit keys: levels of bit arrays, ranks by counting set bits."""

from __future__ import annotations

import numpy as np

from logquarry.llm.text import splitmix

LEVELS = 40
GAMMA = 1.6


def _place(first: np.ndarray, second: np.ndarray, level: int, size: int) -> np.ndarray:
    step = np.uint64((level * 0x9E3779B97F4A7C15 + 1) & (1 << 64) - 1)
    return splitmix(splitmix(first + step) ^ second) % np.uint64(size)


class MinimalHash:
    """Gives each of n distinct keys its own number below n; other keys get any number or -1."""

    def __init__(self, first: np.ndarray, second: np.ndarray):
        self.n = len(first)
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []
        self.rest: dict[tuple[int, int], int] = {}
        counted = 0
        for level in range(LEVELS):
            if not len(first):
                break
            size = int(len(first) * GAMMA) + 64
            at = _place(first, second, level, size)
            alone = np.bincount(at.astype(np.int64), minlength=size) == 1
            words = np.zeros(size // 64 + 1, np.uint64)
            where = np.flatnonzero(alone).astype(np.uint64)
            np.bitwise_or.at(words, (where >> np.uint64(6)).astype(np.int64), np.uint64(1) << (where & np.uint64(63)))
            ones = np.bitwise_count(words).astype(np.int64)
            self.levels.append((size, words, counted + np.cumsum(ones) - ones))
            counted += int(ones.sum())
            left = ~alone[at.astype(np.int64)]
            first, second = first[left], second[left]
        for key in zip(first.tolist(), second.tolist()):  # practically none after so many levels
            self.rest[key] = counted
            counted += 1

    def __call__(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        out = np.full(len(first), -1, np.int64)
        open_ = np.arange(len(first))
        for level, (size, words, ranks) in enumerate(self.levels):
            if not len(open_):
                break
            at = _place(first[open_], second[open_], level, size)
            word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            hit = (words[word] >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(words[word] & ((np.uint64(1) << bit) - np.uint64(1)))
            out[open_[hit]] = (ranks[word] + below)[hit]
            open_ = open_[~hit]
        for i in open_.tolist() if self.rest else ():
            out[i] = self.rest.get((int(first[i]), int(second[i])), -1)
        return out
