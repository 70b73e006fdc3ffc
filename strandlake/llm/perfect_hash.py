"""Minimal perfect hash over pairs of 64-bit hashes, built and probed in numpy.

Levels of bit arrays: a key sits at the first level where no other remaining key
shares its position; its number is the count of set bits before it. About
``gamma`` * 1.6 bits a key, without any stored key.
"""

from __future__ import annotations

import numpy as np

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit counter generator; wraps around."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class MinimalPerfectHash:
    """Numbers the n distinct of (h1, h2) pairs 0..n-1; pairs may repeat. Other pairs get any number, or -1."""

    def __init__(self, h1: np.ndarray, h2: np.ndarray, gamma: float = 1.7, levels: int = 64):
        self.bits: list[np.ndarray] = []
        for level in range(levels):
            if not len(h1):
                break
            size = max(64, -(-int(gamma * len(h1)) // 64) * 64)
            at = self._position(h1, h2, level, size)
            # A position is taken if all pairs that fall on it are one and the same.
            some = np.empty(size, np.int64)
            some[at] = np.arange(len(at))
            other = (h1[some[at]] != h1) | (h2[some[at]] != h2)
            taken = np.zeros(size, bool)
            taken[at] = True
            taken[at[other]] = False
            self.bits.append(np.packbits(taken, bitorder="little").view(np.uint64))
            rest = ~taken[at]
            h1, h2 = h1[rest], h2[rest]
        if len(h1):
            raise ValueError("pairs that no level tells apart")
        self._rank()

    def _rank(self) -> None:
        self.sizes = [64 * len(b) for b in self.bits]
        self.ranks, self.n = [], 0
        for packed in self.bits:
            ones = np.bitwise_count(packed).astype(np.int64)
            self.ranks.append(self.n + np.cumsum(ones) - ones)
            self.n += int(ones.sum())

    def to_bytes(self) -> bytes:
        head = np.array([len(self.bits), *map(len, self.bits)], np.int64)
        return head.tobytes() + b"".join(b.tobytes() for b in self.bits)

    @classmethod
    def from_bytes(cls, data: bytes) -> MinimalPerfectHash:
        out = cls.__new__(cls)
        levels = int(np.frombuffer(data, np.int64, 1)[0])
        lengths = np.frombuffer(data, np.int64, levels, 8)
        words = np.frombuffer(data, np.uint64, int(lengths.sum()), 8 * (1 + levels))
        out.bits = np.split(words, np.cumsum(lengths)[:-1]) if levels else []
        out._rank()
        return out

    @staticmethod
    def _position(h1: np.ndarray, h2: np.ndarray, level: int, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = mix(h1 ^ mix(h2 + np.uint64(level + 1) * _GOLDEN))
        return (h % np.uint64(size)).astype(np.int64)

    def lookup(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        out = np.full(len(h1), -1, np.int64)
        left = np.arange(len(h1))
        for level, (packed, size, ranks) in enumerate(zip(self.bits, self.sizes, self.ranks, strict=True)):
            if not len(left):
                break
            at = self._position(h1[left], h2[left], level, size)
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            hit = (packed[word] >> bit) & np.uint64(1) == 1
            below = packed[word[hit]] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            out[left[hit]] = ranks[word[hit]] + np.bitwise_count(below).astype(np.int64)
            left = left[~hit]
        return out
