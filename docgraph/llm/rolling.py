"""Polynomial hashes of spans of bytes, modulo the prime 2**61 - 1."""

from __future__ import annotations

import numpy as np

from .common import mix64

PRIME = (1 << 61) - 1
BASES = (0x0A24B7C51E6F3D97, 0x16D3F08A9B4C72E5)
STEP = 1 << 15  # at most 1 << 24, as sums of so many terms fit in 64 bits; fewer stay in a processor's cache

_P, _LOW30, _LOW31 = np.uint64(PRIME), np.uint64((1 << 30) - 1), np.uint64((1 << 31) - 1)
_30, _31, _61 = np.uint64(30), np.uint64(31), np.uint64(61)


def fold(x: np.ndarray) -> np.ndarray:
    x = (x & _P) + (x >> _61)
    return np.where(x >= _P, x - _P, x)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo the prime of numbers below it, by halves."""
    ah, al, bh, bl = a >> _31, a & _LOW31, b >> _31, b & _LOW31
    middle = al * bh + ah * bl
    return fold(ah * bh * np.uint64(2) + (middle >> _30) + ((middle & _LOW30) << _31) + al * bl)


def _shift30(x: np.ndarray) -> np.ndarray:
    return ((x << _30) & _P) + (x >> _31)


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """The first n powers or more."""
    got = _POWERS.get(base)
    if got is None:
        got = np.array([1], dtype=np.uint64)
    while len(got) < n:
        got = np.concatenate([got, times(got, np.uint64(pow(base, len(got), PRIME)))])
    _POWERS[base] = got
    return got


class Rolling:
    """Hashes of any span of ``data`` in constant time each, alike wherever equal bytes stand.

    Two given spans that differ agree with a chance of about their length in 2**61, whatever their bytes; the lanes are
    independent of each other.
    """

    def __init__(self, data: np.ndarray, lane: int = 0):
        n = len(data)
        self.power = powers(BASES[lane], n + 1)
        self.inverse = powers(pow(BASES[lane], -1, PRIME), n + 1)
        self.prefix = np.zeros(n + 1, dtype=np.uint64)
        for a in range(0, n, STEP):
            b = min(n, a + STEP)
            byte, power = data[a:b].astype(np.uint64) + np.uint64(1), self.power[a:b]
            high, low = np.cumsum(byte * (power >> _30), dtype=np.uint64), np.cumsum(byte * (power & _LOW30), dtype=np.uint64)
            self.prefix[a + 1 : b + 1] = fold(_shift30(fold(high)) + fold(low) + self.prefix[a])

    def raw(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return times(fold(self.prefix[stop] + _P - self.prefix[start]), self.inverse[start])

    def hash(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix64(self.raw(start, stop) + ((stop - start).astype(np.uint64) << _61))

    def joined(self, a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
        """Hash of bytes [a, b) and [c, d) put together, as ``hash`` of the joined bytes."""
        return mix64(fold(self.raw(a, b) + times(self.raw(c, d), self.power[b - a])) + ((b - a + d - c).astype(np.uint64) << _61))
