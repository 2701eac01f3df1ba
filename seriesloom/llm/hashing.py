"""Hashes of byte windows and words of many texts at once, with NumPy.

A prefix sum of ``code(byte) * BASE**position`` over a buffer gives the hash of
every window in two operations, whatever its length; multiplying by the inverse
power makes it independent of the position. All arithmetic is modulo 2**64.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)

_powers: dict[int, np.ndarray] = {}


def scramble(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x + U64(seed * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


CODES = scramble(np.arange(1, 257, dtype=U64), 1)


def powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1), kept between calls."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        room = max(1 << 16, 1 << (n - 1).bit_length())
        known = np.full(room, base, U64)
        known[0] = 1
        known = np.multiply.accumulate(known)
        if room <= 1 << 23:
            _powers[base] = known
    return known[:n]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """One more entry than bytes: the hash sum before each byte."""
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum(CODES[data] * powers(BASE, len(data)), out=sums[1:])
    return sums


def window_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of data[starts:ends], scrambled; equal bytes give equal hashes."""
    inverse = powers(INVERSE, len(sums))
    return scramble((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(U64))


def is_space(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text index of every run of non-space bytes; runs never cross texts."""
    if not len(data):
        empty = np.empty(0, np.int64)
        return empty, empty, empty
    solid = ~is_space(data)
    first = np.zeros(len(data) + 1, bool)
    first[offsets[:-1]] = True
    start = solid.copy()
    start[1:] &= ~solid[:-1] | first[1:-1]
    end = solid
    end[:-1] &= ~solid[1:] | first[1:-1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def word_offsets(owner: np.ndarray, texts: int) -> np.ndarray:
    """Where the words of each text begin in a list of words sorted by text."""
    return np.searchsorted(owner, np.arange(texts + 1))
