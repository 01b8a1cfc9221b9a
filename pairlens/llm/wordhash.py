"""Hashes of words and n-grams of a text, a text at a time but without a Python step for each word."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_BYTES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64)
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers below ``n`` modulo 2^64, and their inverses."""
    if len(_powers[0]) < n:
        size = 1 << n.bit_length()
        for k, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """Scatter the bits of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def running(data: np.ndarray) -> np.ndarray:
    """Sums over the bytes before each place, so that two of them give the hash of what is between."""
    p, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * p[:-1], out=out[1:])
    return out


def words(data: bytes) -> np.ndarray:
    """A 64-bit hash of each word of ``data``."""
    a = np.frombuffer(data, np.uint8)
    full = np.zeros(len(a) + 2, np.int8)
    full[1:-1] = ~_BLANK[a]
    turn = np.diff(full)
    starts, ends = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
    sums, (_, back) = running(a), powers(len(a) + 1)
    return mixed((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))


def shingles(w: np.ndarray, n: int) -> np.ndarray:
    """The distinct hashes of ``n`` words in a row, ascending; of fewer words, the one of all; of none, none."""
    if not len(w):
        return w
    n = min(n, len(w))
    last = len(w) - n + 1
    h = np.full(last, n, np.uint64)
    for j in range(n):
        h = mixed(h * np.uint64(0xD6E8FEB86659FD93) + w[j : j + last])
    return np.unique(h)
