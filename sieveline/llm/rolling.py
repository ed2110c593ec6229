"""Polynomial hashes of byte ranges in numpy, modulo 2^64."""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15 | 1
STEP = 1 << 16
KEPT = (1 << 20) + STEP
"""Powers that a worker keeps, a block of 2^20 bytes and what separates its texts; longer series are made for the block that needs them."""
_grown: dict[int, np.ndarray] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))  # a copy, changed in place from here on
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_TABLE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def _series(base: int, n: int) -> np.ndarray:
    known = _grown.get(base)
    if known is None or len(known) < n:
        # whole steps, so that the next slightly longer block finds enough
        known = np.full(max(1, -(-n // STEP)) * STEP, base, np.uint64)
        known[0] = 1
        known = np.multiply.accumulate(known)
        if n <= KEPT:
            _grown[base] = known
    return known[:n]


def powers(n: int) -> np.ndarray:
    return _series(BASE, n)


def inverse_powers(n: int) -> np.ndarray:
    return _series(pow(BASE, -1, 1 << 64), n)


def weights_of(values: np.ndarray) -> np.ndarray:
    """A random-looking 64-bit weight for each byte."""
    return _TABLE[values]


def prefix_sums(values: np.ndarray, weights: np.ndarray = _TABLE) -> np.ndarray:
    """Weighted sums of all heads of a byte string, the empty one first; the difference of two hashes what lies between."""
    sums = np.empty(len(values) + 1, np.uint64)
    sums[0] = 0
    weighed = weights[values]
    weighed *= powers(len(values))
    np.cumsum(weighed, out=sums[1:])
    return sums


def window_hashes(values: np.ndarray, size: int) -> np.ndarray:
    """Hash of every window of `size` bytes, by the place it starts at."""
    if len(values) < size:
        return np.zeros(0, np.uint64)
    sums = prefix_sums(values)
    n = len(values) - size + 1
    hashes = sums[size:] - sums[:n]
    hashes *= inverse_powers(n)
    return mixed(hashes)
