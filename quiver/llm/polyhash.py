"""Prefix polynomial hashes modulo 2**64, for hashes of any stretch of a byte string."""

from __future__ import annotations

import numpy as np

BASE = np.uint64(0x5851F42D4C957F2D)          # odd, so it has an inverse modulo 2**64
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
SPREAD = np.uint64(0x9E3779B97F4A7C15)

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i up to n (kept, and grown when a longer text comes)."""
    if len(_powers[0]) <= n:
        size = max(1 << 16, 1 << n.bit_length())
        for k, base in enumerate((BASE, BASE_INVERSE)):
            steps = np.full(size + 1, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0][: n + 1], _powers[1][: n + 1]


def prefixes(raw: np.ndarray) -> np.ndarray:
    """h with h[j] - h[i], shifted by :func:`stretch`, the hash of raw[i:j]; len(raw) + 1 values."""
    h = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers(len(raw))[0][:-1], out=h[1:])
    return h


def stretch(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the stretches [start, end): equal bytes give equal values wherever they stand."""
    return (h[end] - h[start]) * powers(len(h) - 1)[1][start]


def mixed(values: np.ndarray, bits: int) -> np.ndarray:
    """The upper ``bits`` bits after spreading; low bits of polynomial hashes are weak."""
    values = values ^ (values >> np.uint64(29))
    return (values * SPREAD) >> np.uint64(64 - bits)
