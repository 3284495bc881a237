"""Vectorised rolling hashes over code points.

``prefix`` holds H[i] = sum of value[j] * B**j for j < i, modulo 2**64, with an
odd B, so the hash of any window is one subtraction and one multiplication.
"""

from __future__ import annotations

import numpy as np

_B = np.uint64(0x9E3779B97F4A7C15)
_B_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective finaliser on 64-bit words."""
    x = x ^ np.uint64(salt * 0xD1342543DE82EF95 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _reserve(n: int) -> None:
    global _powers, _inverse
    if len(_powers) < n:
        size = max(n, 2 * len(_powers), 1 << 16)
        steps = np.full(size, _B)
        steps[0] = 1
        _powers = np.multiply.accumulate(steps)
        steps = np.full(size, _B_INV)
        steps[0] = 1
        _inverse = np.multiply.accumulate(steps)


def codepoints(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def prefix(values: np.ndarray) -> np.ndarray:
    n = len(values)
    _reserve(n + 1)
    out = np.zeros(n + 1, np.uint64)
    np.cumsum(mix(values.astype(np.uint64) + np.uint64(1)) * _powers[:n], out=out[1:])
    return out


def spans(h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of values[starts:ends], the same wherever the span stands."""
    return mix((h[ends] - h[starts]) * _inverse[starts])


def windows(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of every window of ``size`` values; empty if there is none."""
    n = len(h) - size
    if n <= 0:
        return np.zeros(0, np.uint64)
    return mix((h[size:] - h[:n]) * _inverse[:n])
