"""64-bit hashes of words, computed with numpy over the bytes of many texts at once.

A word's hash is a polynomial in its bytes modulo 2^64, read off prefix sums, and mixed.
"""

from __future__ import annotations

import numpy as np

_BYTE = np.random.Generator(np.random.PCG64(1_618_033)).integers(0, 2**64, 256, dtype=np.uint64)
for _c in range(ord("A"), ord("Z") + 1):
    _BYTE[_c] = _BYTE[_c + 32]
#: Space, and tab to carriage return.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C13  # 3 mod 8

_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of the base and of its inverse, modulo 2^64."""
    size = 1 << max(16, (n - 1).bit_length())
    if not any(k >= n for k in _POWERS):
        _POWERS.clear()
        both = []
        for base in (_BASE, pow(_BASE, -1, 2**64)):
            p = np.full(size, np.uint64(base), np.uint64)
            p[0] = 1
            both.append(np.cumprod(p, dtype=np.uint64))
        _POWERS[size] = (both[0], both[1])
    return _POWERS[max(_POWERS)]


def prefix_sums(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums, down): (sums[b] - sums[a]) * down[a] is the polynomial hash of values[a:b]."""
    up, down = powers(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], dtype=np.uint64, out=total[1:])
    return total, down


def hash_words(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(start of each word in raw, its hash); words end at white space, A-Z count as lower case."""
    data = np.frombuffer(raw, np.uint8)
    inside = ~IS_SPACE[data]
    edge = np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    total, down = prefix_sums(_BYTE[data])
    return starts, mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
