"""Sets of hashed word shingles, computed over UTF-8 bytes with numpy."""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_RNG.integers(2**40, 2**62)) | 1
_LANES = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
#: A second hash of its own numbers.
_BYTE_2 = np.random.default_rng(20250301).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE_2 = int(np.random.default_rng(20250302).integers(2**40, 2**62)) | 1


class _Powers(list):
    """A cache that travels to executors empty."""

    def __reduce__(self):
        return _Powers, ()


_powers: list[np.ndarray] = _Powers()
_powers_2: list[np.ndarray] = _Powers()


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(n: int, second: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    held, own = (_powers_2, _BASE_2) if second else (_powers, _BASE)
    if not held or len(held[0]) < n:
        size = max(n, 1 << 16)
        both = []
        for base in (own, pow(own, -1, 1 << 64)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            both.append(np.cumprod(steps))
        held[:] = both
    return held[0][:n], held[1][:n]


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of each word; a word is a run of bytes other than blanks, A-Z lower-cased."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    solid = ~_BLANK[data]
    edge = np.zeros(n + 1, bool)
    edge[off[:-1][off[:-1] < n]] = True
    edge[n] = True
    begin = solid.copy()
    begin[1:] &= ~solid[:-1] | edge[1:n]
    end = solid.copy()
    end[:-1] &= ~solid[1:] | edge[1:n]
    start, stop = np.flatnonzero(begin), np.flatnonzero(end) + 1
    up, down = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[_LOWER[data]] * up[:n], out=total[1:])
    return mix((total[stop] - total[start]) * down[start]), np.searchsorted(off, start, "right") - 1


def sets(data: np.ndarray, off: np.ndarray, size: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles of `size` words; of all its words if they are fewer."""
    h, owner = words(data, off)
    rows = len(off) - 1
    count = np.bincount(owner, minlength=rows) if len(owner) else np.zeros(rows, np.int64)
    edge = np.concatenate(([0], np.cumsum(count)))
    n = len(h) - size + 1
    long = np.zeros(0, np.uint64)
    if n > 0:
        long = np.zeros(n, np.uint64)
        for j in range(size):
            long += h[j : j + n] * _LANES[j]
        long = mix(long)
    out = []
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(long[a : b - size + 1]))
        elif b > a:
            whole = np.append(h[a:b] * _LANES[: b - a], _LANES[63:] * np.uint64(b - a))
            out.append(mix(whole.sum(dtype=np.uint64, keepdims=True)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
