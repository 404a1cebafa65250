"""Hashes of windows, and prefix hashes from which any substring's can be had."""

from __future__ import annotations

import numpy as np

_BYTE = np.random.default_rng(7).integers(0, 2**64, 256, np.uint64) | np.uint64(1)
_MIX = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_LEVEL = np.random.default_rng(5).integers(0, 2**64, 64, np.uint64) | np.uint64(1)


def byte_values(data: np.ndarray) -> np.ndarray:
    """A random 64-bit value for each byte."""
    return _BYTE[data]


def mix(x: np.ndarray) -> np.ndarray:
    """Scatters 64-bit values one to one."""
    x = (x ^ (x >> np.uint64(33))) * _MIX[0]
    x = (x ^ (x >> np.uint64(33))) * _MIX[1]
    return x ^ (x >> np.uint64(33))


_BLOCK = 1 << 14  # windows hashed at a time, so that all steps stay in the cache


def window_hashes(values: np.ndarray, length: int) -> np.ndarray:
    """A hash of each window of `length` values: 64-bit ones, or bytes in windows of 8 or more.

    Hashes of windows of 1, 2, 4 ... values are joined two by two, and scattered at each step, so that no
    pattern of values cancels out. Bytes are taken eight at a time.
    """
    n = max(len(values) - length + 1, 0)
    out = np.empty(n, np.uint64)
    for at in range(0, n, _BLOCK):
        part = values[at : min(at + _BLOCK, n) + length - 1]
        out[at : at + _BLOCK] = _of_bytes(part, length) if values.dtype == np.uint8 else _of_values(part, length)
    return out


def _of_bytes(data: np.ndarray, length: int) -> np.ndarray:
    n = len(data) - length + 1
    eight = np.ndarray(len(data) - 7, "<u8", np.ascontiguousarray(data), strides=(1,)).copy()  # the 8 bytes from each place on
    out = mix(eight[:n])
    for at in [*range(8, length - 8, 8), length - 8]:
        out = _joined(out, eight[at : at + n], _LEVEL[at // 8])
    return mix(out)


def _of_values(values: np.ndarray, length: int) -> np.ndarray:
    n = len(values) - length + 1
    part, span, out, done = values, 1, None, 0
    for level in range(length.bit_length()):
        if length >> level & 1:
            here = part[done : done + n]
            out = here if out is None else _joined(out, here, _LEVEL[32 + level])
            done += span
        if length >> (level + 1):
            part = _joined(part[:-span], part[span:], _LEVEL[level])
            span *= 2
    return mix(out)


def _joined(a: np.ndarray, b: np.ndarray, by: np.uint64) -> np.ndarray:
    x = a * by
    x ^= x >> np.uint64(29)
    x += b
    x *= _MIX[1]
    x ^= x >> np.uint64(32)
    return x


#: Prefix hashes are polynomials modulo this prime, at a base drawn once; two strings of n symbols collide at n bases at most.
PRIME = (1 << 61) - 1
BASE = int(np.random.default_rng(23).integers(1 << 40, PRIME - 1))
_P, _32, _29, _61, _31 = np.uint64(PRIME), np.uint64(32), np.uint64(29), np.uint64(61), np.uint64(31)
_LOW32, _LOW29, _LOW31 = np.uint64((1 << 32) - 1), np.uint64((1 << 29) - 1), np.uint64((1 << 31) - 1)


def _reduced(x: np.ndarray) -> np.ndarray:
    x = (x & _P) + (x >> _61)
    return np.where(x >= _P, x - _P, x)


def times(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    """Products modulo PRIME of numbers below it."""
    a1, a0, b1, b0 = a >> _32, a & _LOW32, b >> _32, b & _LOW32
    middle = a1 * b0 + a0 * b1
    low = a0 * b0
    return _reduced((a1 * b1 << np.uint64(3)) + (middle >> _29) + ((middle & _LOW29) << _32) + (low >> _61) + (low & _P))


def powers(n: int) -> np.ndarray:
    """The first n powers of BASE."""
    out = np.ones(n, np.uint64)
    have = 1
    while have < n:
        more = min(have, n - have)
        out[have : have + more] = times(out[:more], np.uint64(pow(BASE, have, PRIME)))
        have += more
    return out


class PrefixHashes:
    """Polynomial prefix hashes of a sequence of 64-bit values; equal substrings have equal hashes."""

    def __init__(self, values: np.ndarray, up: np.ndarray | None = None):
        n = len(values)
        self.up = powers(n + 1) if up is None else up[: n + 1]
        terms = times(_reduced(values >> np.uint64(3)), self.up[:n])
        high, low = np.cumsum(terms >> _31, dtype=np.uint64), np.cumsum(terms & _LOW31, dtype=np.uint64)
        self.prefix = np.zeros(n + 1, np.uint64)
        self.prefix[1:] = _reduced(times(_reduced(high), np.uint64(1 << 31)) + _reduced(low))

    def same(self, a: np.ndarray, other: PrefixHashes, b: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether n values from a here and from b there have equal hashes: each is shifted to the other's place."""
        x, y = self.prefix[a + n] + _P - self.prefix[a], other.prefix[b + n] + _P - other.prefix[b]
        ahead = b >= a
        up = self.up if len(self.up) >= len(other.up) else other.up
        shift = up[np.abs(b - a)]
        moved = times(_reduced(np.where(ahead, x, y)), shift)
        return moved == _reduced(np.where(ahead, y, x))
