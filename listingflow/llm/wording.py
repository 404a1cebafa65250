"""Words of texts as numbers, told apart by their bytes."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import xxhash

from .hashing import mix

_BY = np.uint64(0x9E3779B97F4A7C15)


class Numbers(dict):
    """Numbers things in the order in which they first come."""

    def __missing__(self, thing: bytes) -> int:
        n = self[thing] = len(self)
        return n


class Known(dict):
    """Numbers of known things, 0 for others."""

    def __missing__(self, thing: bytes) -> int:
        return 0


def numbered(words: list[bytes], numbers: dict[bytes, int]) -> np.ndarray:
    return np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))


def word_hashes(words: Iterable[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64)


_IN_WORD = np.ones(256, bool)
_IN_WORD[[9, 10, 11, 12, 13, 32]] = False
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_BLOCK = 1 << 13  # words hashed at a time
_TOGETHER = 1 << 20  # text bytes looked at together


def _of_spans(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    def chunk(at: np.ndarray, left: np.ndarray) -> np.ndarray:
        return data[at[:, None] + np.arange(8)].view("<u8").ravel() & _MASK[np.minimum(left, 8)]

    out = mix(chunk(start, size) + size.astype(np.uint64) * _BY)
    at, more = 8, np.flatnonzero(size > 8)
    while len(more):
        out[more] = mix(out[more] * _BY + chunk(start[more] + at, size[more] - at))
        at += 8
        more = more[size[more] > at]
    return out


def span_hashes(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hashes of the `size` bytes from each start on, eight at a time; 8 more bytes follow the last."""
    out = np.empty(len(start), np.uint64)
    for k in range(0, len(start), _BLOCK):
        out[k : k + _BLOCK] = _of_spans(data, start[k : k + _BLOCK], size[k : k + _BLOCK])
    return out


def equal_spans(x: np.ndarray, a: np.ndarray, y: np.ndarray, b: np.ndarray, size: np.ndarray) -> bool:
    """Whether all spans of x from a on equal those of y from b on, byte by byte."""
    for k in range(0, len(a), _BLOCK):
        n = size[k : k + _BLOCK]
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        if not np.array_equal(x[np.repeat(a[k : k + _BLOCK], n) + step], y[np.repeat(b[k : k + _BLOCK], n) + step]):
            return False
    return True


def hashed_words(texts: list[bytes]) -> list[np.ndarray]:
    """64-bit hashes of the words of each text: of each word's own bytes, eight at a time."""
    out: list[np.ndarray] = []
    while len(out) < len(texts):
        some, held = [texts[len(out)]], len(texts[len(out)])
        for t in texts[len(out) + 1 :]:
            if held + len(t) > _TOGETHER:
                break
            some.append(t)
            held += len(t)
        data = np.frombuffer(b"\n".join(some) + b"\n" * 9, np.uint8)
        inside = _IN_WORD[data]
        edge = np.flatnonzero(np.diff(inside, prepend=False))  # starts and ends in turn
        start, size = edge[::2], edge[1::2] - edge[::2]
        hashes = span_hashes(data, start, size)
        first = np.searchsorted(start, np.cumsum([0, *(len(t) + 1 for t in some)]))
        out += [hashes[a:b] for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
    return out
