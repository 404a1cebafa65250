"""Anchors: content-chosen places by which equal windows of different texts find each other.

A window of `length` values holds length - q + 1 runs of q values; the run of least hash, the first of
equals, is its anchor. Equal windows have the same anchor at the same distance, and neighbouring
windows mostly share theirs, so only a small share of places is ever sent anywhere.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .hashing import mix, window_hashes

_BLOCK_BITS = 21
_LOW = np.uint64((1 << _BLOCK_BITS) - 1)


def least_places(h: np.ndarray, w: int) -> np.ndarray:
    """For each i, the place of the least of h[i : i + w], the first of equals (by all but their low bits)."""
    n = len(h) - w + 1
    out = np.empty(max(n, 0), np.int64)
    step = (1 << _BLOCK_BITS) - w
    for at in range(0, n, step):
        part = h[at : at + step + w - 1]
        m = (part & ~_LOW) | np.arange(len(part), dtype=np.uint64)
        span = 1
        while span * 2 <= w:
            m, span = np.minimum(m[:-span], m[span:]), span * 2
        if span < w:
            m = np.minimum(m[: len(m) - (w - span)], m[w - span :])
        out[at : at + len(m)] = (m & _LOW).astype(np.int64) + at
    return out


@dataclass
class Runs:
    """Neighbouring windows of one sequence that share an anchor."""

    sequence: np.ndarray  # number of the sequence
    key: np.ndarray  # hash of the anchor's q values
    first: np.ndarray  # first window's place in its sequence
    count: np.ndarray  # windows
    before: np.ndarray  # from the first window to the anchor


def runs_of(sequences: Iterable[np.ndarray], length: int, q: int, block: int = 1 << 20) -> Iterator[Runs]:
    """Runs of all windows of the sequences of 64-bit values or bytes, a block at a time. Long sequences are
    cut into overlapping pieces.
    """
    pieces: list[tuple[int, int, np.ndarray]] = []
    held = 0
    for k, values in enumerate(sequences):
        for at in range(0, max(len(values) - length + 1, 0), block):
            piece = values[at : at + block + length - 1]
            pieces.append((k, at, piece))
            held += len(piece)
            if held >= block:
                yield _block_runs(pieces, length, q)
                pieces, held = [], 0
    if pieces:
        yield _block_runs(pieces, length, q)


def _block_runs(pieces: list[tuple[int, int, np.ndarray]], length: int, q: int) -> Runs:
    values = np.concatenate([p for _, _, p in pieces])
    begin = np.cumsum([0, *(len(p) for _, _, p in pieces)])
    h = window_hashes(values, q)
    anchor = least_places(h, length - q + 1)
    windows = np.diff(begin) - length + 1
    place = np.arange(windows.sum()) + np.repeat(begin[:-1] - np.cumsum([0, *windows[:-1]]), windows)
    piece = np.repeat(np.arange(len(pieces)), windows)
    a = anchor[place]
    new = np.ones(len(place), bool)
    new[1:] = (a[1:] != a[:-1]) | (piece[1:] != piece[:-1])
    start = np.flatnonzero(new)
    number, offset = np.array([k for k, _, _ in pieces]), np.array([at for _, at, _ in pieces])
    own = piece[start]
    return Runs(number[own], h[a[start]], place[start] - begin[own] + offset[own], np.diff(np.append(start, len(place))), a[start] - place[start])


#: Bits of an anchor's hash left out when anchors are counted; what recurs is looked at in full later.
_SHORT = 16


def signed(keys: np.ndarray) -> np.ndarray:
    return keys.view(np.int64)


def short(keys: np.ndarray) -> np.ndarray:
    """Shortened hashes of anchors, spread evenly (an anchor's own hash, the least of many, is not)."""
    return mix(keys) >> np.uint64(_SHORT)


def parts_for(shards: int) -> int:
    """Ranges that shortened hashes are cut into; a shard sends each range's anchors as one block."""
    return max(1024, 4 * shards)


def pack(columns: list[np.ndarray], bodies: Iterable[bytes] = ()) -> bytes:
    """Columns of 64-bit numbers, byte plane by byte plane, and then the bodies, compressed."""
    planes = [np.ascontiguousarray(c).view(np.uint8).reshape(-1, 8).T.tobytes() for c in columns]
    return len(columns[0]).to_bytes(4, "little") + zstandard.compress(b"".join([*planes, *bodies]), 1)


def unpack(block: bytes, columns: int) -> tuple[list[np.ndarray], bytes]:
    """The columns, as signed numbers, and the joined bodies of a block."""
    n, data = int.from_bytes(block[:4], "little"), zstandard.decompress(block[4:])
    planes = np.frombuffer(data, np.uint8, 8 * n * columns).reshape(columns, 8, n)
    return [np.ascontiguousarray(c.T).view(np.int64).ravel() for c in planes], data[8 * n * columns :]


def by_part(keys: np.ndarray, parts: int) -> tuple[np.ndarray, list[tuple[int, slice]]]:
    """Order of shortened keys, and each range's number with its share of that order."""
    order = np.argsort(keys, kind="stable")
    part = (keys[order] // np.uint64((1 << 64 - _SHORT) // parts + 1)).astype(np.int64)
    cut = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, np.int64)
    return order, [(int(part[a]), slice(a, b)) for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(part)])]


def shard_keys(shard: int, keys: list[np.ndarray], parts: int) -> pa.Table:
    """(part, shard, block) of a shard's anchors; a block has steps between sorted keys, and how often each was seen."""
    found, counts = np.unique(short(np.concatenate(keys)) if keys else np.zeros(0, np.uint64), return_counts=True)
    _, shares = by_part(found, parts)
    blocks = [pack([np.diff(found[s], prepend=np.uint64(0)), counts[s].astype(np.int64)]) for _, s in shares]
    return pa.table({"part": pa.array([p for p, _ in shares], pa.int32()), "shard": pa.array([shard] * len(blocks), pa.int32()), "block": pa.array(blocks, pa.binary())})


def by_turn(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[int, bytes]]]]:
    """Each range with its shards' blocks, of rows (part, shard, block) that are sorted by part."""
    part, held = None, []
    for batch in batches:
        for p, shard, block in zip(*(batch.column(k).to_pylist() for k in range(3))):
            if p != part and held:
                yield part, held
                held = []
            part = p
            held.append((shard, block))
    if held:
        yield part, held


#: An anchor that stands at more places than this is heavy: its windows go each by their own hash, not by the anchor's.
HEAVY = 8192


def recurring(keys: DataFrame, parts: int) -> DataFrame:
    """(shard, block) of those anchors that several shards hold, or one several times, and whether they are heavy.

    A shard sends a key once, so a key is held at most as often as there are shards.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in by_turn(batches):
            found, shards, counts = [], [], []
            for shard, block in held:
                (steps, n), _ = unpack(block, 2)
                found.append(np.cumsum(steps))
                shards.append(np.full(len(steps), shard, np.int32))
                counts.append(n)
            key, shard, count = np.concatenate(found), np.concatenate(shards), np.concatenate(counts)
            order = np.argsort(key, kind="stable")
            key, shard, count = key[order], shard[order], count[order]
            start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            size = np.diff(np.append(start, len(key)))
            total = np.repeat(np.add.reduceat(count, start), size)
            keep = total > 1
            key, shard, heavy = key[keep], shard[keep], (total[keep] > HEAVY).astype(np.int64)
            order = np.argsort(shard, kind="stable")  # keys stay sorted within a shard
            key, shard, heavy = key[order], shard[order], heavy[order]
            cut = [*np.flatnonzero(np.append(True, shard[1:] != shard[:-1])).tolist(), len(shard)] if len(shard) else [0]
            blocks = [pack([np.diff(key[a:b], prepend=0), heavy[a:b]]) for a, b in zip(cut, cut[1:])]
            for at in range(0, len(blocks), 1000):
                yield pa.RecordBatch.from_arrays([pa.array(shard[cut[:-1][at : at + 1000]], pa.int32()), pa.array(blocks[at : at + 1000], pa.binary())], names=["shard", "block"])

    return keys.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(run, "shard int, block binary")


def kept(runs: Runs, keys: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the runs whose anchor is among the sorted, shortened keys, and whether it is heavy."""
    found, heavy = keys
    if not len(found):
        return np.zeros(0, np.int64), np.zeros(0, bool)
    own = short(runs.key)
    at = np.minimum(np.searchsorted(found, own), len(found) - 1)
    i = np.flatnonzero(found[at] == own)
    return i, heavy[at[i]]


def sorted_keys(blocks: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The sorted keys that recurring() sent back, and whether each is heavy."""
    found, heavy = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for b in blocks["block"].to_pylist():
        (steps, h), _ = unpack(b, 2)
        found.append(np.cumsum(steps))
        heavy.append(h)
    keys = np.concatenate(found).view(np.uint64)
    order = np.argsort(keys, kind="stable")
    return keys[order], np.concatenate(heavy)[order] > 0
