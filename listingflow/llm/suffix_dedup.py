"""Removal of byte strings that occur in an earlier document, by a hash-compared suffix sort."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import by_part, by_turn, kept, pack, parts_for, recurring, runs_of, shard_keys, short, signed, sorted_keys, unpack
from .common import sharded
from .hashing import PrefixHashes, byte_values, powers, window_hashes

_LAST = (1 << 63) - 1


class SuffixOrder:
    """Order of suffixes of a buffer, each cut off after `length` bytes, by prefix hashes.

    Two suffixes are compared at the end of their longest common extension, which a binary search over
    hashes finds; the sort is a mergesort within groups, all groups and runs at once. Equality is
    confirmed byte by byte.
    """

    def __init__(self, data: np.ndarray, length: int, up: np.ndarray | None = None):
        self.data, self.length = data, length
        self.hashes = PrefixHashes(byte_values(data), up)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest common extension of the suffixes at a and b."""
        low, high = np.zeros(len(a), np.int64), np.full(len(a), self.length)
        while (low < high).any():
            mid = (low + high + 1) // 2
            same = self.hashes.same(a, self.hashes, b, mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def less(self, a: np.ndarray, b: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        """Whether the suffix at a comes before that at b, or equals it where that counts too."""
        n = self.common(a, b)
        whole = n == self.length
        at = np.where(whole, 0, n)
        return np.where(whole, or_equal, self.data[a + at] < self.data[b + at])

    def sort(self, place: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Item numbers ordered by group, then suffix; and whether each equals the one before it."""
        order = np.argsort(group, kind="stable")
        g = group[order]
        start = np.flatnonzero(np.append(True, g[1:] != g[:-1])) if len(g) else np.zeros(0, np.int64)
        size = np.diff(np.append(start, len(g)))
        base, many = np.repeat(start, size), np.repeat(size, size)
        rank = np.arange(len(g)) - base
        width = 1
        while len(size) and width < size.max():
            run = rank // width
            other = (run ^ 1) * width
            x = np.flatnonzero(other < many)
            low, high = other[x], np.minimum(other[x] + width, many[x])
            mine, right = place[order[x]], (run[x] & 1) == 1
            while len(open_ := np.flatnonzero(low < high)):
                mid = (low[open_] + high[open_]) // 2
                theirs = place[order[base[x[open_]] + mid]]
                before = self.less(theirs, mine[open_], right[open_])
                low[open_] = np.where(before, mid + 1, low[open_])
                high[open_] = np.where(before, high[open_], mid)
            rank = rank.copy()
            rank[x] = np.minimum(run[x] * width, other[x]) + (rank[x] - run[x] * width) + (low - other[x])
            moved = np.empty_like(order)
            moved[base + rank] = order
            order, rank = moved, np.arange(len(g)) - base
            width *= 2
        equal = np.zeros(len(g), bool)
        pairs = np.flatnonzero(rank > 0)
        a, b = place[order[pairs]], place[order[pairs - 1]]
        same = self.common(a, b) == self.length
        pairs, a, b = pairs[same], a[same], b[same]
        for at in range(0, len(pairs), 1 << 16):
            cols = np.arange(self.length)
            x, y = self.data[a[at : at + (1 << 16), None] + cols], self.data[b[at : at + (1 << 16), None] + cols]
            equal[pairs[at : at + (1 << 16)]] = (x == y).all(axis=1)
        return order, equal


def _texts(table: pa.Table) -> tuple[list[int], list[bytes], list[int]]:
    """Ids of all rows (null last), distinct texts, and the number of each row's text."""
    ids = [_LAST if x is None else x for x in table["doc_id"].to_pylist()]
    number: dict[bytes, int] = {}
    own = [number.setdefault(t or b"", len(number)) for t in table["text"].cast(pa.binary()).to_pylist()]
    return ids, list(number), own


def _bytes(texts: list[bytes]) -> Iterator[np.ndarray]:
    return (np.frombuffer(t, np.uint8) for t in texts)


def _contexts(texts: list[bytes], keys: tuple[np.ndarray, np.ndarray], length: int, q: int) -> Iterator[tuple[int, int, int, int, int, int, bytes]]:
    """(text, key, other, first window, windows, before, bytes) of each run whose anchor recurs; of a heavy anchor,
    of each window by itself, with its own hash for a key. The anchor is key ^ other."""
    for runs in runs_of(_bytes(texts), length, q):
        which, heavy = kept(runs, keys)
        columns = (runs.sequence[which], signed(runs.key[which]), runs.first[which], runs.count[which], runs.before[which], heavy)
        for k, key, first, count, before, many in zip(*(c.tolist() for c in columns)):
            if many:
                for at in range(first, first + count):
                    body = texts[k][at : at + length]
                    own = _name(body)
                    yield k, own, own ^ key, at, 1, 0, body
            else:
                yield k, key, 0, first, count, before, texts[k][first : first + count + length - 1]


def _name(body: bytes) -> int:
    """A signed 64-bit name of a stretch; it only has to tell apart the stretches of one anchor."""
    return xxhash.xxh3_64_intdigest(body) - (1 << 63)


def _run_lengths(values: np.ndarray) -> bytes:
    cut = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
    return np.column_stack([np.diff(np.append(cut, len(values))), values[cut]]).astype("<i8").tobytes()


def _cut(text: bytes, gone: np.ndarray) -> tuple[list[list[int]], bytes]:
    """The maximal removed runs, and what remains."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
    return edge.reshape(-1, 2).tolist(), np.frombuffer(text, np.uint8)[~gone].tobytes() if len(edge) else text


def _least_ids(ids: list[int], own: list[int], n: int) -> list[int]:
    least = [_LAST] * n
    for i, k in zip(ids, own):
        least[k] = min(least[k], i)
    return least


def dedup_bytes(docs: DataFrame, length: int = 50, q: int = 20, shard_bytes: int = 12 << 20) -> DataFrame:
    """Remove from each document (doc_id, text) every byte covered by a `length`-byte string that also
    starts in a document with a smaller id: doc_id, n_bytes, n_removed, n_spans, spans (array of start and
    end of maximal removed runs), kept (binary).

    Texts are dealt into shards. Each shard names the anchors of its windows; anchors that recur come
    back, and the shard sends the bytes around them, each distinct stretch once with its smallest and largest id.
    Where an anchor's stretches meet, windows whose hash does not stand alone are suffix-sorted, and equal ones
    learn the smallest id among them. The shards then mark what earlier documents hold. Copies of a text within
    a shard count as one, so a group of copies weighs as much as the shards that hold it; an anchor at very many
    places is not gathered, but its windows are dealt by hashes of their own.

    Null and empty texts have no bytes. A null id comes after all others and equals itself. Rows with
    one id never take bytes from each other. A text longer than a shard makes one by itself, and is hashed in
    overlapping pieces. An empty table gives no rows. Other columns are ignored.
    """
    shards, n = sharded(docs.withColumn("doc_id", F.col("doc_id").cast("long")), shard_bytes)
    parts = parts_for(n)

    def name(table: pa.Table) -> pa.Table:
        _, texts, _ = _texts(table)
        return shard_keys(table["shard"][0].as_py(), [runs.key for runs in runs_of(_bytes(texts), length, q)], parts)

    again = recurring(shards.groupBy("shard").applyInArrow(name, "part int, shard int, block binary"), n)

    def send(table: pa.Table, keys: pa.Table) -> pa.Table:
        ids, texts, own = _texts(table)
        least = _least_ids(ids, own, len(texts))
        found: dict[tuple[int, bytes], list[int]] = {}
        for k, key, other, _, _, before, body in _contexts(texts, sorted_keys(keys), length, q):
            if (old := found.get((key, body))) is None:
                found[key, body] = [least[k], least[k], before, other]
            elif least[k] < old[0]:
                old[0] = least[k]
            elif least[k] > old[1]:
                old[1] = least[k]
        keys_, bodies = np.array([k for k, _ in found], np.int64), [b for _, b in found]
        low, high, before, other = np.array(list(found.values()), np.int64).reshape(-1, 4).T
        sizes = np.array([len(b) for b in bodies], np.int64)
        order, shares = by_part(short(keys_.view(np.uint64)), parts)
        blocks = []
        for _, share in shares:
            x = order[share]
            blocks.append(pack([keys_[x], low[x], high[x], before[x], other[x], sizes[x]], [bodies[i] for i in x.tolist()]))
        shard = table["shard"][0].as_py() if table.num_rows else 0
        return pa.table({"part": pa.array([p for p, _ in shares], pa.int32()), "shard": pa.array([shard] * len(blocks), pa.int32()), "block": pa.array(blocks, pa.binary())})

    sent = shards.groupBy("shard").cogroup(again.groupBy("shard")).applyInArrow(send, "part int, shard int, block binary")

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up = powers(1 << 16)
        for _, held in by_turn(batches):
            number: dict[tuple[int, bytes], int] = {}
            rows, least, before, others = [], [], [], []
            for shard, block in held:
                (*columns, sizes), joined = unpack(block, 6)
                end = np.cumsum(sizes)
                for key, own, last, at, other, a, b in zip(*(c.tolist() for c in columns), (end - sizes).tolist(), end.tolist()):
                    k = number.setdefault((key, joined[a:b]), len(number))
                    if k == len(least):
                        least.append(own)
                        before.append(at)
                        others.append(other)
                    elif own < least[k]:
                        least[k] = own
                    rows.append((shard, k, last))
            contexts, first_of = list(number), np.array(least, np.int64)
            keys = np.array([k for k, _ in contexts], np.int64)
            windows = np.array([len(b) for _, b in contexts]) - length + 1
            _, back, counts = np.unique(keys, return_inverse=True, return_counts=True)
            shared = np.flatnonzero(counts[back] > 1)
            runs: dict[int, np.ndarray] = {}  # of stretches whose windows do not all have one smallest id
            if len(shared):
                data = np.frombuffer(b"".join([contexts[k][1] for k in shared.tolist()]), np.uint8)
                begin, many = np.cumsum([0, *(windows[shared] + length - 1)])[:-1], windows[shared]
                cut = np.cumsum([0, *many])
                own = np.repeat(np.arange(len(shared)), many)
                offset = np.arange(cut[-1]) - cut[own]
                group = back[shared][own] * (2 * length) + np.array(before)[shared][own] - offset + length  # equal windows have their anchor at the same distance
                place, smallest = begin[own] + offset, first_of[shared][own]
                hashes = window_hashes(data, length)[place]
                order = np.lexsort((hashes, group))
                near = (group[order][1:] == group[order][:-1]) & (hashes[order][1:] == hashes[order][:-1])
                some = order[np.append(near, False) | np.append(False, near)]
                if len(some):
                    up = up if len(up) > len(data) else powers(len(data) + 1)
                    order, equal = SuffixOrder(data, length, up).sort(place[some], group[some])
                    start = np.flatnonzero(~equal)
                    item = some[order]
                    smallest[item] = np.repeat(np.minimum.reduceat(smallest[item], start), np.diff(np.append(start, len(item))))
                    for x in np.unique(own[some]).tolist():
                        runs[int(shared[x])] = smallest[cut[x] : cut[x + 1]]
            lowest = {k: int(r.min()) for k, r in runs.items()}
            rows = sorted((shard, k) for shard, k, last in rows if lowest.get(k, least[k]) < last)  # in other shards no text loses a byte of it
            out: list[tuple[int, bytes]] = []
            for shard, turn in groupby(rows, lambda r: r[0]):
                mine = [k for _, k in turn]
                answers = [_run_lengths(runs[k]) if k in runs else struct.pack("<qq", windows[k], least[k]) for k in mine]
                columns = [keys[mine], np.array([others[k] for k in mine], np.int64), np.array([_name(contexts[k][1]) for k in mine], np.int64), np.array([len(x) for x in answers], np.int64)]
                out.append((shard, pack(columns, answers)))
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in out], pa.int32()), pa.array([b for _, b in out], pa.binary())], names=["shard", "block"])

    answers = sent.repartition(n, "part").sortWithinPartitions("part").mapInArrow(resolve, "shard int, block binary")

    def mark(table: pa.Table, found: pa.Table) -> pa.Table:
        ids, texts, own = _texts(table)
        least = _least_ids(ids, own, len(texts))
        known: dict[tuple[int, int], bytes] = {}
        asked, heavy = [np.zeros(0, np.int64)], [np.zeros(0, bool)]
        for block in found["block"].to_pylist():
            (keys, others, names, sizes), joined = unpack(block, 4)
            asked.append(keys ^ others)
            heavy.append(others != 0)
            end = np.cumsum(sizes)
            for key, title, a, b in zip(keys.tolist(), names.tolist(), (end - sizes).tolist(), end.tolist()):
                known[key, title] = joined[a:b]
        anchors, at = np.unique(short(np.concatenate(asked).view(np.uint64)), return_index=True)
        gone = [np.zeros(len(t) + 1, np.int32) for t in texts]
        for k, key, other, first, _, _, body in _contexts(texts, (anchors, np.concatenate(heavy)[at]), length, q):
            answer = known.get((key, key if other else _name(body)))
            at = first
            for number, smallest in struct.iter_unpack("<qq", answer) if answer else ():
                if smallest < least[k]:
                    gone[k][at] += 1
                    gone[k][at + number + length - 1] -= 1
                at += number
        results = [_cut(t, np.cumsum(g[:-1]) > 0) for t, g in zip(texts, gone)]
        rows = [results[k] if i == least[k] or len(texts[k]) < length else ([[0, len(texts[k])]], b"") for i, k in zip(ids, own)]
        return pa.table(
            {
                "doc_id": table["doc_id"],
                "n_bytes": pa.array([len(texts[k]) for k in own], pa.int64()),
                "n_removed": pa.array([sum(b - a for a, b in spans) for spans, _ in rows], pa.int64()),
                "n_spans": pa.array([len(spans) for spans, _ in rows], pa.int64()),
                "spans": pa.array([spans for spans, _ in rows], pa.list_(pa.list_(pa.int64()))),
                "kept": pa.array([kept_ for _, kept_ in rows], pa.binary()),
            }
        )

    marked = shards.groupBy("shard").cogroup(answers.groupBy("shard"))
    return marked.applyInArrow(mark, "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<array<long>>, kept binary")
