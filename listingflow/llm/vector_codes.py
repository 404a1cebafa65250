"""Product codes of vectors: each part is named by the nearest of its position's codebook entries.

A task packs its rows into flat blocks. For every part position the sub-vectors of a batch are put in the order of a
Hilbert curve and cut into blocks of `BLOCK`, of which the least and greatest components (a box) and the sums are kept.
In each round the distances between boxes and entries say which entries can be the nearest of any member of a block:
those that are no further from the box than some entry is at most. A block with one such entry adds its stored sums and
count; others compare their members with the entries of the shortlist only, in integers.

Rows that aren't kept (null vector, null or non-finite component) aren't returned. Kept rows whose vector hasn't the
length coded (the commonest that parts divide; of equally common ones the greater) have a null code and error. Repeated
rows count each; null ids come last where codebooks are begun; null labels are one group; an empty table gives an empty
one; columns besides id, vector and label are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .vectors import added_up, cell_rows, floored, usable

#: Vectors packed into one row of the table of blocks, and members of a block.
PACKED, BLOCK = 1 << 13, 16

#: Integers that a kernel holds at a time.
WORK = 1 << 21

#: Sums by label are sent to all tasks up to so many labels; more are joined by a shuffle.
LABELS_SENT = 100_000


def hilbert_order(points: np.ndarray) -> np.ndarray:
    """The order of integer points along a Hilbert curve through their box (of wide points, through their first 31 components).

    Each component is scaled to as many bits as let a key fit 62; the bits are turned into those of the curve from the
    highest down, by exchanging or inverting the lower bits of the first component.
    """
    points = points[:, :31]
    n, width = points.shape
    if not n or not width:
        return np.arange(n)
    bits = min(62 // width, 16)
    low, high = points.min(0), points.max(0)
    x = [((points[:, i] - low[i]).astype(np.float64) / max(int(high[i] - low[i]), 1) * ((1 << bits) - 1)).astype(np.int64) for i in range(width)]
    for b in range(bits - 1, 0, -1):
        lower = (1 << b) - 1
        for i in range(width):
            set_ = (x[i] >> b & 1).astype(bool)
            swapped = np.where(set_, 0, (x[0] ^ x[i]) & lower)
            x[0] ^= np.where(set_, lower, swapped)
            x[i] ^= swapped
    for i in range(1, width):
        x[i] ^= x[i - 1]
    turn = np.zeros(n, np.int64)
    for b in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] >> b & 1, (1 << b) - 1, 0)
    key = np.zeros(n, np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(width):
            key = key << 1 | ((x[i] ^ turn) >> b & 1)
    return np.argsort(key, kind="stable")


@dataclass(frozen=True)
class Blocks:
    """Sub-vectors of one position in the order of the curve, with the box and the sums of each block of `BLOCK` (the last may be shorter)."""

    members: np.ndarray
    low: np.ndarray
    high: np.ndarray
    sums: np.ndarray

    @classmethod
    def of(cls, members: np.ndarray) -> Blocks:
        starts = np.arange(0, len(members), BLOCK)
        return cls(members, *(f.reduceat(members, starts, axis=0) for f in (np.minimum, np.maximum, np.add)))

    def shortlists(self, entries: np.ndarray) -> np.ndarray:
        """(block, entry): whether an entry may be the nearest of some member."""
        below, above = self.low[:, None, :] - entries, entries - self.high[:, None, :]
        least = (np.maximum(np.maximum(below, above), 0) ** 2).sum(2)
        most = (np.maximum(np.abs(below), np.abs(above)) ** 2).sum(2)
        return least <= most.min(1, keepdims=True)

    def assign(self, entries: np.ndarray, exact: bool) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
        """Nearest entry of each member, its squared distance (None unless `exact`), and which blocks have one candidate."""
        may = self.shortlists(entries)
        count = may.sum(1)
        alone = count == 1
        best = np.repeat(may.argmax(1), BLOCK)[: len(self.members)]
        for size in np.unique(count[~alone]):
            blocks = np.flatnonzero(count == size)
            lists = np.nonzero(may[blocks])[1].reshape(-1, size)
            step = max(1, WORK // (BLOCK * int(size) * max(entries.shape[1], 1)))
            for a in range(0, len(blocks), step):
                rows = blocks[a : a + step, None] * BLOCK + np.arange(BLOCK)
                own = self.members[np.minimum(rows, len(self.members) - 1)]
                told = entries[lists[a : a + step]]
                distance = ((own[:, :, None, :] - told[:, None, :, :]) ** 2).sum(3)
                found = np.take_along_axis(lists[a : a + step], distance.argmin(2), 1)
                there = rows < len(self.members)
                best[rows[there]] = found[there]
        return best, ((self.members - entries[best]) ** 2).sum(1) if exact else None, alone


def _packed(parts: int, dimension: int, scale: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of (ids, labels, order, members, low, high, sums); arrays of 32 or 64 bits as bytes, by position."""

    def pack(ids: list[pa.Array], labels: list[pa.Array], vectors: list[np.ndarray]) -> pa.RecordBatch:
        rows = np.concatenate(vectors)
        cut = rows.reshape(len(rows), parts, dimension // parts)
        orders = [hilbert_order(cut[:, j]) for j in range(parts)]
        blocks = [Blocks.of(cut[order, j]) for j, order in enumerate(orders)]
        fields = [np.stack(orders).astype(np.int32)] + [np.stack([getattr(b, f) for b in blocks]).astype(t) for f, t in (("members", np.int32), ("low", np.int32), ("high", np.int32), ("sums", np.int64))]
        lists = [pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), pa.concat_arrays(x)) for x in (ids, labels)]
        return pa.RecordBatch.from_arrays([*lists, *(pa.array([x.tobytes()], pa.binary()) for x in fields)], ["ids", "labels", "order", "members", "low", "high", "sums"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, vectors, held = [], [], [], 0
        for batch in batches:
            a = 0
            while a < batch.num_rows:
                part = batch.slice(a, PACKED - held)
                a, held = a + part.num_rows, held + part.num_rows
                ids.append(part.column(0)), labels.append(part.column(1)), vectors.append(floored(part.column(2), dimension, scale))
                if held == PACKED:
                    yield pack(ids, labels, vectors)
                    ids, labels, vectors, held = [], [], [], 0
        if held:
            yield pack(ids, labels, vectors)

    return run


def _unpacked(row: dict, parts: int, dimension: int) -> Iterator[tuple[np.ndarray, Blocks]]:
    """The order and the blocks of each position of a packed row."""
    n, width = len(row["ids"]), dimension // parts

    def array(name: str, kind: type, *shape: int) -> np.ndarray:
        return np.frombuffer(row[name], kind).reshape(parts, *shape)

    order = array("order", np.int32, n)
    fields = [array("members", np.int32, n, width), *(array(f, t, -1, width) for f, t in (("low", np.int32), ("high", np.int32), ("sums", np.int64)))]
    for j in range(parts):
        yield order[j], Blocks(*(f[j].astype(np.int64) for f in fields))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The packed rows, ids and labels as Arrow arrays."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = {name: batch.column(k)[i] for k, name in enumerate(batch.schema.names)}
            yield {name: x.values if name in ("ids", "labels") else x.as_py() for name, x in row.items()}


def _sums(codebooks: np.ndarray, dimension: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(cell, total) of a task: by position and entry the count of its members, then their sum by component."""
    parts, k, width = codebooks.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((parts, k, 1 + width), np.int64)
        for row in _rows(batches):
            for j, (_, blocks) in enumerate(_unpacked(row, parts, dimension)):
                best, _, alone = blocks.assign(codebooks[j], exact=False)
                sums[j, :, 0] += np.bincount(best, minlength=k)
                np.add.at(sums[j, :, 1:], best[::BLOCK][alone], blocks.sums[alone])
                rest = ~np.repeat(alone, BLOCK)[: len(best)]
                for i in range(width):  # a packed row's sums are far below 2**53, so floats hold them exactly
                    sums[j, :, 1 + i] += np.bincount(best[rest], blocks.members[rest, i], k).astype(np.int64)
        yield from cell_rows(sums)

    return run


def _coded(codebooks: np.ndarray, dimension: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            codes, errors = np.zeros((len(row["ids"]), len(codebooks)), np.uint8), np.zeros(len(row["ids"]), np.int64)
            for j, (order, blocks) in enumerate(_unpacked(row, len(codebooks), dimension)):
                codes[order, j], distance, _ = blocks.assign(codebooks[j], exact=True)
                errors[order] += distance
            yield pa.RecordBatch.from_arrays([row["ids"], row["labels"], pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(errors)], ["id", "label", "code", "error"])

    return run


def encode_vectors(table: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, id_column: str = "vec_id", vector: str = "embedding", label: str = "label") -> tuple[DataFrame, np.ndarray]:
    """(id, label, code, error) of each kept vector, and the codebooks (part, entry, component within the part).

    Components are floor(scale * x). Codebooks begin as the parts of the vectors with the least ids; a round assigns
    all parts and puts each entry that has any at the floor of their mean. A code has a byte for each part, so there
    are at most 256 entries; fewer vectors make fewer entries. Each round is one pass over the blocks with a row of sums
    per task, entry and component; the driver holds the codebooks.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has a byte for each part: 1 to 256 entries")
    kept = table.select(F.col(id_column).alias("id"), F.col(label).alias("label"), F.col(vector).alias("vector")).where(usable("vector"))
    types = {c: kept.schema[c].dataType.simpleString() for c in ("id", "label")}
    n = F.size("vector").alias("n")
    lengths = kept.select(n).where((F.col("n") > 0) & (F.col("n") % parts == 0)).groupBy("n").count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    dimension = lengths[0]["n"] if lengths else 0
    others = kept.where(F.size("vector") != dimension).select("id", "label", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("bigint").alias("error"))
    if not dimension:
        return others, np.zeros((parts, 0, 0), np.int64)
    same = kept.where(F.size("vector") == dimension)
    first = same.orderBy(F.asc_nulls_last("id"), "vector").limit(entries).collect()
    codebooks = floored(pa.array([r["vector"] for r in first]), dimension, scale).reshape(len(first), parts, -1).transpose(1, 0, 2).copy()
    shape = f"ids array<{types['id']}>, labels array<{types['label']}>, order binary, members binary, low binary, high binary, sums binary"
    packed = written(same.mapInArrow(_packed(parts, dimension, scale), shape))
    for _ in range(rounds):
        sums = added_up(packed.mapInArrow(_sums(codebooks, dimension), "cell bigint, total bigint"), (*codebooks.shape[:2], 1 + codebooks.shape[2]))
        used = sums[:, :, 0] > 0
        codebooks = codebooks.copy()
        codebooks[used] = (sums[used][:, 1:] // sums[used][:, :1]).astype(np.int64)
    coded = packed.mapInArrow(_coded(codebooks, dimension), f"id {types['id']}, label {types['label']}, code binary, error bigint")
    return coded.unionByName(others), codebooks


def with_label_errors(coded: DataFrame) -> DataFrame:
    """The rows with `label_error`, the sum of errors over rows of the same label (nulls are one label)."""
    rows = written(coded)
    sums = written(rows.groupBy("label").agg(F.sum(F.col("error").cast("decimal(20,0)")).cast("bigint").alias("label_error")).withColumnRenamed("label", "of"))
    told = F.broadcast(sums) if sums.count() <= LABELS_SENT else sums
    return rows.join(told, F.col("label").eqNullSafe(F.col("of")), "left").drop("of")
