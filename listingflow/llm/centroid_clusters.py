"""Clustering around centroids, where simplex coordinates tell most centroids apart without a look at the vectors.

Each vector's distances to some pivots (the first centroids and vectors like them) are taken once and kept. Pivots span
a simplex; the distances of a vector to all of them make it the apex of a simplex upon that base, which has coordinates:
its place within the pivots' span, and its height above it. Two apexes with squared distance s of their places plus the
squares of their heights g and h are at least s - 2gh and at most s + 2gh apart, squared. Centroids whose lower bound is
beyond another's upper bound are out; what is left is compared by exact integers.

A pivot that hardly rises above the span of those before it tells nothing and is left out, so there are about as many as
the vectors have dimensions of their own, and with all of them heights vanish and bounds meet. Fewer pivots take less room
and serve vectors with structure; vectors that are noise in all dimensions, as in the test tables, need them all.

Rows that aren't kept (null vector, null or non-finite component, another length) have no cluster and aren't returned.
Repeated rows are vectors of their own; null ids come after all others where centroids are chosen; an empty table gives
an empty one; columns besides id and vector are not read.
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

#: A pivot less than this share of the longest edge above the span of those before it is left out: it would tell nothing.
LEAST_HEIGHT = 1e-2

#: Share of the squared distances by which bounds are widened, far above what 64-bit floats lose; more of it for vectors that
#: are many times as far from the base as it is high, as their places are worked out from small differences.
SLACK = 1e-12

#: Components of vectors, each against each centroid, that are compared at a time.
WORK = 1 << 22


@dataclass(frozen=True)
class Base:
    """Pivots and their places as a simplex: vertex i has coordinates `corners[i, :i]`, and zeros from i on."""

    pivots: np.ndarray
    corners: np.ndarray

    @classmethod
    def of(cls, points: np.ndarray, most: int) -> Base:
        """Of the points in turn those that stand above the span of those before them, `most` of them at most."""
        chosen, corners = [0], np.zeros((len(points), len(points)))
        longest = max(float(squared(points, p[None, :]).max()) for p in points) ** 0.5
        for i, p in enumerate(points[1:], 1):
            if len(chosen) == most:
                break
            own = cls(points[chosen], corners[: len(chosen), : len(chosen) - 1])
            place, height = own.apexes(squared(p[None, :], own.pivots))
            if height[0] ** 0.5 > LEAST_HEIGHT * longest:
                corners[len(chosen), : len(chosen) - 1], corners[len(chosen), len(chosen) - 1] = place[0], height[0] ** 0.5
                chosen.append(i)
        return cls(points[chosen], corners[: len(chosen), : len(chosen) - 1])

    def apexes(self, distances: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places within the pivots' span and squared heights above it, from squared distances to the pivots."""
        d = distances.astype(np.float64)
        if len(self.pivots) < 2:
            return np.zeros((len(d), 0)), d[:, 0]
        right = (d[:, :1] + (self.corners[1:] ** 2).sum(1) - d[:, 1:]) / 2
        place = np.linalg.solve(self.corners[1:], right.T).T
        return place, np.maximum(d[:, 0] - (place**2).sum(1), 0)

    def candidates(self, places: np.ndarray, heights: np.ndarray, scale: np.ndarray, centroids: np.ndarray) -> np.ndarray:
        """Which centroids may be the nearest of each vector, by the bounds of their apexes. scale: squared distances to the first pivot."""
        to_pivots = squared(centroids, self.pivots)
        own, up = self.apexes(to_pivots)
        size = scale[:, None] + to_pivots[:, 0].astype(np.float64)
        low = float(np.diagonal(self.corners[1:]).min()) if len(self.corners) > 1 else np.inf
        slack = SLACK * size * (1e4 + np.sqrt(size) / low)
        between = ((places**2).sum(1) + heights)[:, None] + (own**2).sum(1) + up - 2 * (places @ own.T)
        cross = 2 * np.sqrt(heights[:, None] + slack) * np.sqrt(up + slack)
        return between - cross - slack <= (between + cross + slack).min(1, keepdims=True)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of a to the few rows of b."""
    return np.stack([((a - x) ** 2).sum(1) for x in b], axis=1) if len(b) else np.zeros((len(a), 0), np.int64)


def nearest(vectors: np.ndarray, to_pivots: np.ndarray, base: Base, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid (the smaller number of equals) and exact squared distance of each vector, and how many distances it took."""
    places, heights = base.apexes(to_pivots)
    may = base.candidates(places, heights, to_pivots[:, 0].astype(np.float64), centroids)
    row, number = np.nonzero(may)
    exact = np.full(may.shape, np.iinfo(np.int64).max)
    exact[row, number] = ((vectors[row] - centroids[number]) ** 2).sum(1)
    best = exact.argmin(1)
    return best, exact[np.arange(len(best)), best], len(row)


def _parts(batches: Iterator[pa.RecordBatch], k: int, dimension: int) -> Iterator[pa.RecordBatch]:
    """The same rows, so many at a time that comparing all of them with k vectors takes bounded memory."""
    rows = max(1, WORK // (k * dimension))
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)


def _slices(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, pivots: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Ids, vectors and squared distances to the pivots."""
    for part in _parts(batches, *centroids.shape):
        vectors, distances = part.column(1).flatten().to_numpy(), part.column(2).flatten().to_numpy()
        yield part.column(0), vectors.reshape(-1, centroids.shape[1]).astype(np.int64), distances.reshape(-1, pivots)


def _with_distances(pivots: np.ndarray, dimension: int, scale: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches, len(pivots), dimension):
            vectors = floored(part.column(1), dimension, scale)
            lists = (pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), x.shape[1]).cast(pa.list_(t)) for x, t in ((vectors.astype(np.int32), pa.int32()), (squared(vectors, pivots), pa.int64())))
            yield pa.RecordBatch.from_arrays([part.column(0), *lists], ["id", "vector", "to_pivots"])

    return run


def _sums(base: Base, centroids: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(cell, total) of a task: for each centroid the count of its vectors, then their sum by component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, dimension = centroids.shape
        sums = np.zeros((k, 1 + dimension), np.int64)
        for _, vectors, to_pivots in _slices(batches, centroids, len(base.pivots)):
            best, _, _ = nearest(vectors, to_pivots, base, centroids)
            sums[:, 0] += np.bincount(best, minlength=k)
            for j in np.unique(best):
                sums[j, 1:] += vectors[best == j].sum(0)
        yield from cell_rows(sums)

    return run


def _assigned(base: Base, centroids: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, vectors, to_pivots in _slices(batches, centroids, len(base.pivots)):
            best, distance, _ = nearest(vectors, to_pivots, base, centroids)
            yield pa.RecordBatch.from_arrays([ids, pa.array(best.astype(np.int32)), pa.array(distance)], ["id", "cluster", "distance"])

    return run


def cluster_vectors(table: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, dimension: int = 64, scale: int = 1024, pivots: int = 65, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid): each kept vector's nearest of k centroids after so many rounds.

    Components are floor(scale * x). The first centroids are the vectors whose `seed:id` hashes least by sha256; a round
    assigns all vectors and puts each centroid that has any at the floor of their mean. Pivots are chosen
    from twice as many vectors of that order. Each round is one pass over the kept table with a row of sums per task,
    centroid and component; the driver has the centroids and the pivots.
    """
    kept = table.select(F.col(id_column).alias("id"), F.col(vector).alias("vector")).where((F.size("vector") == dimension) & usable("vector"))
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = kept.select(hashed.alias("hash"), "vector").orderBy(F.asc_nulls_last("hash"), "vector").limit(max(k, 2 * pivots)).collect()
    session, id_type = table.sparkSession, kept.schema["id"].dataType.simpleString()
    shape = f"id {id_type}, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid array<bigint>"
    if not first:
        return session.createDataFrame([], shape)
    leading = floored(pa.array([r["vector"] for r in first]), dimension, scale)
    centroids, base = leading[:k], Base.of(leading, pivots)
    points = written(kept.mapInArrow(_with_distances(base.pivots, dimension, scale), f"id {id_type}, vector array<int>, to_pivots array<bigint>"))
    for _ in range(rounds):
        sums = added_up(points.mapInArrow(_sums(base, centroids), "cell bigint, total bigint"), (len(centroids), 1 + dimension))
        full = sums[:, 0] > 0
        centroids = centroids.copy()
        centroids[full] = (sums[full, 1:] // sums[full, :1]).astype(np.int64)
    assigned = written(points.mapInArrow(_assigned(base, centroids), f"id {id_type}, cluster int, distance bigint"))
    inertia = {r["cluster"]: int(r["total"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("total")).collect()}
    known = [(j, inertia.get(j, 0), sum(inertia.values()), [int(x) for x in c]) for j, c in enumerate(centroids)]
    clusters = session.createDataFrame(known, "cluster int, cluster_inertia bigint, inertia bigint, centroid array<bigint>")
    return assigned.join(F.broadcast(clusters), "cluster").select("id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")
