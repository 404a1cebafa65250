"""Vectors as exact integers, and sums over them that tasks gather and Spark adds up."""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: str) -> Column:
    """Whether a vector is there and has neither null nor non-finite components."""
    wrong = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(vector).isNotNull() & ~F.coalesce(wrong, F.lit(False))


def largest(dimension: int) -> int:
    """Components up to this size in either direction have squared distances that fit 64 bits."""
    return math.isqrt((2**63 - 1) // max(dimension, 1)) // 2


def floored(vectors: pa.Array, dimension: int, scale: int) -> np.ndarray:
    """floor(scale * component) of an Arrow array of lists of `dimension` components each.

    Components beyond `largest(dimension)` have no distance in 64 bits, and raise an error rather than a wrong figure.
    """
    values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), dimension)
    scaled = np.floor(values * scale)
    if scaled.size and np.abs(scaled).max() > largest(dimension):
        raise ValueError(f"a component times {scale} is beyond {largest(dimension)}: squared distances don't fit 64 bits")
    return scaled.astype(np.int64)


def cell_rows(sums: np.ndarray, size: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """(cell, total) of the cells of an integer array that aren't zero, by flat index."""
    flat = sums.reshape(-1)
    cells = np.flatnonzero(flat)
    for a in range(0, len(cells), size):
        own = cells[a : a + size]
        yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int64)), pa.array(flat[own].astype(np.int64))], ["cell", "total"])


def added_up(parts: DataFrame, shape: tuple[int, ...]) -> np.ndarray:
    """The sums of (cell, total) rows as an array of Python integers of this shape, which depends on parameters only."""
    sums = np.zeros(math.prod(shape), dtype=object)
    for row in parts.groupBy("cell").agg(F.sum(F.col("total").cast("decimal(20,0)")).alias("total")).collect():
        sums[row["cell"]] = int(Decimal(row["total"]))
    return sums.reshape(shape)
