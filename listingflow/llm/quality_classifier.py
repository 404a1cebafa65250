"""Quality classifier: a byte-level convolutional network in numpy."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from .common import in_chunks, remembered, spread

WIDTH, DIM, FILTERS, SEGMENT = 6, 8, 16, 64
_BLOCK = 1024  # segments convolved at a time


def segments(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of SEGMENT bytes, with the WIDTH - 1 that follow, and the first row of each text (one more than texts).

    Zero bytes follow a text's end; every text has a row, the empty one too.
    """
    rows = [max(1, -(-len(t) // SEGMENT)) for t in texts]
    first = np.cumsum([0, *rows])
    joined = b"".join(t.ljust(n * SEGMENT + WIDTH - 1, b"\0") for t, n in zip(texts, rows))
    start = np.arange(first[-1]) * SEGMENT + np.repeat(np.arange(len(texts)) * (WIDTH - 1), rows)
    return np.frombuffer(joined, np.uint8)[start[:, None] + np.arange(SEGMENT + WIDTH - 1)], first


def chunked(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping chunks of two neighbouring segments (a text's only segment is a chunk): both rows, and each text's first chunk."""
    count = np.maximum(np.diff(first) - 1, 1)
    begin = np.cumsum([0, *count])
    a = np.arange(begin[-1]) + np.repeat(first[:-1] - begin[:-1], count)
    return a, np.where(np.repeat(np.diff(first) == 1, count), a, a + 1), begin


@dataclass
class Network:
    """Filters over byte embeddings, pooled by maximum in each chunk, then by mean and maximum over chunks."""

    embedding: np.ndarray  # 256 x DIM
    kernel: np.ndarray  # WIDTH x DIM x FILTERS
    bias: np.ndarray
    head: np.ndarray  # mean and maximum of each filter
    prior: float

    def tables(self) -> np.ndarray:
        """What each byte adds to each filter at each place of the window: WIDTH x 256 x FILTERS."""
        return np.einsum("bd,tdf->tbf", self.embedding, self.kernel).astype(np.float32)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """The probability that each whole text is good."""
        if not texts:
            return np.zeros(0)
        rows, first = segments(texts)
        t = self.tables()
        pairs = [(t[k][:, None] + t[k + 1][None]).reshape(1 << 16, FILTERS) for k in range(0, WIDTH, 2)]
        pooled = np.empty((len(rows), FILTERS), np.float32)
        for at in range(0, len(rows), _BLOCK):
            x = rows[at : at + _BLOCK].astype(np.uint16)
            code = x[:, :-1] << 8 | x[:, 1:]
            total = pairs[0][code[:, :SEGMENT]]
            total += pairs[1][code[:, 2 : SEGMENT + 2]]
            total += pairs[2][code[:, 4 : SEGMENT + 4]]
            total.max(axis=1, out=pooled[at : at + _BLOCK])
        a, b, begin = chunked(first)
        chunk = np.maximum(np.maximum(pooled[a], pooled[b]) + self.bias.astype(np.float32), 0).astype(np.float64)
        mean = np.add.reduceat(chunk, begin[:-1]) / np.diff(begin)[:, None]
        top = np.maximum.reduceat(chunk, begin[:-1])
        return 1 / (1 + np.exp(-np.clip(np.hstack([mean, top]) @ self.head + self.prior, -30, 30)))


def train(texts: list[bytes], good: np.ndarray, epochs: int = 14, batch: int = 64, rate: float = 0.02, seed: int = 1) -> Network:
    """A network fitted by Adam; gradients pass through the place of each maximum only."""
    rng = np.random.default_rng(seed)
    share = float(np.clip(good.mean() if len(good) else 0.5, 1e-3, 1 - 1e-3))
    net = Network(rng.normal(0, 0.5, (256, DIM)), rng.normal(0, 0.15, (WIDTH, DIM, FILTERS)), np.zeros(FILTERS), rng.normal(0, 0.1, 2 * FILTERS), float(np.log(share / (1 - share))))
    if len(good) == 0 or good.min() == good.max():
        net.head[:] = 0
        return net
    order = rng.permutation(len(texts))
    batches = []
    for at in range(0, len(order), batch):
        some = order[at : at + batch]
        rows, first = segments([texts[i] for i in some])
        batches.append((rows, *chunked(first), good[some].astype(float)))
    values = [net.embedding, net.kernel, net.bias, net.head, np.array([net.prior])]
    moments = [(np.zeros_like(v), np.zeros_like(v)) for v in values]
    step, steps = 0, epochs * len(batches)
    filters = np.arange(FILTERS)
    for _ in range(epochs):
        for k in rng.permutation(len(batches)):
            rows, a, b, begin, y = batches[k]
            tables = np.einsum("bd,tdf->tbf", values[0], values[1]).astype(np.float32)
            pooled, place = np.empty((len(rows), FILTERS), np.float32), np.empty((len(rows), FILTERS), np.int64)
            for at in range(0, len(rows), _BLOCK):
                x = rows[at : at + _BLOCK]
                total = tables[0][x[:, :SEGMENT]]
                for t in range(1, WIDTH):
                    total += tables[t][x[:, t : t + SEGMENT]]
                place[at : at + _BLOCK] = total.argmax(axis=1)
                pooled[at : at + _BLOCK] = np.take_along_axis(total, place[at : at + _BLOCK, None, :], 1)[:, 0]
            left = pooled[a] >= pooled[b]
            chunk = np.maximum(np.where(left, pooled[a], pooled[b]) + values[2], 0)
            n = np.diff(begin)[:, None]
            mean, top = np.add.reduceat(chunk, begin[:-1]) / n, np.maximum.reduceat(chunk, begin[:-1])
            p = 1 / (1 + np.exp(-np.clip(np.hstack([mean, top]) @ values[3] + values[4], -30, 30)))
            err = (p - y) / len(y)
            d_head = np.hstack([mean, top]).T @ err + 1e-5 * values[3]
            text = np.repeat(np.arange(len(y)), n[:, 0])
            d_mean, d_top = err[:, None] * values[3][:FILTERS] / n, err[:, None] * values[3][FILTERS:]
            d_chunk = (d_mean[text] + d_top[text] * (chunk == top[text]) / 1.0) * (chunk > 0)
            row = np.where(left, a[:, None], b[:, None])
            spot = place[row, filters]
            gain = np.zeros((WIDTH, 256 * FILTERS))
            for t in range(WIDTH):
                gain[t] = np.bincount((rows[row, spot + t].astype(np.int64) * FILTERS + filters).ravel(), d_chunk.ravel(), 256 * FILTERS)
            gain = gain.reshape(WIDTH, 256, FILTERS)
            grads = [np.einsum("tbf,tdf->bd", gain, values[1]), np.einsum("tbf,bd->tdf", gain, values[0]), d_chunk.sum(axis=0), d_head, np.array([err.sum()])]
            step += 1
            for v, g, (m, s) in zip(values, grads, moments):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                v -= rate * (1 - 0.95 * step / steps) * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return Network(*values[:4], float(values[4][0]))


def training_rows(docs: DataFrame, labels: DataFrame, use: Column, most: int) -> tuple[list[bytes], np.ndarray]:
    """At most `most` labelled rows with their whole texts, the first by a hash of their id."""
    chosen = docs.where(use).select("doc_id").join(labels.where("quality IS NOT NULL").select("doc_id", F.col("quality").cast("int").alias("quality")), "doc_id")
    ids = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(most)
    picked = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("data")).join(F.broadcast(ids), "doc_id").select("data", "quality")
    rows = sorted((r["quality"], bytes(r["data"])) for r in picked.collect())
    return [data for _, data in rows], np.array([quality for quality, _ in rows], np.int64)


def score_quality(docs: DataFrame, labels: DataFrame, use: Column, most_rows: int = 3000, carry: Sequence[str] = ()) -> DataFrame:
    """(doc_id, score) and the columns named by `carry`: the probability that quality is 1, for each whole text of `docs` (doc_id, text).

    The network learns from whole texts of rows where `use` holds and `labels` (doc_id, quality) has a label, of
    at most `most_rows` of them at any size. Then every text is scored in full, however long: chunks overlap and
    leave out no byte.

    A null or empty text is scored as one segment of zero bytes. Without two kinds of labels every
    score is the share of good labels, or 0.5. Repeated rows and null ids are scored row by row; an
    empty table gives no rows. Other columns are ignored.
    """
    net = train(*training_rows(docs, labels, use, most_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembered("quality_classifier")
        for batch in in_chunks(batches, size=1 << 20):
            scores = net.scores([x or b"" for x in batch.column(1).cast(pa.binary()).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(scores)], names=["doc_id", *carry, "score"])

    rows = docs.select(F.col("doc_id").cast("long"), "text", *(F.col(c).alias(f"carried_{k}") for k, c in enumerate(carry)))
    schema = StructType([rows.schema["doc_id"], *(docs.schema[c] for c in carry)]).add("score", DoubleType())
    return spread(rows).mapInArrow(run, schema)
