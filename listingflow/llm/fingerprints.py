"""I-Match fingerprints of documents over randomised subsets of a mid-frequency lexicon."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_chunks, spread, texts_of, written
from .hashing import mix
from .wording import hashed_words

#: Subsets of the lexicon: SETS for each of these shares of its terms.
SHARES, SETS = tuple(2.0**-k for k in range(2, 10)), 4
_SEEDS = np.random.default_rng(11).integers(0, 2**63, len(SHARES) * SETS).astype(np.uint64)
_LIMITS = np.repeat(np.array([int(s * 2**32) for s in SHARES], np.uint64), SETS)
#: Terms counted within a task before they are given out.
_HELD = 4 << 20


def terms_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct term hashes of each text in turn, and where each text's begin (one more than texts). A term is a lower-case word."""
    each = [np.unique(h) for h in hashed_words([t.lower().encode() for t in texts])]
    return np.concatenate([np.zeros(0, np.uint64), *each]), np.cumsum([0, *map(len, each)])


def lexicon(docs: DataFrame, low_share: float, high_share: float, least: int) -> DataFrame:
    """(term) hashes of the terms of the chosen band: those in `least` documents at least, and in no smaller share
    of all than `low_share` and no larger one than `high_share`.

    In terms of inverse document frequency log(n / df): from log(1 / high_share) to log(1 / low_share). Each
    term is counted by itself, over all documents; a task counts before it sends.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [np.zeros(0, np.uint64)], 0

        def summed() -> pa.RecordBatch:
            terms, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_pydict({"term": terms.view(np.int64), "n": n})

        for batch in in_chunks(batches):
            held.append(terms_of(texts_of(batch))[0])
            size += len(held[-1])
            if size > _HELD:
                yield summed()
                held, size = [np.zeros(0, np.uint64)], 0
        yield summed()

    counts = spread(docs.select("text")).mapInArrow(counted, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    n = docs.count()
    return counts.where(f"n >= {max(least, low_share * n)} AND n <= {max(high_share * n, least)}").select("term")


def signatures(texts: list[str], inside: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """A 32-bit signature per text and subset, 0 where the text has no term of the subset; `inside` tells which terms
    are in the lexicon.

    A text with no term of the lexicon is signed by all its terms in every subset.
    """
    terms, first = terms_of(texts)
    text = np.repeat(np.arange(len(texts)), np.diff(first))
    within = inside(terms)
    few = np.bincount(text, within, len(texts)) == 0
    used = within | few[text]
    terms, text = terms[used], text[used]
    first = np.searchsorted(text, np.arange(len(texts) + 1))
    out = np.empty((len(texts), len(_SEEDS)), np.uint32)
    for k, (seed, limit) in enumerate(zip(_SEEDS, _LIMITS)):
        h = mix(terms ^ seed)
        h[((h & np.uint64(0xFFFFFFFF)) >= limit) & ~few[text]] = 0
        total = np.concatenate([[np.uint64(0)], np.cumsum(h, dtype=np.uint64)])
        total = total[first[1:]] - total[first[:-1]]
        out[:, k] = np.where((total == 0) & few, np.uint32(1), (mix(total) >> np.uint64(32)).astype(np.uint32))
    return out


def among(terms: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """Tells which of given terms are among these sorted ones."""

    def inside(own: np.ndarray) -> np.ndarray:
        return terms[np.minimum(np.searchsorted(terms, own), len(terms) - 1)] == own if len(terms) else np.zeros(len(own), bool)

    return inside


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal signatures among the subsets in which either text has a term; 1 for equal fingerprints."""
    if (a == b).all():
        return 1.0
    either = (a != 0) | (b != 0)
    return float(((a == b) & either).sum() / max(1, either.sum()))


def _below(keys: np.ndarray, ties: np.ndarray, cut_keys: np.ndarray, cut_ties: np.ndarray) -> np.ndarray:
    """How many of the sorted cuts are less than each (key, tie)."""
    low, high = np.searchsorted(cut_keys, keys, "left"), np.searchsorted(cut_keys, keys, "right")
    while len(open_ := np.flatnonzero(low < high)):
        mid = (low[open_] + high[open_]) // 2
        less = cut_ties[mid] < ties[open_]
        low[open_], high[open_] = np.where(less, mid + 1, low[open_]), np.where(less, high[open_], mid)
    return low


def in_id_order(docs: DataFrame, range_bytes: int = 24 << 20, per_range: int = 32) -> tuple[DataFrame, int]:
    """Documents in ranges of descending id and text hash, each with the document after its last as a guest.

    Columns: range, guest, doc_id, key, tie, text. Ranges are cut at about `per_range` sampled (id, hash) pairs each,
    so that rows of one id, or without one, are cut too; that sample and a row per range are all that is collected.
    The document after the very last is the very first.
    """
    least = F.lit(-(1 << 63))
    body = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    body = body.withColumn("key", F.coalesce("doc_id", least)).withColumn("tie", F.xxhash64("text"))
    total = body.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b"), F.count("*").alias("n")).first()
    n = max(1, -(-total["b"] // range_bytes), docs.sparkSession.sparkContext.defaultParallelism)
    every = max(1, total["n"] // (per_range * n))
    sample = body.where(F.pmod(F.xxhash64("key", "tie"), F.lit(every)) == 0).select("key", "tie").toArrow()
    key, tie = sample["key"].to_numpy(), sample["tie"].to_numpy()
    order = np.lexsort((tie, key))
    order = order[np.unique(np.linspace(0, len(order), n + 1)[1:-1].astype(np.int64))] if len(order) else order
    key, tie = key[order], tie[order]

    def of(keys: pd.Series, ties: pd.Series) -> pd.Series:
        return pd.Series(len(key) - _below(keys.to_numpy(), ties.to_numpy(), key, tie), dtype="int32")

    placed = body.withColumn("range", F.pandas_udf(of, T.IntegerType())("key", "tie"))
    first = placed.groupBy("range").agg(F.max(F.struct("key", "tie")).alias("top"))
    tops = sorted((r["range"], r["top"]["key"], r["top"]["tie"]) for r in first.collect())
    guests = [(key, tie, tops[k - 1][0]) for k, (_, key, tie) in enumerate(tops)]  # the first range's top goes after the last range
    host = F.broadcast(docs.sparkSession.createDataFrame(guests, "key long, tie long, host int"))  # a row per range
    both = placed.join(host, ["key", "tie"], "left").withColumn("place", F.explode(F.array_compact(F.array(F.struct("range", F.lit(False).alias("guest")), F.when(F.col("host").isNotNull(), F.struct(F.col("host").alias("range"), F.lit(True).alias("guest")))))))
    return both.select("place.range", "place.guest", "doc_id", "key", "tie", "text"), len(key) + 1


PAIRS = "doc_id long, n_chars long, edited_text string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _signed(rows: list[tuple]) -> pa.RecordBatch:
    """Rows of PAIRS from documents each followed by its next: (doc_id, text, edited text, their signatures, the next one's)."""
    return pa.RecordBatch.from_pydict(
        {
            "doc_id": pa.array([r[0] for r in rows], pa.int64()),
            "n_chars": pa.array([len(r[1]) for r in rows], pa.int64()),
            "edited_text": pa.array([r[2] for r in rows], pa.string()),
            "fingerprint": pa.array([r[3].astype(">u4").tobytes().hex() for r in rows], pa.string()),
            "edited_fingerprint": pa.array([r[4].astype(">u4").tobytes().hex() for r in rows], pa.string()),
            "near_edited": pa.array([likeness(r[3], r[4]) for r in rows], pa.float64()),
            "near_next": pa.array([likeness(r[3], r[5]) for r in rows], pa.float64()),
        }
    )


def _followed(batches: Iterator[pa.RecordBatch], inside: Callable[[np.ndarray], np.ndarray]) -> Iterator[pa.RecordBatch]:
    """PAIRS of rows (range, guest, doc_id, text) in order, a slice at a time."""
    last: tuple | None = None
    for batch in in_chunks(batches, size=2 << 20):
        own = texts_of(batch)
        rows = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), own, signatures(own, inside)))
        rows = [last, *rows] if last else rows
        last = rows[-1]
        pairs = [(a, b) for a, b in zip(rows, rows[1:]) if not a[1] and a[0] == b[0]]
        edited = [a[3][: len(a[3]) - len(a[3]) // 2] + b[3][: len(a[3]) // 2] for a, b in pairs]
        if pairs:
            yield _signed([(a[2], a[3], e, a[4], s, b[4]) for (a, b), e, s in zip(pairs, edited, signatures(edited, inside))])


def fingerprint_pairs(docs: DataFrame, low_share: float = 2e-5, high_share: float = 0.2, least: int = 2, most_sent: int = 4 << 20) -> DataFrame:
    """Fingerprints of each document (doc_id, text) and of its edited text, in which the last half of the
    code points gives way to the start of the next document by descending id: doc_id, n_chars, edited_text,
    fingerprint, edited_fingerprint, near_edited, near_next.

    The lexicon has the terms in a band of document frequencies, see lexicon(). As a term takes `low_share` of all
    documents, there are at most (mean distinct terms of a document) / low_share of them at any size. Up to
    `most_sent` are sent to all tasks; more are joined to the terms of each range, with the same result.

    Null text is empty; the empty text is signed as a text without terms. Null ids come after all
    others. Rows that share an id are ordered by a hash of their text; each has the next row as its next
    document, a lone document itself. Very long texts are signed whole. An empty table gives no rows. Other
    columns are ignored.
    """
    terms = written(lexicon(docs, low_share, high_share, least))
    placed, n = in_id_order(docs)
    if terms.count() <= most_sent:
        found = docs.sparkSession.sparkContext.broadcast(np.sort(terms.toArrow()["term"].to_numpy().view(np.uint64)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from _followed(batches, among(found.value))

        # within a range: documents by descending id, then the guest
        ordered = placed.repartition(n, "range").sortWithinPartitions("range", "guest", F.desc("key"), F.desc("tie"))
        return ordered.select("range", "guest", "doc_id", "text").mapInArrow(run, PAIRS)

    return _by_join(placed.select("range", "guest", "doc_id", "text", "key", "tie"), terms)


def _by_join(placed: DataFrame, terms: DataFrame) -> DataFrame:
    """PAIRS of in_id_order()'s rows with a lexicon (term) of any size: each range asks for the terms that it meets."""

    def in_order(table: pa.Table) -> list[pa.RecordBatch]:
        return table.sort_by([("guest", "ascending"), ("key", "descending"), ("tie", "descending")]).combine_chunks().to_batches()

    def ask(table: pa.Table) -> pa.Table:
        asked = [np.zeros(0, np.uint64)]

        def noted(own: np.ndarray) -> np.ndarray:
            asked.append(np.unique(own))
            return np.zeros(len(own), bool)

        for _ in _followed(in_order(table), noted):
            pass
        own = np.unique(np.concatenate(asked)).view(np.int64)
        return pa.table({"range": np.full(len(own), table["range"][0].as_py(), np.int32), "term": own})

    def answered(table: pa.Table, found: pa.Table) -> pa.Table:
        inside = among(np.sort(found["term"].to_numpy().astype(np.int64).view(np.uint64)))
        batches = list(_followed(in_order(table), inside))
        return pa.Table.from_batches(batches) if batches else _signed([]).schema.empty_table()

    found = placed.groupBy("range").applyInArrow(ask, "range int, term long").join(terms, "term").select("range", "term")
    return placed.groupBy("range").cogroup(found.groupBy("range")).applyInArrow(answered, PAIRS)
