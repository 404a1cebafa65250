"""Helpers that several training-data operators share."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import checkpoint_folder, checkpointed  # noqa: F401

#: A word is a run of anything but space, tab, line feed, vertical tab, form feed and return.
WORD = re.compile(r"[^\x20\x09-\x0D]+")

#: What str.split() takes for white space but WORD does not.
_OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0  -     　]")

#: Text bytes that a task handles at a time.
CHUNK_BYTES = 4 << 20


def words_of(text: str) -> list[str]:
    """The words of a text in order."""
    return WORD.findall(text) if _OTHER_SPACE.search(text) else text.split()


#: What this worker remembers between tasks, by operator.
_REMEMBERED: dict[str, dict] = {}


def remembered(operator: str) -> dict:
    """What the operator remembers in this worker. Workers outlive stages, so what other operators left here goes."""
    for other in [o for o in _REMEMBERED if o != operator]:
        del _REMEMBERED[other]
    return _REMEMBERED.setdefault(operator, {})


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df as it is, or dealt evenly over the cores if the scan has fewer splits than cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def in_chunks(batches: Iterator[pa.RecordBatch], *columns: str, size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about `size` bytes of these columns ("text" if none is named), so that memory stays bounded."""
    for batch in batches:
        lengths = np.full(batch.num_rows, 64, np.int64)
        for column in columns or ("text",):
            own = batch.column(batch.schema.get_field_index(column))
            lengths += pc.fill_null(pc.binary_length(own), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = np.cumsum(lengths) // size
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch, null as the empty text."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the session's checkpoint folder, which takes less room there than checkpoint()."""
    path = f"{checkpoint_folder(df.sparkSession)}/table-{uuid.uuid4()}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def bucket_of(c: Column) -> Column:
    """crc32 of an id written as text; for splits into training and held-out rows. Null ids get bucket 0."""
    return F.coalesce(F.crc32(c.cast("string").cast("binary")), F.lit(0))


def text_bytes(docs: DataFrame) -> int:
    """UTF-8 bytes of all texts."""
    return docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()["b"]


def sharded(docs: DataFrame, shard_bytes: int = 12 << 20, carry: Sequence[str] = ()) -> tuple[DataFrame, int]:
    """(doc_id, text, shard) and other columns dealt by shard, and the number of shards, which grows with the text.

    The shard comes from the id and the split that the row was read from, so that neither
    many copies of a text nor many rows of one id meet in one shard.
    """
    n = max(1, -(-text_bytes(docs) // shard_bytes), docs.sparkSession.sparkContext.defaultParallelism)
    shard = F.pmod(F.xxhash64(F.col("doc_id"), F.spark_partition_id()), F.lit(n)).cast("int")
    others = (F.col(c).alias(f"carried_{k}") for k, c in enumerate(carry))
    return docs.select("doc_id", "text", shard.alias("shard"), *others).repartition(n, "shard"), n
