"""Assignment of documents to shards by jump consistent hashing."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.components import checkpointed
from ..operators.digest import ranked_within

_STEP, _ONE = np.uint64(2862933555777941757), np.uint64(1)


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key: the last jump of its random walk that stays below `shards`.

    No table is kept, and from n to n + 1 shards a key either stays or goes to shard n.
    """
    key = keys.astype(np.uint64)
    at, ahead = np.full(len(key), -1, np.int64), np.zeros(len(key), np.int64)
    while len(going := np.flatnonzero(ahead < shards)):
        at[going] = ahead[going]
        key[going] = key[going] * _STEP + _ONE
        ahead[going] = ((at[going] + 1) * (float(1 << 31) / ((key[going] >> np.uint64(33)) + _ONE).astype(np.float64))).astype(np.int64)
    return at.astype(np.int32)


def jump_shard(key: Column, shards: int) -> Column:
    """Column form of jump() for a long key."""

    def of(keys: pd.Series) -> pd.Series:
        return pd.Series(jump(keys.to_numpy().view(np.uint64), shards))

    return F.pandas_udf(of, T.IntegerType())(key)


def shard_key(doc_id: Column) -> Column:
    """60 bits of the md5 of the id's text, which any engine can give; a null id's are those of the empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def assign_shards(docs: DataFrame, shards: int = 40) -> DataFrame:
    """Shard, slot and size of each document (doc_id, text): doc_id, size, text_crc32, shard, slot, grown_shard.

    The shard comes from the id and the number of shards alone; grown_shard is that with one more.
    Slots number a shard's rows without a gap in order of doc_id (null first), text_crc32 and size: rows are dealt by ranges
    of shard and that order, the ranges are counted, and rows are numbered within them, so no shard is ever sorted as a
    whole, and slots are the same however the table is split.

    A null text has 16 bytes of overhead alone and the crc32 of the empty text. Null ids share one
    key; rows that repeat get slots of their own. An empty table gives no rows. Other columns are
    ignored.
    """
    body = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(body).cast("long") + 16).alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        shard_key(F.col("doc_id")).alias("key"),
    )
    rows = rows.select("doc_id", "size", "text_crc32", jump_shard(F.col("key"), shards).alias("shard"), jump_shard(F.col("key"), shards + 1).alias("grown_shard"))
    numbered = ranked_within(checkpointed(rows), "shard", "doc_id", "text_crc32", "size", kind="long")
    return numbered.select("doc_id", "size", "text_crc32", "shard", (F.col("rank") - 1).alias("slot"), "grown_shard")
