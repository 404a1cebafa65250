"""Incremental digests: micro-batches against a durable ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import with_keys
from ..operators.cluster import cluster, strip_ambiguous
from ..operators.components import checkpointed
from ..operators.digest import batch as digest_batch
from ..operators.digest import order_digest
from ..operators.ledger import baseline, keys_to_store, new_only, read_ledger, update_ledger, upsert_seen
from ..operators.rules import RULES, is_internship, tag


def run_batch(batch: DataFrame, batch_id: int, state_dir: str, runs: DataFrame | None = None, rules: dict[str, tuple[str, ...]] = RULES) -> DataFrame:
    """The new clusters of a batch, after rules, clustering and the ledger; their keys are then recorded.

    The first run records everything and gives nothing. Postings of a source that failed in `runs` (source,
    ok) are left for a later batch. Keys to record are written with the output; a batch that comes again, whatever
    it was stopped after, records them once more, which changes nothing that is there, and gives what it gave before.
    """
    spark = batch.sparkSession
    out = f"{state_dir}/batches/batch={batch_id}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{out}/_SUCCESS")
    if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return _recorded(spark, state_dir, out)
    seen, first = read_ledger(spark, f"{state_dir}/seen")
    if runs is not None:
        batch = batch.join(runs.where("NOT ok").select("source"), "source", "left_anti")
    kept = tag(batch, rules).where(is_internship(F.col("title"), F.col("source")))
    clusters = checkpointed(strip_ambiguous(cluster(with_keys(kept))[0]))
    new = checkpointed(new_only(clusters, seen))
    keys = baseline(clusters) if first else keys_to_store(new).select("key").distinct()
    keys.withColumn("first_seen", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")).write.mode("overwrite").parquet(f"{out}.keys")
    (new.limit(0) if first else new).write.mode("overwrite").parquet(out)  # its success mark comes last
    return _recorded(spark, state_dir, out)


def _recorded(spark: SparkSession, state_dir: str, out: str) -> DataFrame:
    """The batch's output, after its keys are in the ledger."""
    seen, _ = read_ledger(spark, f"{state_dir}/seen")
    keys = spark.read.parquet(f"{out}.keys")
    if not keys.join(seen, "key", "left_anti").isEmpty() or seen.isEmpty():
        update_ledger(spark, f"{state_dir}/seen", lambda held: upsert_seen(held, keys, F.col("first_seen")))
    return spark.read.parquet(out)


def catch_up(clusters: DataFrame, n: int = 150) -> DataFrame:
    """Every open cluster with its place and batch_no, by directness, company and title; no ledger is read or written."""
    rows = clusters.select("cluster_id", "rep.*").withColumn("digest_id", F.lit("all"))
    ranked = order_digest(rows.withColumn("relevance", F.lit("keep")))
    return digest_batch(ranked, n).select("cluster_id", "posting_id", "rank", "batch_no")


def dry_run(clusters: DataFrame) -> DataFrame:
    """What a run would send, by source and company."""
    return clusters.select("cluster_id", "rep.source", "rep.company", "rep.title", "rep.apply_url", "rep.indirect").orderBy("source", F.lower("company"), "cluster_id")


def start(stream: DataFrame, state_dir: str):
    """Runs each micro-batch of a stream of postings through run_batch(); returns the writer to start."""
    return stream.writeStream.option("checkpointLocation", f"{state_dir}/checkpoint").foreachBatch(lambda df, n: run_batch(df, n, state_dir) and None)


def commit_delivered(seen: DataFrame, parts: DataFrame, status: DataFrame, stamp) -> DataFrame:
    """The ledger after a delivery: keys of parts (digest_id, part_no, key) before the digest's first failed
    part in `status` (digest_id, part_no, ok)."""
    failed = status.where("NOT ok").groupBy("digest_id").agg(F.min("part_no").alias("stop"))
    sent = parts.join(status.where("ok").select("digest_id", "part_no"), ["digest_id", "part_no"]).join(failed, "digest_id", "left")
    return upsert_seen(seen, sent.where("stop IS NULL OR part_no < stop").select("key").distinct(), stamp)


def dedup_within(stream: DataFrame, key: str, ts: str = "ts", ttl: str = "180 days") -> DataFrame:
    """The first row of each key within `ttl` of event time; state older than that goes."""
    return stream.withWatermark(ts, ttl).dropDuplicatesWithinWatermark([key])
