"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder. Only a session on this machine alone, as in tests, gets one made."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the session's checkpoint folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """df as a table of columns in the session's checkpoint folder: smaller than a checkpoint, and read by column."""
    path = f"{checkpoint_folder(df.sparkSession)}/table-{uuid.uuid4()}"
    df.write.parquet(path)
    let_go(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let_go(spark: SparkSession) -> None:
    """Spark removes shuffles and checkpoints that no table needs any more when the driver collects its garbage, which
    it seldom does by itself; until then they stay on disk."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) of every node of `edges` (a, b); a component is named by its smallest node.

    Large-star and small-star steps alternate until only stars are left: each node points its larger
    neighbours, then its smaller ones, at the least of them. A step is a partial minimum per node and
    a join, so a node with many neighbours is summed up before it is shuffled; lineage is cut each round.
    """
    least = F.least("a", "b").alias("b")
    now = checkpointed(edges.select(F.greatest("a", "b").alias("a"), least).where("a IS NOT NULL AND a <> b").distinct())
    nodes = now.select(F.col("a").alias("node")).union(now.select("b")).distinct()
    for _ in range(most_rounds):
        both = now.union(now.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), least)
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        kept = low.select("a", F.col("m").alias("b"))
        moved = down.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = checkpointed(kept.union(moved).where("a <> b").distinct())
        both = low = large = down = kept = moved = None
        let_go(now.sparkSession)
        if now.join(now.select(F.col("b").alias("a")), "a", "left_semi").isEmpty():
            break  # every edge points at a node that points nowhere: stars
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return nodes.join(now.withColumnRenamed("a", "node"), "node", "left").select("node", F.coalesce("b", "node").alias("component"))
