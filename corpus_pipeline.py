"""Corpus pipeline: classifier, rules, near-duplicates, recurring passages, packing."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listingflow.llm.common import bucket_of, checkpoint_folder
from listingflow.llm.order_minhash import near_duplicates
from listingflow.llm.packing import pack
from listingflow.llm.quality_classifier import score_quality
from listingflow.llm.quality_rules import apply_rules, toxic_terms, with_terms
from listingflow.llm.substring_dedup import dedup_passages

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on labels outside the held-out quarter, scores 0.7 or more."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scores = score_quality(docs, labels, bucket_of(F.col("doc_id")) % 4 != 2, carry=COLUMNS[1:])
    return scores.where("score >= 0.7").select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that meet every rule; toxic terms are learned from the labels of all documents."""
    toxic = toxic_terms(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return apply_rules(docs, with_terms(toxic), carry=COLUMNS[1:]).where("kept").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate class: that of smallest id; of rows with this id, the one that names the class.

    A class whose rows all have null ids keeps one of them; repeated rows are copies.
    """
    key = F.coalesce("doc_id", F.lit(-(2**63))).alias("id")
    first = near_duplicates(docs).where("digest = class_digest AND doc_id <=> class_id").select(key, "digest").distinct()
    rows = docs.select(*COLUMNS, key, F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("digest"))
    return rows.join(first, ["id", "digest"], "left_semi").dropDuplicates(["id", "digest"]).select(*COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that recur; those with no word left go."""
    left = dedup_passages(docs, carry=["lang", "source"]).where("n_words > n_removed")
    return left.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("packing", packing),
]

#: The classifier and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over the documents; each is written as Parquet to the shared folder and read again."""
    base = checkpoint_folder(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = f"{base}/pipeline-{uuid.uuid4()}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
