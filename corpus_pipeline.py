"""Documents to tokens: toxic ones go, then exact and near copies; sources are mixed to weights; what is left is encoded."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from folioscan.llm.bpe import default_bpe, encode_batches
from folioscan.llm.common import shared_dir, table
from folioscan.llm.exact_dedup import drop_duplicates
from folioscan.llm.mixing import draw
from folioscan.llm.ngram_join import drop_near
from folioscan.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_duplicates(docs)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shingles of five words, a similarity of 0.8."""
    return drop_near(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return draw(docs)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encode_batches(docs, default_bpe(), "doc_id", "text").select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids")


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("ngram_join", ngram_join), ("mixing", mixing), ("bpe", bpe)]

#: A learned model, a seeded draw and merges by rank: no SQL for these; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
