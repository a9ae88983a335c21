"""Queries over stored orders and stored keys, and calls in a bounded window, with the SQL that gives the same rows."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType

from folioscan.operators import calls, existence, paging
from folioscan.sources import tables

_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def deep_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page of 20 of each priority's orders, dearest first, with the totals of its listing, from a stored order."""
    rows = _t(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    index = paging.write_ordered(rows, tables.scratch(spark, "order"), [F.col("o_totalprice").desc(), F.col("o_orderkey").asc()], "o_orderpriority")
    totals = index.totals(20)
    asked = totals.select("scope", F.explode(F.sequence(F.lit(0).cast("long"), F.col("total_pages") - 1)).alias("page"))
    found = index.pages(asked, 20).join(totals, F.col("o_orderpriority").eqNullSafe(F.col("scope")))
    return found.select("o_orderkey", "o_orderpriority", "page", "place", "total_elements", "total_pages")


def known_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each document's content is in its source's stored contents, which came in two parts, the second of them twice."""
    docs = _t(spark, sf_dir, "documents").select("doc_id", "source", F.sha2("text", 256).alias("digest"))
    stored = existence.store_keys(docs.where("doc_id % 2 = 0"), tables.scratch(spark, "keys"), "source", "digest")
    for _ in range(2):
        stored.add(docs.where("doc_id % 3 = 0"))
    return stored.exists(docs).select("doc_id", F.col("exists").alias("known"))


def _count_words(text: str) -> int:
    n = len(_WORD.findall(text))
    if n < 3:
        raise ValueError(f"too few words: {n}")
    return n


def bounded_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of a call for each document, at most eight at once in a task; those that it refuses keep its reason."""
    answered = calls.call_each(_t(spark, sf_dir, "documents").select("doc_id", "text"), "text", _count_words, LongType())
    return answered.select("doc_id", F.col("result").alias("n_words"), "error")


QUERIES = {f.__name__: f for f in (deep_pages, known_uploads, bounded_calls)}

ORACLE_SQL = {
    "deep_pages": """
SELECT o_orderkey, o_orderpriority, place // 20 AS page, place, total_elements, ceil(total_elements / 20.0)::BIGINT AS total_pages FROM (
  SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC NULLS LAST, o_orderkey NULLS FIRST) - 1 AS place, count(*) OVER (PARTITION BY o_orderpriority) AS total_elements FROM orders)
""",
    "known_uploads": """
WITH k AS (SELECT DISTINCT source, sha256(text) AS d FROM documents WHERE doc_id % 2 = 0 OR doc_id % 3 = 0)
SELECT doc_id, k.d IS NOT NULL AS known FROM documents t LEFT JOIN k ON t.source = k.source AND sha256(t.text) = k.d
""",
    "bounded_calls": r"""
SELECT doc_id, CASE WHEN n >= 3 THEN n END AS n_words, CASE WHEN n < 3 THEN 'ValueError: too few words: ' || n END AS error
FROM (SELECT doc_id, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS n FROM documents)
""",
}
