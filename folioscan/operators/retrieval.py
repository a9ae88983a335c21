"""Vector and full-text search inside a scope, their fusion by reciprocal ranks, and the gate on its confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from folioscan.functions.english import simple_terms
from folioscan.functions.vectors import cosine_similarity

CANDIDATES, RRF, RESULTS, MOST_RESULTS, GATE = 20, 60, 6, 20, 0.25


def result_limit(k: int | None) -> int:
    """6 where none is asked for, 20 at most."""
    return RESULTS if not k or k <= 0 else min(k, MOST_RESULTS)


def vector_search(rows: DataFrame, query: list[float], key: str, vector: str = "embedding", scope: Column | None = None, k: int = CANDIDATES, digits: int | None = None) -> DataFrame:
    """(key, similarity, rank) of the k nearest rows by cosine distance, exactly; ties to the smaller key.

    Rows without an embedding are passed over. The scope reaches the scan, and only k rows leave each task."""
    found = rows.where(scope) if scope is not None else rows
    sim = cosine_similarity(F.col(vector), F.lit([float(x) for x in query]))
    sim = F.round(sim, digits) if digits is not None else sim
    top = found.where(F.col(vector).isNotNull()).select(key, sim.alias("similarity")).where("similarity IS NOT NULL").orderBy(F.col("similarity").desc(), key).limit(k)
    return ranked(top, [F.col("similarity").desc(), F.col(key)])


def ranked(top: DataFrame, order: list[Column]) -> DataFrame:
    """With a rank from 1; for a list that has been cut to its first rows."""
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def text_search(rows: DataFrame, terms: list[str], key: str, text: str, scope: Column | None = None, k: int = CANDIDATES, analyse=simple_terms) -> DataFrame:
    """(key, score, rank) of rows that hold every term; none without terms.

    The score is the terms' count over one plus the logarithm of the text's length in terms."""
    found = rows.where(scope) if scope is not None else rows
    wanted = F.array(*map(F.lit, sorted(set(terms)))) if terms else F.array().cast("array<string>")
    found = found.select(key, analyse(F.col(text)).alias("_t")).where(F.size(wanted) > 0).where(F.size(F.array_except(wanted, "_t")) == 0)
    hits = F.size(F.filter("_t", lambda t: F.array_contains(wanted, t)))
    score = F.round(hits / (1 + F.log(F.size("_t").cast("double"))), 6)
    top = found.select(key, score.alias("score")).orderBy(F.col("score").desc(), key).limit(k)
    return ranked(top, [F.col("score").desc(), F.col(key)])


def fuse(vector_hits: DataFrame, text_hits: DataFrame, key: str, k: int | None = None) -> DataFrame:
    """(key, score, similarity): sums of 1 / (60 + rank) over both lists; a row's similarity is the vector list's."""
    both = vector_hits.select(key, "rank", "similarity").unionByName(text_hits.select(key, "rank", F.lit(None).cast("double").alias("similarity")))
    out = both.groupBy(key).agg(F.round(F.sum(F.lit(1.0) / (RRF + F.col("rank"))), 12).alias("score"), F.max("similarity").alias("similarity"))
    return out.orderBy(F.col("score").desc(), key).limit(result_limit(k))


def signals(vector_hits: DataFrame, text_hits: DataFrame) -> DataFrame:
    """One row: the best similarity (null without vector hits) and the number of text hits, counted after their limit."""
    return vector_hits.agg(F.max("similarity").alias("top_similarity")).crossJoin(text_hits.agg(F.count(F.lit(1)).alias("lexical_hits")))  # one row each


def refuses(n_fused: Column, threshold: Column, top_similarity: Column, lexical_hits: Column) -> Column:
    """Whether a question isn't answered: nothing was found, or the best similarity is below a positive threshold and no text matched."""
    weak = (threshold > 0) & top_similarity.isNotNull() & (top_similarity < threshold) & (lexical_hits == 0)
    return (n_fused == 0) | F.coalesce(weak, F.lit(False))
