"""Terms that are stored when texts are written, and searches that read only those of the question.

A table of postings has (term, key, hits, n_terms), partitioned by a hash of the term, so that a search reads the
partitions of its terms; the texts aren't read again and aren't analysed for each search.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from folioscan.functions.english import simple_terms
from folioscan.functions.text import occurrences
from folioscan.operators.retrieval import CANDIDATES, ranked

TERM_BUCKETS = 64


def with_terms(rows: DataFrame, text: str, analyse: Callable[[Column], Column] = simple_terms, out: str = "content_terms") -> DataFrame:
    """rows with a column that is made from their text when they are written: its terms in order."""
    return rows.withColumn(out, analyse(F.col(text)))


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def write_postings(rows: DataFrame, path: str, key: str, terms: str = "content_terms", buckets: int = TERM_BUCKETS) -> None:
    """The postings of rows (key, terms). A frequent term's rows may be in several files of its partition.

    A text's terms are counted where it is read, and postings are shuffled once. Rows that share a key have postings each."""
    each = rows.select(F.col(key).alias("key"), F.size(terms).alias("n_terms"), F.explode(occurrences(F.col(terms))).alias("_o"))
    posts = each.select(F.col("_o.term").alias("term"), "key", F.size("_o.places").alias("hits"), "n_terms", _bucket(F.col("_o.term"), buckets).alias("bucket"))
    posts.repartition("bucket", F.pmod(F.xxhash64("key"), F.lit(8))).write.partitionBy("bucket").parquet(path)


def search_postings(spark: SparkSession, path: str, terms: list[str], key: str, scope: DataFrame | None = None, k: int = CANDIDATES, buckets: int = TERM_BUCKETS) -> DataFrame:
    """(key, score, rank) of texts that hold every term, among those of `scope` (key) if it is given; none without terms.

    The score is the terms' count over one plus the logarithm of the text's length in terms."""
    wanted = sorted(set(terms))
    posts = spark.read.parquet(path)
    where = [r[0] for r in spark.createDataFrame([(t,) for t in wanted], "t string").select(_bucket(F.col("t"), buckets)).distinct().collect()]  # as many as terms
    posts = posts.where(F.col("bucket").isin(where) & F.col("term").isin(wanted))
    if scope is not None:
        posts = posts.join(scope.select(F.col(key).alias("key")), "key", "left_semi")
    found = posts.groupBy("key").agg(F.size(F.collect_set("term")).alias("_n"), F.sum("hits").alias("_hits"), F.max("n_terms").alias("_terms")).where(F.col("_n") == len(wanted)).where(F.lit(bool(wanted)))
    score = F.round(F.col("_hits") / (1 + F.log(F.col("_terms").cast("double"))), 6)
    top = found.select(F.col("key").alias(key), score.alias("score")).orderBy(F.col("score").desc(), key).limit(k)
    return ranked(top, [F.col("score").desc(), F.col(key)])
