"""Exact deduplication over an extendible-hash index kept in the shared folder.

The index has a directory (2**global_depth slots, each naming a bucket and its local depth) and bucket files. The key of a
text is a 64-bit hash; its first global_depth bits are its slot. Building starts from one bucket; a bucket of more keys
than the capacity is split on its next bit, and the directory doubles when a bucket becomes deeper than it. Keys are
counted before, so that the directory is complete when texts are routed and each text moves once.

The directory sends each text to the task that owns its bucket, a range of keys. There equal keys are chained and their
texts' bytes compared, so texts whose hashes collide are entries of their own in one chain. Entries are written as
bucket files, and every row finds its verdict in them by bucket, key and digest. Copies under a key that holds a large
share of the rows are combined where they are read, before they are routed.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from folioscan.llm.common import lower_ascii, materialise, table

#: Keys that a bucket holds; more where the directory would have more than 2**MAX_DEPTH slots, which bounds what is broadcast.
BUCKET_CAPACITY, MAX_DEPTH = 256, 18
#: A key is hot if it has more rows than a bucket's capacity and than one in so many of all rows; so hot keys are at most so many.
HOT_SHARE = 10_000

_DIRECTORY = T.StructType([T.StructField(n, T.LongType()) for n in ("slot", "bucket", "local_depth")])


def normal(text: Column) -> Column:
    return lower_ascii(F.coalesce(text, F.lit("")))


def grow_directory(counts: np.ndarray, capacity: int) -> tuple[int, list[tuple[int, int]]]:
    """(global depth, [(bucket, local depth) of each slot]) for the number of keys in each of 2**d leaves, by their first d bits.

    Buckets are numbered in the order of their keys. A full bucket that is as deep as a leaf stays whole."""
    leaf_depth = len(counts).bit_length() - 1
    before = np.concatenate([[0], np.cumsum(counts)])
    depth, todo, done = 0, [(0, 0)], []
    while todo:
        prefix, local = todo.pop()
        wide = leaf_depth - local
        if wide == 0 or before[prefix + 1 << wide] - before[prefix << wide] <= capacity:
            done.append((prefix, local))
            continue
        depth = max(depth, local + 1)
        todo += [(2 * prefix + 1, local + 1), (2 * prefix, local + 1)]
    slots: list[tuple[int, int]] = []
    for bucket, (_, local) in enumerate(done):
        slots += [(bucket, local)] * (1 << depth - local)
    return depth, slots


class Index:
    """keyed: (id, key, text_sha256) of each row. directory: (slot, bucket, local_depth). entries: (bucket, key, text_sha256, keep_id, group_size)."""

    def __init__(self, keyed: DataFrame, depth: int, directory: DataFrame, entries: DataFrame | None = None):
        self.keyed, self.depth, self.directory, self.entries = keyed, depth, directory, entries

    def routed(self, rows: DataFrame) -> DataFrame:
        """rows, which have a key, with the bucket that the directory sends them to."""
        slot = F.shiftrightunsigned("key", 64 - self.depth) if self.depth else F.lit(0).cast("long")
        # at most 2**MAX_DEPTH rows are broadcast
        return rows.withColumn("slot", slot).join(F.broadcast(self.directory.select("slot", "bucket")), "slot").drop("slot")

    def verdicts(self) -> DataFrame:
        """(id, keep_id, group_size, text_sha256) of each row."""
        return self.routed(self.keyed).join(self.entries, ["bucket", "key", "text_sha256"]).select("id", "keep_id", "group_size", "text_sha256")


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = BUCKET_CAPACITY, hash_of: Callable[[Column], Column] = F.xxhash64) -> Index:
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), normal(F.col(text_col)).alias("norm")).withColumn("key", hash_of(F.col("norm")))
    keyed = materialise(rows.select("id", "key", F.sha2("norm", 256).alias("text_sha256")), "dedup-keys")
    chains = materialise(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "dedup-chains")
    total = chains.agg(F.count(F.lit(1)).alias("keys"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
    capacity = max(capacity, total["keys"] >> (MAX_DEPTH - 2))
    leaf_depth = min(MAX_DEPTH, (total["keys"] // capacity).bit_length() + 4)
    held = chains.groupBy(F.shiftrightunsigned("key", 64 - leaf_depth).alias("leaf")).agg(F.count(F.lit(1)).alias("n")).toPandas()  # at most 2**MAX_DEPTH rows
    counts = np.zeros(1 << leaf_depth, dtype=np.int64)
    counts[held["leaf"]] = held["n"]
    depth, slots = grow_directory(counts, capacity)
    directory = materialise(spark.createDataFrame([(i, b, d) for i, (b, d) in enumerate(slots)], _DIRECTORY).coalesce(1), "dedup-directory")
    index = Index(keyed, depth, directory)

    hot = materialise(chains.where((F.col("n") > capacity) & (F.col("n") > total["rows"] / HOT_SHARE)).select("key"), "dedup-hot")  # fewer than HOT_SHARE rows
    one = rows.select("key", "norm", "id", F.lit(1).cast("long").alias("n"))
    if hot.take(1):
        combined = one.join(F.broadcast(hot), "key", "left_semi").groupBy("key", "norm").agg(F.max("id").alias("id"), F.sum("n").alias("n"))
        one = one.join(F.broadcast(hot), "key", "left_anti").unionByName(combined)
    owners = int(spark.conf.get("spark.sql.shuffle.partitions"))
    owned = index.routed(one).repartition(owners, "bucket")
    entries = owned.groupBy("bucket", "key", "norm").agg(F.max("id").alias("keep_id"), F.sum("n").alias("group_size"))  # in the owner's task: no further exchange
    index.entries = materialise(entries.select("bucket", "key", F.sha2("norm", 256).alias("text_sha256"), "keep_id", "group_size"), "dedup-buckets")
    return index


def find_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row for each row of docs: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as the empty text, and empty texts equal one
    another. Of equal texts the largest id stays; a null id stays only where the group has no other, and keep_id is then
    null. Rows that repeat both text and id are one document listed twice and share a verdict. No rows give no rows.
    Other columns are ignored. Groups larger than a partition are split by adaptive execution in the join."""
    found = build_index(docs, id_col, text_col, **how).verdicts()
    return found.select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of docs that stay, once each, with all their columns, which may have any names.

    Of rows that repeat both text (but for A-Z) and id, also of null ids, one stays: the first by their columns as JSON."""
    index = build_index(docs, id_col, text_col, **how)
    sha = lambda df: F.sha2(normal(df[text_col]), 256)
    stay = index.entries.select("keep_id", "text_sha256")
    kept = docs.join(stay, docs[id_col].eqNullSafe(stay["keep_id"]) & (sha(docs) == stay["text_sha256"]), "left_semi")
    again = index.keyed.groupBy("id", "text_sha256").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id", "text_sha256")
    again = materialise(again, "dedup-repeated")
    if not again.take(1):
        return kept
    listed = kept[id_col].eqNullSafe(again["id"]) & (sha(kept) == again["text_sha256"])
    twice = kept.join(again, listed, "left_semi")
    row = F.struct(*(twice[c] for c in docs.columns))
    once = twice.groupBy(twice[id_col], sha(twice)).agg(F.min_by(row, F.to_json(row)).alias("row")).select("row.*")
    return kept.join(again, listed, "left_anti").unionByName(once)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every document."""
    return find_duplicates(table(spark, sf_dir, "documents"))


OP2_SQL = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents
), g AS (
  SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm
)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(d.norm) AS text_sha256
FROM d JOIN g ON d.norm = g.norm
"""
