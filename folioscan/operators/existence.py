"""Whether keys are in a large stored set, without a shuffle of the stored ones.

Keys are stored by buckets of their hash, and beside each bucket a Bloom filter of blocks: a key sets eight bits of one
block's four words. Filters are rows (bucket, block, four words) that are merged by OR, so that adding keys appends rows.
A look-up joins the asked keys with the blocks that they fall in; what no block rules out is compared with the keys
themselves, of buckets that hold such a key. Other buckets aren't read, and a wrong yes of a filter is never an answer.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from folioscan.sources.tables import scratch

#: Keys of a bucket, the most buckets, and keys of a block of 256 bits when the set is made.
BUCKET_KEYS, MOST_BUCKETS, BLOCK_KEYS = 1_000_000, 4096, 16
_WORDS = ("w0", "w1", "w2", "w3")
_FILTER = "block long, w0 long, w1 long, w2 long, w3 long, bucket int"


def store_keys(rows: DataFrame, path: str, *keys: str, bucket_keys: int = BUCKET_KEYS, block_keys: int = BLOCK_KEYS) -> "StoredKeys":  # noqa: UP037
    """A new set of rows' keys. Keys with a null are in no set; equal keys are stored once; the set may be empty."""
    n = rows.count()
    buckets = min(MOST_BUCKETS, max(1, -(-n // bucket_keys)))
    stored = StoredKeys(rows.sparkSession, path, keys, buckets, max(1, -(-n // (buckets * block_keys))), StructType([*rows.select(*keys).schema, StructField("bucket", IntegerType())]))
    stored._write(rows)
    return stored


@dataclass(frozen=True)
class StoredKeys:
    """What store_keys stored. The numbers of buckets and blocks stay; a set that has grown much is better stored anew."""

    spark: SparkSession
    path: str
    keys: tuple[str, ...]
    buckets: int
    blocks: int
    schema: StructType

    def stored(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/keys")

    def filters(self) -> DataFrame:
        return self.spark.read.schema(_FILTER).parquet(f"{self.path}/filters")

    def _placed(self, rows: DataFrame) -> DataFrame:
        """Distinct keys without nulls, with their bucket, block and bits."""
        named = rows.select(*self.keys).dropna().distinct()
        bits = named.withColumn("_b", F.xxhash64(F.lit(2), *self.keys))
        words = [F.expr(f"shiftleft(1L, cast(shiftright(_b, {12 * i}) & 63L AS int)) | shiftleft(1L, cast(shiftright(_b, {12 * i + 6}) & 63L AS int))").alias(w) for i, w in enumerate(_WORDS)]
        return bits.select(*self.keys, F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int").alias("bucket"), F.pmod(F.xxhash64(F.lit(1), *self.keys), F.lit(self.blocks)).alias("block"), *words)

    def _write(self, fresh: DataFrame) -> None:
        """Filters first: bits of keys that then fail to be written only let a look-up read more."""
        placed = self._placed(fresh)
        merged = placed.groupBy("bucket", "block").agg(*[F.bit_or(w).alias(w) for w in _WORDS])
        merged.repartition("bucket").sortWithinPartitions("bucket", "block").write.partitionBy("bucket").mode("append").parquet(f"{self.path}/filters")
        placed.select(*self.keys, "bucket").repartition("bucket").sortWithinPartitions("bucket", *self.keys).write.partitionBy("bucket").mode("append").parquet(f"{self.path}/keys")

    def possible(self, asked: DataFrame) -> DataFrame:
        """Distinct keys of asked that no filter rules out, with their bucket: all that are stored and few others."""
        placed = self._placed(asked)
        touched = [r[0] for r in placed.select("bucket").distinct().collect()]  # at most as many as buckets
        merged = self.filters().where(F.col("bucket").isin(touched)).groupBy("bucket", "block").agg(*[F.bit_or(w).alias(f"_{w}") for w in _WORDS])
        met = placed.join(merged, ["bucket", "block"])
        for w in _WORDS:
            met = met.where(F.col(w).bitwiseAND(F.col(f"_{w}")) == F.col(w))
        return met.select(*self.keys, "bucket")

    def found(self, asked: DataFrame) -> DataFrame:
        """Distinct keys of asked that are stored.

        What the filters leave is written to a table in spark.checkpoint.dir, so that Spark knows its size: it is
        broadcast to the stored keys if it is small, and joined by a shuffle if not."""
        beside = scratch(self.spark, "possible")
        self.possible(asked).write.parquet(beside)
        left = self.spark.read.schema(self.schema).parquet(beside)
        touched = [r[0] for r in left.select("bucket").distinct().collect()]
        return self.stored().where(F.col("bucket").isin(touched)).join(left, ["bucket", *self.keys], "left_semi").select(*self.keys).distinct()

    def exists(self, asked: DataFrame) -> DataFrame:
        """asked with `exists`, false where a key is null; repeated rows stay."""
        found = self.found(asked).select(*[F.col(k).alias(f"_{k}") for k in self.keys], F.lit(True).alias("_there"))
        same = [F.col(k) == F.col(f"_{k}") for k in self.keys]
        out = asked.join(found, same, "left")
        return out.select(*asked.columns, F.coalesce("_there", F.lit(False)).alias("exists"))

    def add(self, fresh: DataFrame) -> None:
        """Adds keys that aren't there yet; adding them again, or again after a failure, changes nothing."""
        named = fresh.select(*self.keys).dropna().distinct()
        self._write(named.join(self.found(named), list(self.keys), "left_anti"))
