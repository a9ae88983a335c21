"""Tables and blobs that are written: appends, children that are exchanged, content-addressed files.

Tables are Parquet folders. A table of children is partitioned by a hash of their parent, so that exchanging the children
of some parents rewrites their partitions and no others.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

#: Partitions of a table of children. It is fixed when the table is made.
BUCKETS = 64


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which the driver and all executors share; one of our own where it is unset in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='folioscan-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def append(rows: DataFrame, path: str) -> None:
    """Adds rows to a table, which it makes if need be."""
    rows.write.mode("append").parquet(path)


def _bucketed(children: DataFrame, parent: str, buckets: int) -> DataFrame:
    return children.withColumn("bucket", F.pmod(F.xxhash64(parent), F.lit(buckets)).cast("int"))


def write_children(children: DataFrame, path: str, parent: str, buckets: int = BUCKETS) -> None:
    """A new table of children."""
    _bucketed(children, parent, buckets).repartition("bucket").write.partitionBy("bucket").mode("errorifexists").parquet(path)


def read_children(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """The table; a schema is needed if it may have no rows left."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path).drop("bucket")


def exchange_children(fresh: DataFrame, path: str, parent: str, parents: DataFrame | None = None, buckets: int = BUCKETS) -> None:
    """The children of fresh's parents, and of `parents`, which may have none now, are those of fresh; doing it twice changes nothing.

    Only partitions that hold such parents are read and written. They are written to a folder beside the table first, as
    Spark would delete what it still reads."""
    spark = fresh.sparkSession
    named = fresh.select(parent) if parents is None else fresh.select(parent).unionByName(parents.select(parent))
    named = named.distinct()
    touched = [r[0] for r in _bucketed(named, parent, buckets).select("bucket").distinct().collect()]  # at most `buckets` rows
    old = spark.read.parquet(path).where(F.col("bucket").isin(touched))
    kept = old.join(named, parent, "left_anti").unionByName(_bucketed(fresh, parent, buckets).select(*old.columns))
    beside = scratch(spark, "exchange")
    kept.write.parquet(beside)
    # a bucket that is empty now keeps no rows: a dynamic overwrite would leave it as it was
    spark.read.schema(kept.schema).parquet(beside).repartition("bucket").write.option("partitionOverwriteMode", "dynamic").partitionBy("bucket").mode("overwrite").parquet(path)
    left = {r[0] for r in spark.read.schema(kept.schema).parquet(beside).select("bucket").distinct().collect()}
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for b in set(touched) - left:
        files.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/bucket={b}"), True)


def store_blobs(blobs: DataFrame, path: str, scope: str, content: str = "content") -> DataFrame:
    """blobs with sha256 and storage_path (scope/sha256); content that its scope doesn't have yet is added to the table at path.

    The table has storage_path, sha256 and content, and is partitioned by the digest's first two digits. Equal content of
    one scope is stored once, whatever the number of uploads; storing it again changes nothing."""
    spark = blobs.sparkSession
    digest = F.sha2(content, 256)
    named = blobs.withColumn("sha256", digest).withColumn("storage_path", F.concat_ws("/", F.col(scope).cast("string"), digest))
    new = named.groupBy("storage_path", "sha256").agg(F.first(content).alias("content"))  # equal content: any of it
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        new = new.join(spark.read.parquet(path).select("storage_path"), "storage_path", "left_anti")
    new.withColumn("prefix", F.substring("sha256", 1, 2)).repartition("prefix").write.partitionBy("prefix").mode("append").parquet(path)
    return named


def read_blobs(wanted: DataFrame, path: str) -> DataFrame:
    """wanted (storage_path, ...) with their content; one that isn't there is an error."""
    spark = wanted.sparkSession
    found = wanted.withColumn("prefix", F.substring(F.element_at(F.split("storage_path", "/"), -1), 1, 2)).join(spark.read.parquet(path).select("storage_path", "prefix", "content"), ["prefix", "storage_path"], "left").drop("prefix")
    missing = F.raise_error(F.concat(F.lit("no content at "), F.col("storage_path"))).cast("binary")
    return found.withColumn("content", F.coalesce(F.col("content"), missing))
