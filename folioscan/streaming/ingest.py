"""Ingestion as streams: uploads without copies, a log of states, the latest state, and answers as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from folioscan.operators.library import FAILED, STATES
from folioscan.sources.tables import scratch


def read_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 2) -> DataFrame:
    """Files that have been committed to a folder, a few at a time; so many bound the work in flight."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def first_uploads(uploads: DataFrame, scope: str, digest: str, at: str, late: str = "1 day") -> DataFrame:
    """Uploads whose content is new in their scope; state is kept as long as copies may come late."""
    stream = uploads.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return stream.dropDuplicatesWithinWatermark([scope, digest])


def state_log(uploads: DataFrame, key: str, n_words: str) -> DataFrame:
    """(key, step, state): the states that an upload passes; one without words fails while chunking."""
    ok = F.transform(F.array(*map(F.lit, STATES)), lambda s, i: F.struct(i.alias("step"), s.alias("state")))
    bad = F.concat(F.slice(ok, 1, 3), F.array(F.struct(F.lit(3).alias("step"), F.lit(FAILED).alias("state"))))
    return uploads.select(key, F.explode(F.when(F.coalesce(n_words, F.lit(0)) > 0, ok).otherwise(bad)).alias("_s")).select(key, "_s.step", "_s.state")


def latest_states(log: DataFrame, key: str) -> DataFrame:
    """Each key's last state, as a streaming aggregation (complete or update mode)."""
    return log.groupBy(key).agg(F.max(F.struct("step", "state")).alias("_m")).select(key, F.col("_m.step").alias("step"), F.col("_m.state").alias("state"))


def windowed_counts(events: DataFrame, at: str, kind: str, every: str = "1 day", late: str = "1 day") -> DataFrame:
    """(start, kind, n) in windows of event time that close when the watermark passes."""
    stream = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return stream.groupBy(F.window(at, every), kind).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), kind, "n")


def append_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Writes each batch to a folder of its own number, so that a batch that is repeated replaces itself."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def to_memory(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """All that a stream gives from what is there now, as a table of that name. The driver holds it: for few rows only."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    return stream.sparkSession.table(name)


def to_table(stream: DataFrame, key: str) -> DataFrame:
    """Each key's row as an aggregation leaves it after what is there now, from a table in spark.checkpoint.dir.

    Batches write only the keys that they change (update mode), and the last batch with a key holds. No rows pass
    through the driver. Tables stay after the query, as their checkpoints do."""
    spark = stream.sparkSession
    folder = scratch(spark, "stream")
    spark.createDataFrame([], stream.schema).write.parquet(f"{folder}/rows/batch=-1")  # the table is there without any batch
    query = append_once(stream, f"{folder}/rows", f"{folder}/checkpoint", "update")
    try:
        query.awaitTermination()
    finally:
        query.stop()
    rows = spark.read.schema(T.StructType([*stream.schema, T.StructField("batch", T.LongType())])).parquet(f"{folder}/rows")
    return rows.groupBy(key).agg(F.max_by(F.struct(*stream.columns), "batch").alias("_row")).select("_row.*")
