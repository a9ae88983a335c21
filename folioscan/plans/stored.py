"""Queries over what the library stores: a vector index, tables that are written together, a graph of foreign keys, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from folioscan.operators import cascade, postings, ranked_postings, vector_index
from folioscan.sources import event_source, sse, tables, together
from folioscan.streaming import ingest, lifecycle


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _index(spark: SparkSession, sf_dir: str) -> tuple[vector_index.VectorIndex, DataFrame]:
    """An index of all vectors by label, and the queries: every vector whose id is divisible by 100."""
    rows = _t(spark, sf_dir, "embeddings")
    index = vector_index.build_index(rows, tables.scratch(spark, "index"), "vec_id", "embedding", "label")
    return index, rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


def indexed_vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 rows of labels below 8 that are nearest to each query, exactly, by a stored index."""
    index, asked = _index(spark, sf_dir)
    found = index.search(asked, 20, None, F.col("scope") < 8)
    return found.select("query_id", F.col("key").alias("vec_id"), F.round("similarity", 6).alias("similarity"), "rank")


def probed_vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows of each query in as many cells as find 95 of 100 of its sample's true neighbours."""
    index, asked = _index(spark, sf_dir)
    probes = index.probes_for(asked.orderBy(F.xxhash64("query_id")).limit(200), 20, 0.95)
    return index.search(asked, 20, probes).select("query_id", F.col("key").alias("vec_id"), F.round("similarity", 6).alias("similarity"), "rank")


def _uploads(docs: DataFrame) -> DataFrame:
    """Events of each document's upload, by what is left of its id; (key, at, seq, event, reason, round)."""
    kind = F.col("doc_id") % 8
    paths = [
        [(0, 0, "UPLOADED"), (0, 1, "EXTRACTING"), (1, 2, "CHUNKING"), (1, 3, "EMBEDDING"), (2, 4, "READY")],
        [(0, 0, "UPLOADED"), (0, 1, "EXTRACTING"), (1, 2, "FAILED")],
        [(0, 0, "UPLOADED"), (1, 1, "EXTRACTING"), (1, 2, "CHUNKING")],  # and then nothing
        [(0, 0, "UPLOADED"), (0, 1, "EMBEDDING"), (1, 2, "EXTRACTING"), (1, 3, "READY"), (1, 4, "FAILED")],
        [(0, 0, "UPLOADED"), (0, 1, "EXTRACTING"), (1, 2, "DELETED"), (1, 3, "CHUNKING"), (2, 4, "EMBEDDING")],
        [(0, 1, "EXTRACTING"), (1, 2, "CHUNKING")],
        [(0, 0, "UPLOADED"), (0, 2, "EXTRACTING"), (1, 1, "CHUNKING"), (1, 3, "CHUNKING"), (1, 4, "EMBEDDING"), (2, 5, "READY")],
        [(0, 0, "UPLOADED"), (0, 0, "UPLOADED"), (0, 1, "EXTRACTING"), (1, 2, "CHUNKING"), (1, 3, "EMBEDDING"), (2, 4, "READY"), (2, 5, "FAILED")],
    ]
    event = lambda i, r, m, e: F.struct(F.lit(r).alias("round"), F.lit(m).alias("minute"), F.lit(i).alias("seq"), F.lit(e).alias("event"))
    each = F.get(F.array(*[F.array(*[event(i, *e) for i, e in enumerate(p)]) for p in paths]), kind.cast("int"))
    start = F.timestamp_seconds(F.lit(1_704_067_200) + F.pmod(F.col("doc_id"), F.lit(300)))
    return docs.select("doc_id", start.alias("_s"), F.explode(each).alias("_e")).select(
        F.col("doc_id").alias("key"), (F.col("_s") + F.make_dt_interval(mins=F.col("_e.minute"))).alias("at"), F.col("_e.seq").cast("long").alias("seq"), F.col("_e.event").alias("event"), F.when(F.col("_e.event") == "FAILED", "no text").alias("reason"), F.col("_e.round").alias("round")
    )


def lifecycle_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the events of all uploads leave them: a stateful stream that is stopped and taken up again, then a late tick that ends the timers."""
    events, folder = _uploads(_t(spark, sf_dir, "documents").select("doc_id")), tables.scratch(spark, "lifecycle")
    shape = events.drop("round").schema
    tick = spark.createDataFrame([(-1,)], "key long").select("key", F.timestamp_seconds(F.lit(1_704_067_200 + 14_400)).alias("at"), F.lit(0).cast("long").alias("seq"), F.lit("UPLOADED").alias("event"), F.lit(None).cast("string").alias("reason"))
    for i in range(3):
        batch = events.where(F.col("round") == i).drop("round")
        (batch if i < 2 else batch.unionByName(tick)).coalesce(200).write.mode("append").parquet(f"{folder}/in")
        lifecycle.run_transitions(ingest.read_stream(spark, f"{folder}/in", shape, 1000), f"{folder}/log", f"{folder}/checkpoint").awaitTermination()
    log = spark.read.schema(f"key long, {lifecycle.LOG}").parquet(f"{folder}/log")
    return lifecycle.current_states(log).select("key", "state", (F.unix_timestamp("at") - 1_704_067_200).alias("second"), "reason", "refused")


def provider_event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads of a log of server-sent events, read as a stream some bytes at a time."""
    folder, n = tables.scratch(spark, "events"), F.col("event_id").cast("string")
    body = F.concat(F.lit("id: "), n, F.when(F.col("event_id") % 2 == 0, "\r\n").otherwise("\n"), F.lit("event: delta\ndata: {\"n\": "), n, F.lit(", \"kind\": \"\u00e9"), F.col("event_type"), F.lit("\"}"), F.when(F.col("event_id") % 3 == 0, "\r\n\r\n").otherwise("\n"))
    logs = _t(spark, sf_dir, "events").select(body.alias("value"))
    logs.write.text(f"{folder}/in")
    spark.dataSource.register(event_source.EventLogs)
    size = spark.read.format("binaryFile").load(f"{folder}/in").agg(F.sum("length")).first()[0] or 0
    stream = spark.readStream.format("event_logs").option("path", f"{folder}/in").option("max_bytes", size // 4 + 1).option("split_bytes", 1 << 16).option("progress", f"{folder}/progress").load()

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    query = stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{folder}/checkpoint").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    payload = F.explode(sse.data_lines(F.col("body")))
    read = spark.read.schema(event_source.SCHEMA).parquet(f"{folder}/out").select(payload.alias("data"))
    return read.select(F.get_json_object("data", "$.n").cast("long").alias("event_id"), F.get_json_object("data", "$.kind").alias("kind"))


def courses_with_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Courses and their owners' memberships, written together, the same twice, and joined from where they are stored."""
    path, c = tables.scratch(spark, "together"), _t(spark, sf_dir, "customer")
    rows = c.select(
        F.struct(F.col("c_custkey").cast("long").alias("id"), F.col("c_name").alias("name")).alias("courses"),
        F.when(F.col("c_custkey") % 10 > 0, F.struct(F.col("c_custkey").cast("long").alias("course"), F.col("c_nationkey").cast("long").alias("member"), F.lit("OWNER").alias("role"))).alias("memberships"),
    )
    for half in (0, 1, 1):
        together.write_together(rows.where(F.col("courses.id") % 2 == half), path, f"half-{half}")
    courses, members = together.read_together(spark, path, "courses", "id long, name string"), together.read_together(spark, path, "memberships", "course long, member long, role string")
    return courses.join(members, F.col("id") == F.col("course"), "left").select("id", "name", "member", "role")


def cascade_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left after some customers go: of their orders, these orders' lines, and of threads with their messages."""
    c, o = _t(spark, sf_dir, "customer").select("c_custkey"), _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = _t(spark, sf_dir, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("line"), "l_orderkey", "l_suppkey")
    messages = _t(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("message"), "conv_id")
    threads = messages.select("conv_id").distinct().withColumn("owner", F.col("conv_id") % 500)
    found = cascade.cascade(
        {"course": c, "document": o, "chunk": lines, "thread": threads, "message": messages, "supplier": _t(spark, sf_dir, "supplier").select("s_suppkey")},
        {"course": "c_custkey", "document": "o_orderkey", "chunk": "line", "thread": "conv_id", "message": "message", "supplier": "s_suppkey"},
        [
            cascade.ForeignKey("document", "o_custkey", "course", "c_custkey"),
            cascade.ForeignKey("chunk", "l_orderkey", "document", "o_orderkey"),
            cascade.ForeignKey("chunk", "l_suppkey", "supplier", "s_suppkey", cascade.SET_NULL),
            cascade.ForeignKey("thread", "owner", "course", "c_custkey"),
            cascade.ForeignKey("message", "conv_id", "thread", "conv_id"),
        ],
        {"course": c.where("c_custkey % 3 = 0"), "supplier": _t(spark, sf_dir, "supplier").where("s_suppkey % 2 = 0").select("s_suppkey")},
    ).left
    per = lambda name, key: found[name].groupBy(F.lit(name).alias("tbl"), F.col(key).cast("long").alias("parent")).agg(F.count(F.lit(1)).alias("n"))
    return per("document", "o_custkey").unionByName(per("chunk", "l_suppkey")).unionByName(per("thread", "owner")).unionByName(per("message", "conv_id")).unionByName(per("course", "c_custkey"))


def _ranges(spark: SparkSession, sf_dir: str) -> tuple[ranked_postings.RankedPostings, DataFrame]:
    docs = _t(spark, sf_dir, "documents")
    return ranked_postings.write_ranges(postings.with_terms(docs.select("doc_id", "text"), "text"), tables.scratch(spark, "ranges"), "doc_id"), docs


def ranked_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 English documents that answer "the and of" best, by ranges of stored terms that can hold one."""
    index, docs = _ranges(spark, sf_dir)
    return index.search(["the", "and", "of"], scope=docs.where("lang = 'en'"))


def closest_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 200 documents in which "for" and "with" stand closest, by stored positions."""
    index, _ = _ranges(spark, sf_dir)
    return index.closest(["with", "for"], 200)


QUERIES = {f.__name__: f for f in (ranked_topk, closest_terms, indexed_vector_topk, probed_vector_topk, lifecycle_states, provider_event_stream, courses_with_owners, cascade_graph)}

#: probed_vector_topk is approximate: a test measures its recall.
ORACLE_SQL = {
    "ranked_topk": r"""
SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id)::INT AS rank FROM (
  SELECT doc_id, round(len(list_filter(t, lambda x: list_contains(['and', 'of', 'the'], x))) / (1 + ln(len(t)::DOUBLE)), 6) AS score
  FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS t FROM documents WHERE lang = 'en')
  WHERE len(list_intersect(['and', 'of', 'the'], t)) = 3 ORDER BY score DESC, doc_id LIMIT 20)
""",
    "closest_terms": r"""
WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS t FROM documents),
  p AS (SELECT doc_id, unnest(t) AS w, generate_subscripts(t, 1) AS i FROM t),
  n AS (SELECT doc_id, w, i, lag(w) OVER o AS v, lag(i) OVER o AS j FROM p WHERE w IN ('for', 'with') WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
  c AS (SELECT doc_id, min(i - j + 1) AS cover FROM n WHERE v <> w GROUP BY doc_id)
SELECT doc_id, cover::INT AS cover, (row_number() OVER (ORDER BY cover, doc_id))::INT AS rank FROM c QUALIFY rank <= 200
""",
    "indexed_vector_topk": """
WITH e AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_cosine_similarity(q.v, c.v) AS s FROM e q JOIN e c ON c.label < 8 WHERE q.vec_id % 100 = 0
)
SELECT query_id, vec_id, round(s, 6) AS similarity, (row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id))::INT AS rank FROM s QUALIFY rank <= 20
""",
    "provider_event_stream": "SELECT event_id, chr(233) || event_type AS kind FROM events",
    "courses_with_owners": "SELECT c_custkey::BIGINT AS id, c_name AS name, CASE WHEN c_custkey % 10 > 0 THEN c_nationkey::BIGINT END AS member, CASE WHEN c_custkey % 10 > 0 THEN 'OWNER' END AS role FROM customer",
    "cascade_graph": """
WITH d AS (SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0)),
  l AS (SELECT CASE WHEN l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 2 = 0) THEN NULL ELSE l_suppkey END AS s FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM d) OR l_orderkey NOT IN (SELECT o_orderkey FROM orders)),
  t AS (SELECT DISTINCT conv_id, conv_id % 500 AS owner FROM conversations WHERE conv_id % 500 NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0))
SELECT 'document' AS tbl, o_custkey::BIGINT AS parent, count(*) AS n FROM d GROUP BY o_custkey
UNION ALL SELECT 'chunk', s::BIGINT, count(*) FROM l GROUP BY s
UNION ALL SELECT 'thread', owner::BIGINT, count(*) FROM t GROUP BY owner
UNION ALL SELECT 'message', conv_id::BIGINT, count(*) FROM conversations WHERE conv_id IN (SELECT conv_id FROM t) GROUP BY conv_id
UNION ALL SELECT 'course', c_custkey::BIGINT, 1 FROM customer WHERE c_custkey % 3 > 0
""",
    "lifecycle_states": """
WITH e AS (SELECT doc_id AS key, doc_id % 8 AS k FROM documents)
SELECT key, CASE k WHEN 0 THEN 'READY' WHEN 1 THEN 'FAILED' WHEN 2 THEN 'FAILED' WHEN 3 THEN 'FAILED' WHEN 4 THEN 'DELETED' ELSE 'READY' END AS state,
  CASE k WHEN 1 THEN 'no text' WHEN 2 THEN 'stuck in CHUNKING' WHEN 3 THEN 'no text' END AS reason, CASE k WHEN 3 THEN 2 WHEN 6 THEN 1 WHEN 7 THEN 2 ELSE 0 END::BIGINT AS refused,
  key % 300 + 60 * CASE k WHEN 1 THEN 2 WHEN 2 THEN 62 WHEN 4 THEN 2 WHEN 6 THEN 5 ELSE 4 END::BIGINT AS second
FROM e WHERE k <> 5 UNION ALL SELECT -1, 'UPLOADED', NULL, 0, 14400
""",
}
