"""More queries over the driver's tables, by what is looked up, written, streamed and checked, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from folioscan.functions import english, text as tx, vectors
from folioscan.operators import access, chunking, grounding, ingestion, library, postings, retrieval
from folioscan.plans import schema
from folioscan.sources import providers, sse, tables
from folioscan.streaming import ingest

TERMS = ["the", "and", "of"]


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def duplicate_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of the course and content of document 0: a lookup by a unique key."""
    docs = _t(spark, sf_dir, "documents")
    one = docs.where("doc_id = 0").select("source", F.sha2("text", 256)).first()
    return docs.where((F.col("source") == one[0]) & (F.sha2("text", 256) == one[1])).select("doc_id", "source")


def scoped_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order by its key within a customer; of another customer it reads as missing."""
    asked = _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    key, owner = asked.agg(F.min(F.struct("o_orderkey", "o_custkey")).alias("m")).select("m.*").first()
    return asked.where((F.col("o_orderkey") == key) & (F.col("o_custkey") == owner)).union(asked.where((F.col("o_orderkey") == key) & (F.col("o_custkey") == owner + 1)))


def in_flight_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = F.array(*map(F.lit, (*library.STATES, library.FAILED)))
    e = _t(spark, sf_dir, "events").select("event_id", F.get(states, (F.col("event_id") % 6).cast("int")).alias("state"))
    return e.where(F.col("state").isin(*library.IN_FLIGHT)).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


def invites_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invitations by the tokens of pasted URLs, with their course, its owner and when they expire."""
    e, now = _t(spark, sf_dir, "events"), F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    asked = e.where("event_id % 5 = 0").select(tx.invite_token(F.concat(F.lit("https://x.org/invite/tok"), (F.col("event_id") * 2).cast("string"), F.lit("?a=1"))).alias("token"))
    expires = access.expires_in(F.col("ts").cast("timestamp_ntz"), F.when(F.col("event_id") % 3 > 0, (F.col("event_id") % 50).cast("int")))
    invites = e.select(F.concat(F.lit("tok"), F.col("event_id").cast("string")).alias("token"), (F.col("event_id") % 40).alias("course"), expires.alias("expires_at"))
    courses = e.select((F.col("event_id") % 40).alias("course")).distinct().withColumn("owner", F.col("course") % 25)
    owners = _t(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("owner"), "n_name")
    found = access.invites_by_token(asked, invites, courses, owners, "token", "course", "owner")
    return found.select("token", "course", "n_name", F.date_format("expires_at", "yyyy-MM-dd HH:mm:ss").alias("expires"), access.expired(F.col("expires_at"), now).alias("expired"))


def page_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", access.clamp_page(F.col("l_linenumber") - 2, F.lit(4)).cast("int").alias("page"))


def record_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _t(spark, sf_dir, "documents").select("doc_id", library.record_id(F.col("source"), F.col("doc_id")).alias("id"))
    return d.select("doc_id", "id", library.is_record_id(F.col("id")).alias("valid"), library.is_record_id(F.concat(F.lit("x"), "id")).alias("other_valid"))


def url_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = F.unhex(F.substring(F.sha2(F.col("event_id").cast("string"), 256), 1, 48))
    return _t(spark, sf_dir, "events").select("event_id", tx.url_token(data).alias("token"))


def first_text_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    block = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.cast("string").alias("text"))
    blocks = F.array(block("image", F.lit("no")), block("text", F.when(n % 3 > 0, F.concat(F.lit("t"), n.cast("string")))), block("text", F.when(n % 2 > 0, "u")))
    return _t(spark, sf_dir, "events").select("event_id", sse.first_text(blocks).alias("text"))


def batched_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "embeddings")
    rows = e.select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.concat(F.lit("chunk "), i.cast("string"))).alias("content"), F.transform(F.sequence(F.lit(1), F.lit(3)), lambda i: F.slice("embedding", i, 2)).alias("vector"))
    return library.zip_positions(rows, "content", "vector").select("vec_id", "position", "content", F.round(F.col("vector")[0].cast("double"), 6).alias("first"))


def upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _t(spark, sf_dir, "customer").select("c_custkey", "c_name")
    fresh = c.where("c_custkey % 4 = 0").withColumn("c_name", F.lit("new")).union(c.where("c_custkey % 4 = 1").select(F.col("c_custkey") + 10_000_000, "c_name"))
    return library.upsert_latest(c, fresh, "c_custkey")


def answered_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies of a provider, streamed word by word, to the last messages of each thread."""
    m = _t(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("conv_id") % 9 > 0, F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ")).otherwise("  ").alias("text"))
    last = grounding.last_messages(m, "conv_id", ["turn"], 3).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("position", "text"))).alias("m"))
    said = providers.reply(last.select("conv_id", F.col("m.text").alias("messages")), "messages", providers.EchoReplier())
    return said.select("conv_id", F.sha2("reply", 256).alias("reply_sha"), F.col("reply_error").alias("error"))


def provider_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id").cast("string")
    delta = lambda text: F.concat(F.lit('data: {"type":"content-delta","delta":{"message":{"content":{"text":"'), text, F.lit('"}}}}\n'))
    body = F.concat(F.lit('event: x\ndata: {"type":"message-start"}\n\n'), delta(F.concat(F.lit(" a"), n)), F.lit("\ndata:\n"), F.when(F.col("event_id") % 3 > 0, delta(F.lit(" b"))).otherwise(F.lit("data: {bad\n")), F.lit("data: [DONE]\n"))
    header = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("Bearer "), n)).otherwise(F.concat(F.lit("Basic "), n))
    return _t(spark, sf_dir, "events").select("event_id", sse.stream_text(body).alias("reply"), F.size(sse.data_lines(body)).alias("n_lines"), sse.bearer(header).alias("token"))


def vector_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "embeddings")
    query = e.where("vec_id = 0").select("embedding").first()[0]
    return e.select("vec_id", F.round(vectors.cosine_distance(F.col("embedding"), F.lit([float(x) for x in query])), 4).alias("distance"))


def question_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    question = F.when(k % 7 > 0, F.repeat(F.lit("q"), (k * 37 % 5000 + 1).cast("int"))).otherwise("  ")
    rules = schema.question_rules(question) | schema.course_rules(F.when(k % 5 > 0, F.repeat(F.lit("n"), (k % 150 + 1).cast("int"))), F.when(k % 3 > 0, F.repeat(F.lit("d"), (k * 11 % 1500).cast("int"))))
    said = F.transform(F.array_sort(F.map_entries(access.errors(rules))), lambda x: F.concat(x["key"], F.lit(" "), x["value"]))
    return _t(spark, sf_dir, "customer").select("c_custkey", F.array_join(said, "; ").alias("errors"))


def stored_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents written by address, written again, and read back."""
    docs, path = _t(spark, sf_dir, "documents").select("doc_id", "source", F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("content")), tables.scratch(spark, "blobs")
    named = tables.store_blobs(docs, path, "source")
    tables.store_blobs(docs, path, "source")
    back = tables.read_blobs(named.select("doc_id", "storage_path"), path)
    return back.select("doc_id", "storage_path", F.sha2("content", 256).alias("content_sha"))


def exchanged_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders in a table, some orders' lines exchanged there, twice."""
    lines, path = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), tables.scratch(spark, "lines")
    tables.write_children(lines, path, "l_orderkey")
    fresh = lines.where("l_orderkey % 10 = 0 AND l_linenumber = 1").withColumn("l_quantity", F.lit(0.0).cast(dict(lines.dtypes)["l_quantity"]))
    for _ in range(2):
        tables.exchange_children(fresh, path, "l_orderkey")
    return tables.read_children(spark, path).groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"))


def _indexed(spark: SparkSession, sf_dir: str, terms: list[str], analyse) -> DataFrame:
    docs, path = _t(spark, sf_dir, "documents"), tables.scratch(spark, "postings")
    postings.write_postings(postings.with_terms(docs.select("doc_id", "text"), "text", analyse), path, "doc_id")
    return postings.search_postings(spark, path, terms, "doc_id", docs.where(F.col("lang") == "en"))


def indexed_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text search of lexical_topk, by stored terms."""
    return _indexed(spark, sf_dir, TERMS, postings.simple_terms)


def lexical_english(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search by stems, which are made once, when texts are written."""
    return _indexed(spark, sf_dir, english.analyse("of the ha and reer"), english.english_terms)


def _ingested(spark: SparkSession, sf_dir: str) -> ingestion.Ingested:
    k = F.col("doc_id")
    content = F.when(k % 17 == 0, F.lit(None)).when(k % 13 == 0, F.unhex(F.lit("ff"))).when(k % 7 == 0, F.encode(F.lit(" \f "), "utf-8")).otherwise(F.encode(F.concat(F.lit("page one\f"), F.coalesce("text", F.lit(""))), "utf-8"))
    return ingestion.ingest(_t(spark, sf_dir, "documents").select("doc_id", content.alias("content")), "doc_id", "content", "text/plain", providers.StubEmbedder(dim=8))


def ingested_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ingested(spark, sf_dir).documents


def ingested_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ingested(spark, sf_dir).log


def ingested_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _ingested(spark, sf_dir).chunks
    return chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum(F.size("embedding")).alias("n_components"))


def scoped_chunk_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text search among the chunks of a course's documents that are READY, with each hit's file: for two words of document 1, in its course."""
    docs = _t(spark, sf_dir, "documents").withColumn("status", F.when(F.col("doc_id") % 5 == 0, "FAILED").otherwise("READY")).withColumn("filename", F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".pdf")))
    course, words = docs.where("doc_id = 1").select("source", F.slice(english.simple_terms(F.coalesce("text", F.lit(""))), 1, 2)).first()
    held = docs.where((F.col("source") == course) & (F.col("status") == "READY"))
    chunks = chunking.chunk_words(held, chunking.split_pages(F.col("text")), "doc_id")
    chunks = chunks.join(held.select("doc_id", "filename"), "doc_id").withColumn("chunk_id", F.concat_ws("-", "doc_id", "chunk_index"))
    hits = retrieval.text_search(chunks, words, "chunk_id", "content")
    return hits.join(chunks.select("chunk_id", "filename"), "chunk_id").select("chunk_id", "filename", "score", "rank")


def replayed_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream written batch by batch, and once more from its start: batches replace themselves."""
    docs, folder = _t(spark, sf_dir, "documents").select("doc_id", "n_chars"), tables.scratch(spark, "replayed")
    docs.write.parquet(f"{folder}/in")
    for i in range(2):
        ingest.append_once(ingest.read_stream(spark, f"{folder}/in", docs.schema), f"{folder}/out", f"{folder}/checkpoint-{i}").awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("doc_id", "n_chars")


QUERIES = {
    f.__name__: f
    for f in (
        duplicate_lookup, scoped_lookup, in_flight_counts, invites_joined, page_numbers, record_ids, url_tokens, first_text_blocks, batched_vectors, upserted, answered_threads, provider_streams, vector_distances,
        question_errors, stored_blobs, exchanged_children, indexed_topk, lexical_english, ingested_documents, ingested_log, ingested_chunks, scoped_chunk_hits, replayed_batches,
    )
}

_UPLOADS = r"""
WITH u AS (
  SELECT doc_id, CASE WHEN doc_id % 17 = 0 THEN 'gone' WHEN doc_id % 13 = 0 THEN 'broken' WHEN doc_id % 7 = 0 THEN 'blank' ELSE 'ok' END AS kind, 'page one' || chr(12) || coalesce(text, '') AS text FROM documents
)
"""

#: lexical_english has a stemmer, which SQL lacks.
ORACLE_SQL = {
    "duplicate_lookup": "SELECT doc_id, source FROM documents WHERE source = (SELECT source FROM documents WHERE doc_id = 0) AND sha256(text) = (SELECT sha256(text) FROM documents WHERE doc_id = 0)",
    "scoped_lookup": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey = (SELECT min(o_orderkey) FROM orders)",
    "in_flight_counts": "SELECT state, count(*) AS n FROM (SELECT (['UPLOADED', 'EXTRACTING', 'CHUNKING', 'EMBEDDING', 'READY', 'FAILED'])[event_id % 6 + 1] AS state FROM events) WHERE state IN ('UPLOADED', 'EXTRACTING', 'CHUNKING', 'EMBEDDING') GROUP BY state",
    "invites_joined": """
SELECT 'tok' || i.event_id AS token, i.event_id % 40 AS course, n_name, CASE WHEN i.event_id % 3 > 0 THEN strftime(i.ts + to_hours((i.event_id % 50)::INT), '%Y-%m-%d %H:%M:%S') END AS expires,
  i.event_id % 3 > 0 AND i.ts + to_hours((i.event_id % 50)::INT) < TIMESTAMP '2024-01-15 00:00:00' AS expired
FROM events a JOIN events i ON i.event_id = a.event_id * 2 JOIN nation ON n_nationkey = i.event_id % 40 % 25 WHERE a.event_id % 5 = 0
""",
    "page_numbers": "SELECT l_orderkey, l_linenumber, least(greatest(l_linenumber - 2, 1), 4)::INT AS page FROM lineitem",
    "record_ids": "SELECT doc_id, h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] AS id, true AS valid, false AS other_valid FROM (SELECT doc_id, sha256(source || chr(31) || doc_id) AS h FROM documents)",
    "url_tokens": "SELECT event_id, rtrim(replace(replace(base64(unhex(sha256(event_id::VARCHAR)[1:48])), '+', '-'), '/', '_'), '=') AS token FROM events",
    "first_text_blocks": "SELECT event_id, CASE WHEN event_id % 3 > 0 THEN 't' || event_id WHEN event_id % 2 > 0 THEN 'u' END AS text FROM events",
    "batched_vectors": "SELECT vec_id, i::INT AS position, 'chunk ' || i AS content, round(embedding[i + 1]::DOUBLE, 6) AS first FROM embeddings, range(3) r(i)",
    "upserted": "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'new' ELSE c_name END AS c_name FROM customer UNION ALL SELECT c_custkey + 10000000, c_name FROM customer WHERE c_custkey % 4 = 1",
    "answered_threads": r"""
SELECT conv_id, CASE WHEN t <> '' THEN sha256(t) END AS reply_sha, CASE WHEN t = '' THEN 'the reply is blank' END AS error FROM (
  SELECT conv_id, CASE WHEN conv_id % 9 > 0 THEN trim(regexp_replace(coalesce(arg_max(coalesce(text, ''), turn), ''), '\s+', ' ', 'g')) ELSE '' END AS t FROM conversations GROUP BY conv_id)
""",
    "provider_streams": "SELECT event_id, 'a' || event_id || CASE WHEN event_id % 3 > 0 THEN ' b' ELSE '' END AS reply, 3 AS n_lines, CASE WHEN event_id % 2 = 0 THEN event_id::VARCHAR END AS token FROM events",
    "vector_distances": "SELECT vec_id, round(1 - list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 4) AS distance FROM embeddings",
    "question_errors": """
SELECT c_custkey, array_to_string(list_filter([CASE WHEN c_custkey % 3 > 0 AND c_custkey * 11 % 1500 > 1000 THEN 'description is too long' END,
  CASE WHEN c_custkey % 5 = 0 THEN 'name is required' WHEN c_custkey % 150 + 1 > 100 THEN 'name is too long' END,
  CASE WHEN c_custkey % 7 = 0 THEN 'question must not be blank' WHEN c_custkey * 37 % 5000 + 1 > 4000 THEN 'question is too long' END], lambda x: x IS NOT NULL), '; ') AS errors FROM customer
""",
    "stored_blobs": "SELECT doc_id, source || '/' || sha256(coalesce(text, '')) AS storage_path, sha256(coalesce(text, '')) AS content_sha FROM documents",
    "ingested_documents": _UPLOADS + "SELECT doc_id, CASE WHEN kind = 'ok' THEN 'READY' ELSE 'FAILED' END AS status, CASE kind WHEN 'broken' THEN 'no UTF-8 text' WHEN 'blank' THEN 'No extractable text' END AS error_message, CASE kind WHEN 'ok' THEN len(string_split(text, chr(12)))::INT WHEN 'blank' THEN 2 END AS page_count FROM u WHERE kind <> 'gone'",
    "ingested_log": _UPLOADS
    + """, s AS (SELECT doc_id, unnest(CASE kind WHEN 'ok' THEN ['UPLOADED', 'EXTRACTING', 'CHUNKING', 'EMBEDDING', 'READY'] WHEN 'broken' THEN ['UPLOADED', 'EXTRACTING', 'FAILED'] ELSE ['UPLOADED', 'EXTRACTING', 'CHUNKING', 'FAILED'] END) AS state FROM u WHERE kind <> 'gone')
SELECT doc_id, CASE state WHEN 'UPLOADED' THEN 0 WHEN 'EXTRACTING' THEN 1 WHEN 'CHUNKING' THEN 2 WHEN 'EMBEDDING' THEN 3 WHEN 'READY' THEN 4 ELSE CASE WHEN doc_id % 13 = 0 THEN 2 ELSE 3 END END AS step, state FROM s""",
    "ingested_chunks": _UPLOADS
    + r""", w AS (SELECT doc_id, len(list_filter(string_split_regex(text, '[ \t\n\x0B\f\r]+'), lambda x: x <> '')) AS n FROM u WHERE kind = 'ok')
SELECT doc_id, greatest(0, ceil((n - 400) / 340.0))::BIGINT + 1 AS n_chunks, 8 * (greatest(0, ceil((n - 400) / 340.0))::BIGINT + 1) AS n_components FROM w WHERE n > 0""",
    "scoped_chunk_hits": r"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(text, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS ws FROM documents WHERE text IS NOT NULL AND doc_id % 5 > 0 AND source = (SELECT source FROM documents WHERE doc_id = 1)
), q AS (
  SELECT list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')[1:2]) AS q FROM documents WHERE doc_id = 1
), c AS (
  SELECT doc_id, ws, unnest(range(0, greatest(0, ceil((len(ws) - 400) / 340.0))::BIGINT + 1)) AS i FROM w WHERE len(ws) > 0
), t AS (
  SELECT doc_id, i, regexp_extract_all(lower(array_to_string(ws[i * 340 + 1:i * 340 + 400], ' ')), '[\p{L}\p{N}]+') AS t FROM c
), s AS (
  SELECT doc_id || '-' || i AS chunk_id, 'd' || doc_id || '.pdf' AS filename, round(len(list_filter(t, lambda x: list_contains(q, x))) / (1 + ln(len(t)::DOUBLE)), 6) AS score
  FROM t, q WHERE len(q) > 0 AND list_has_all(t, q)
)
SELECT chunk_id, filename, score, row_number() OVER (ORDER BY score DESC, chunk_id)::INT AS rank FROM s ORDER BY score DESC, chunk_id LIMIT 20
""",
    "replayed_batches": "SELECT doc_id, n_chars FROM documents",
}
