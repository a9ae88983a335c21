"""Queries over the driver's tables, which stand in for the library's, and the SQL that gives the same rows.

sources of `documents` are courses, lines of a text its pages, conversations the threads, `events` a log of states, and
orders of customers of nations memberships of courses of owners.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from folioscan.functions import text as tx, vectors
from folioscan.operators import access, chunking, grounding, library, retrieval
from folioscan.plans import lookups, records, stored
from folioscan.sources import providers, sse
from folioscan.streaming import ingest

TERMS = ["the", "and", "of"]


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return _t(spark, sf_dir, "embeddings").where("vec_id = 0").select("embedding").first()[0]  # one row


def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "embeddings")
    return retrieval.vector_search(rows, _query_vector(spark, sf_dir), "vec_id", scope=F.col("label") < 8, digits=4)


_VECTOR_SQL = """
SELECT vec_id, similarity, row_number() OVER (ORDER BY similarity DESC, vec_id)::INT AS rank FROM (
  SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 4) AS similarity
  FROM embeddings WHERE label < 8 AND embedding IS NOT NULL ORDER BY similarity DESC, vec_id LIMIT 20)
"""


def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents")
    return chunking.chunk_words(docs, chunking.split_pages(F.col("text")), "doc_id").select("doc_id", "chunk_index", F.sha2("content", 256).alias("content_sha"), "token_count")


_CHUNKS = r"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(text, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS ws FROM documents WHERE text IS NOT NULL
), c AS (
  SELECT doc_id, ws, unnest(range(0, greatest(0, ceil((len(ws) - 400) / 340.0))::BIGINT + 1)) AS i FROM w WHERE len(ws) > 0
), k AS (
  SELECT doc_id, i::INT AS chunk_index, array_to_string(ws[i * 340 + 1:i * 340 + 400], ' ') AS content FROM c
)
"""


def chunk_page_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents")
    return chunking.chunk_words(docs, chunking.split_pages(F.col("text")), "doc_id").select("doc_id", "chunk_index", "page_number")


_PAGES_SQL = r"""
WITH p AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS page FROM documents WHERE text IS NOT NULL
), w AS (
  SELECT doc_id, page, list_filter(string_split_regex(line, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS ws FROM p
), f AS (
  SELECT doc_id, page, sum(len(ws)) OVER (PARTITION BY doc_id ORDER BY page) AS upto, len(ws) AS n FROM w
), t AS (
  SELECT doc_id, sum(n) AS total FROM f GROUP BY doc_id
), c AS (
  SELECT doc_id, unnest(range(0, greatest(0, ceil((total - 400) / 340.0))::BIGINT + 1)) AS i FROM t WHERE total > 0
)
SELECT c.doc_id, c.i::INT AS chunk_index, min(f.page)::INT AS page_number FROM c JOIN f ON f.doc_id = c.doc_id AND f.upto > c.i * 340 GROUP BY c.doc_id, c.i
"""


def _text_hits(spark: SparkSession, sf_dir: str, terms: list[str] = TERMS) -> DataFrame:
    return retrieval.text_search(_t(spark, sf_dir, "documents"), terms, "doc_id", "text", F.col("lang") == "en")


def lexical_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text_hits(spark, sf_dir)


_LEXICAL = r"""
SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id)::INT AS rank FROM (
  SELECT doc_id, round(len(list_filter(t, lambda x: list_contains(['and', 'of', 'the'], x))) / (1 + ln(len(t)::DOUBLE)), 6) AS score
  FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS t FROM documents WHERE lang = 'en')
  WHERE len(list_intersect(['and', 'of', 'the'], t)) = 3 ORDER BY score DESC, doc_id LIMIT 20)
"""


def _two_lists(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Vectors stand for the embeddings of the documents with their ids."""
    rows = _t(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "doc_id")
    near = retrieval.vector_search(rows, _query_vector(spark, sf_dir), "doc_id", scope=F.col("label") < 8, digits=4)
    return near, _text_hits(spark, sf_dir)


def rrf_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.fuse(*_two_lists(spark, sf_dir), "doc_id")


_LISTS = f"WITH v AS (SELECT vec_id AS doc_id, similarity, rank FROM ({_VECTOR_SQL})), x AS ({_LEXICAL})"
_RRF_SQL = f"""{_LISTS}
SELECT doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score, max(similarity) AS similarity
FROM (SELECT doc_id, rank, similarity FROM v UNION ALL SELECT doc_id, rank, NULL FROM x) GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 6
"""


def retrieval_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.signals(*_two_lists(spark, sf_dir))


_SIGNALS_SQL = f"{_LISTS} SELECT (SELECT max(similarity) FROM v) AS top_similarity, (SELECT count(*) FROM x) AS lexical_hits"


def confidence_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 4).alias("n_fused"), F.when(F.col("event_id") % 5 == 0, 0.0).otherwise(0.25).alias("threshold"), F.when(F.col("event_id") % 7 > 0, F.col("event_id") % 50 / 100.0).alias("sim"), (F.col("event_id") % 3).alias("hits"))
    return e.select("event_id", retrieval.refuses(F.col("n_fused"), F.col("threshold"), F.col("sim"), F.col("hits")).alias("refuse"))


_GATE_SQL = """
SELECT event_id, n_fused = 0 OR coalesce(threshold > 0 AND sim IS NOT NULL AND sim < threshold AND hits = 0, false) AS refuse FROM (
  SELECT event_id, event_id % 4 AS n_fused, CASE WHEN event_id % 5 = 0 THEN 0.0 ELSE 0.25 END::DOUBLE AS threshold,
    CASE WHEN event_id % 7 > 0 THEN (event_id % 50)::DOUBLE / 100.0::DOUBLE END AS sim, event_id % 3 AS hits FROM events)
"""


def citation_snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", tx.snippet(F.col("text")).alias("snippet"))


_SNIPPET_SQL = r"""
SELECT doc_id, CASE WHEN length(t) <= 240 THEN t ELSE regexp_replace(substring(t, 1, 240), '\s+$', '') || '…' END AS snippet
FROM (SELECT doc_id, regexp_replace(regexp_replace(coalesce(text, ''), '^\s+', ''), '\s+$', '') AS t FROM documents)
"""


def thread_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", tx.thread_title(F.col("text")).alias("title"))


_TITLE_SQL = r"SELECT doc_id, substring(trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g')), 1, 200) AS title FROM documents"


def history_last_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = grounding.last_messages(_t(spark, sf_dir, "conversations"), "conv_id", ["turn"], 3)
    return kept.select("conv_id", "turn", "role", "position")


_HISTORY_SQL = """
SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INT AS position FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS late FROM conversations) WHERE late <= 3
"""


def prompt_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _t(spark, sf_dir, "conversations").select("conv_id", (F.col("turn") + 1).cast("int").alias("i"), F.concat(F.lit("thread-"), F.col("conv_id").cast("string"), F.lit(".pdf")).alias("filename"), F.when(F.col("turn") % 3 > 0, F.col("turn")).alias("page"), "text")
    return grounding.assemble_prompt(c, "conv_id", "i", "filename", "page", "text").select("conv_id", F.sha2("prompt", 256).alias("prompt_sha"), F.length("prompt").alias("n"))


_PROMPT_SQL = r"""
SELECT conv_id, sha256(prompt) AS prompt_sha, length(prompt)::INT AS n FROM (
  SELECT conv_id, string_agg('[' || (turn + 1) || '] (thread-' || conv_id || '.pdf' || CASE WHEN turn % 3 > 0 THEN ', p.' || turn ELSE '' END || ')' || chr(10)
    || regexp_replace(regexp_replace(coalesce(text, ''), '^\s+', ''), '\s+$', '') || chr(10) || chr(10), '' ORDER BY turn) AS prompt FROM conversations GROUP BY conv_id)
"""


def citation_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = _t(spark, sf_dir, "events").select("event_id", F.concat(F.lit("See ["), (F.col("event_id") % 4 + 1).cast("string"), F.lit("] and ["), (F.col("event_id") % 7 + 1).cast("string"), F.lit("].")).alias("answer"))
    sources = _t(spark, sf_dir, "events").select("event_id", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("index")).withColumn("source", F.concat(F.lit("s"), F.col("index").cast("string")))
    return grounding.cited(answers, sources, "event_id", "answer", "index")


_MARKERS_SQL = """
SELECT event_id, (event_id % 4 + 1)::INT AS marker, 0 AS position, 's' || (event_id % 4 + 1) AS source FROM events UNION ALL
SELECT event_id, (event_id % 7 + 1)::INT, 1, CASE WHEN event_id % 7 + 1 <= 5 THEN 's' || (event_id % 7 + 1) END FROM events
"""


def dedup_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents").select("doc_id", "source", F.sha2("text", 256).alias("sha256"))
    return library.dedup_uploads(docs, "source", "sha256", ["doc_id"])


_DEDUP_SQL = """
SELECT doc_id, source, sha256(text) AS sha256, min(doc_id) OVER (PARTITION BY source, sha256(text)) AS kept_doc_id,
  doc_id = min(doc_id) OVER (PARTITION BY source, sha256(text)) AS created FROM documents
"""


def content_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents")
    name = F.concat(F.lit(" /up/"), F.col("source"), F.when(F.col("doc_id") % 9 > 0, F.concat(F.lit("/d"), F.col("doc_id").cast("string"), F.lit(".pdf "))).otherwise("/ "))
    size, kind = F.when(F.col("doc_id") % 11 > 0, F.col("n_chars") * 100).otherwise(0), F.when(F.col("doc_id") % 7 > 0, "Application/PDF").otherwise("text/plain")
    return docs.select("doc_id", library.content_path(F.col("source"), F.sha2("text", 256)).alias("path"), tx.file_name(name).alias("filename"), library.valid_upload(size, kind).alias("rejected"), tx.token_estimate(F.col("text")).alias("tokens"))


_ADDRESS_SQL = """
SELECT doc_id, source || '/' || sha256(text) AS path, CASE WHEN doc_id % 9 > 0 THEN 'd' || doc_id || '.pdf' ELSE 'document.pdf' END AS filename,
  CASE WHEN doc_id % 11 = 0 OR n_chars = 0 THEN 400 WHEN doc_id % 7 = 0 THEN 415 END AS rejected, ceil(length(text) / 4.0)::INT AS tokens FROM documents
"""


def _listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "orders").where("o_orderstatus = 'O'")


def paged_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.page(_listing(spark, sf_dir).select("o_orderkey", "o_custkey"), [F.col("o_orderkey").desc()], 2, 20)


_LISTING_SQL = "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderkey DESC LIMIT 20 OFFSET 40"


def paged_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.page_totals(_listing(spark, sf_dir))


_COUNT_SQL = "SELECT count(*) AS total_elements, ceil(count(*) / 20.0)::BIGINT AS total_pages FROM orders WHERE o_orderstatus = 'O'"


def membership_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c, n = _t(spark, sf_dir, "orders"), _t(spark, sf_dir, "customer"), _t(spark, sf_dir, "nation")
    joined = o.where("o_orderpriority LIKE '1%'").join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    return joined.groupBy("n_name", "c_mktsegment").agg(F.count(F.lit(1)).alias("n_members"), F.countDistinct("c_custkey").alias("n_courses"))


_MEMBERS_SQL = """
SELECT n_name, c_mktsegment, count(*) AS n_members, count(DISTINCT c_custkey) AS n_courses
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderpriority LIKE '1%' GROUP BY ALL
"""


def access_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events")
    asked = e.select("event_id", "user_id", (F.col("event_id") % 200).alias("course"))
    held = e.where("event_id % 3 = 0").select("user_id", (F.col("event_id") % 200).alias("course"))
    there = e.where("event_id % 200 < 150").select((F.col("event_id") % 200).alias("course"))
    return access.access_state(asked, held, there, "user_id", "course").select("event_id", "status")


_ACCESS_SQL = """
WITH m AS (SELECT DISTINCT user_id, event_id % 200 AS course FROM events WHERE event_id % 3 = 0), k AS (SELECT DISTINCT event_id % 200 AS course FROM events WHERE event_id % 200 < 150)
SELECT e.event_id, CASE WHEN m.course IS NOT NULL THEN 200 WHEN k.course IS NOT NULL THEN 403 ELSE 404 END AS status
FROM events e LEFT JOIN m ON m.user_id = e.user_id AND m.course = e.event_id % 200 LEFT JOIN k ON k.course = e.event_id % 200
"""


def invite_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, now = _t(spark, sf_dir, "events"), F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    bound = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("User"), (F.col("user_id") % 3).cast("string"), F.lit("@Example.com")))
    state = access.invite_state(F.col("event_id") % 11 > 0, F.col("event_id") % 5 == 0, F.when(F.col("event_id") % 3 > 0, F.col("ts").cast("timestamp_ntz")), bound, F.lit("user1@example.com"), now)
    return e.select("event_id", state.alias("state"), access.may_grant(F.when(F.col("event_id") % 3 == 0, "OWNER").when(F.col("event_id") % 3 == 1, "INSTRUCTOR").otherwise("MEMBER"), F.when(F.col("event_id") % 2 == 0, "MEMBER").otherwise("INSTRUCTOR")).alias("grantable"))


_INVITE_SQL = """
SELECT event_id, CASE WHEN event_id % 11 = 0 OR event_id % 5 = 0 THEN 404 WHEN event_id % 3 > 0 AND ts < TIMESTAMP '2024-01-15 00:00:00' THEN 410
  WHEN event_id % 4 = 0 AND user_id % 3 <> 1 THEN 403 ELSE 200 END AS state,
  CASE WHEN event_id % 2 = 1 THEN event_id % 3 = 0 ELSE event_id % 3 <> 2 END AS grantable FROM events
"""


def invite_accept(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events")
    asked = e.select("user_id", (F.col("event_id") % 40).alias("course"), F.lit("MEMBER").alias("role"))
    held = e.where("event_id % 10 = 0").select("user_id", (F.col("event_id") % 40).alias("course"), F.lit("OWNER").alias("role")).distinct()
    return access.accept_invites(asked, held, "user_id", "course", "role")


_ACCEPT_SQL = """
WITH m AS (SELECT DISTINCT user_id, event_id % 40 AS course FROM events WHERE event_id % 10 = 0)
SELECT DISTINCT e.user_id, e.event_id % 40 AS course, CASE WHEN m.course IS NULL THEN 'MEMBER' ELSE 'OWNER' END AS held_role, m.course IS NULL AS joined
FROM events e LEFT JOIN m ON m.user_id = e.user_id AND m.course = e.event_id % 40
"""


def field_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioscan.plans.schema import register_rules

    c = _t(spark, sf_dir, "customer")
    address = F.when(F.col("c_custkey") % 3 > 0, F.concat(F.lit("a"), F.col("c_custkey").cast("string"), F.lit("@x.org"))).when(F.col("c_custkey") % 2 > 0, "not-an-email").otherwise(" ")
    found = access.errors(register_rules(address, F.repeat(F.lit("p"), (F.col("c_custkey") % 12).cast("int")), F.when(F.col("c_custkey") % 5 > 0, F.col("c_name"))))
    return c.select("c_custkey", F.array_join(F.transform(F.array_sort(F.map_entries(found)), lambda x: F.concat(x["key"], F.lit(" "), x["value"])), "; ").alias("errors"))


_ERRORS_SQL = """
SELECT c_custkey, array_to_string(list_filter([CASE WHEN c_custkey % 5 = 0 THEN 'displayName is required' END,
  CASE WHEN c_custkey % 3 > 0 THEN NULL WHEN c_custkey % 2 > 0 THEN 'email is no address' ELSE 'email is required' END,
  CASE WHEN c_custkey % 12 < 8 THEN 'password must have 8 to 72 characters' END], lambda x: x IS NOT NULL), '; ') AS errors FROM customer
"""


def doc_latest_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.latest(_t(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], ["event_type", "event_id"])


_STATUS_SQL = "SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id"


def replace_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    fresh = lines.where("l_orderkey % 10 = 0 AND l_linenumber = 1").withColumn("l_quantity", F.lit(0.0))
    out = library.replace_children(lines, fresh, "l_orderkey")
    return out.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"))


_REPLACE_SQL = """
SELECT l_orderkey, count(*) AS n, sum(q) AS quantity FROM (
  SELECT l_orderkey, l_quantity AS q FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_orderkey % 10 = 0 AND l_linenumber = 1)
  UNION ALL SELECT l_orderkey, 0.0 FROM lineitem WHERE l_orderkey % 10 = 0 AND l_linenumber = 1) GROUP BY l_orderkey
"""


def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = _t(spark, sf_dir, "customer"), _t(spark, sf_dir, "orders")
    kept, orders = library.cascade_delete(c, c.where("c_acctbal < 0"), "c_custkey", (o, "o_custkey"))
    return kept.select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id")).unionByName(orders.select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id")))


_CASCADE_SQL = """
SELECT 'customer' AS kind, c_custkey AS id FROM customer WHERE NOT coalesce(c_acctbal < 0, false) UNION ALL
SELECT 'order', o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)
"""


def constraint_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, orders = _t(spark, sf_dir, "lineitem"), _t(spark, sf_dir, "orders").where("o_orderkey % 100 > 0")
    twice = library.duplicate_keys(lines, "l_partkey", "l_suppkey").select(F.lit("duplicate").alias("kind"), F.col("l_partkey").alias("id"), "n")
    lost = library.orphans(lines, "l_orderkey", orders, "o_orderkey").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n")).select(F.lit("orphan").alias("kind"), F.col("l_orderkey").alias("id"), "n")
    return twice.unionByName(lost)


_CONSTRAINT_SQL = """
SELECT 'duplicate' AS kind, l_partkey AS id, count(*) AS n FROM lineitem GROUP BY l_partkey, l_suppkey HAVING count(*) > 1 UNION ALL
SELECT 'orphan', l_orderkey, count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 100 > 0) GROUP BY l_orderkey
"""


def matryoshka_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "embeddings").select("vec_id", vectors.fit(F.col("embedding"), 32).alias("v"))
    return e.select("vec_id", F.size("v").alias("dim"), F.round(F.col("v")[0], 4).alias("first"), F.round(vectors.norm(F.col("v")), 4).alias("norm"))


_FIT_SQL = """
SELECT vec_id, 32 AS dim, round((v[1] / n)::FLOAT, 4) AS first, round(sqrt(list_sum(list_transform(v, lambda x: ((x / n)::FLOAT)::DOUBLE * ((x / n)::FLOAT)::DOUBLE))), 4) AS norm
FROM (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM (SELECT vec_id, embedding[1:32]::DOUBLE[] AS v FROM embeddings))
"""


def vector_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.posexplode(vectors.parse(vectors.literal(F.col("embedding")))).alias("i", "x")).select("vec_id", "i", F.round(F.col("x").cast("double"), 6).alias("x"))


_LITERAL_SQL = "SELECT vec_id, (generate_subscripts(embedding, 1) - 1)::INT AS i, round(unnest(embedding)::DOUBLE, 6) AS x FROM embeddings"


def embedding_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, lab = _t(spark, sf_dir, "documents"), _t(spark, sf_dir, "labels").select(F.col("doc_id").alias("k"), "quality")
    return d.join(lab, d.doc_id == lab.k, "left").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count("quality").alias("n_embedded"), F.bool_or(F.col("quality").isNull()).alias("in_flight"))


_COVERAGE_SQL = "SELECT source, count(*) AS n, count(quality) AS n_embedded, bool_or(quality IS NULL) AS in_flight FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source"


def sse_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers sent as events, put on the wire, parsed and folded again."""
    said = _t(spark, sf_dir, "conversations").where("role = 'assistant'").select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.translate("text", "\n\r", "  ").alias("text"))
    sent = sse.emit(said, "id", "text")
    wire = sent.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "event", "data"))), lambda e: F.concat(F.lit("event: "), e["event"], F.lit("\ndata: "), e["data"], F.lit("\n\n"))), "").alias("wire"))
    folded = wire.select("id", sse.fold_events(sse.parse_events(F.col("wire"))).alias("f"))
    return folded.select("id", F.sha2("f.text", 256).alias("text_sha"), F.col("f.state").alias("state"))


_SSE_SQL = "SELECT conv_id || '-' || turn AS id, sha256(translate(text, chr(10) || chr(13), '  ')) AS text_sha, 'done' AS state FROM conversations WHERE role = 'assistant'"


def provider_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = _t(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 6 == 0, '{"type": bad').when(F.col("event_id") % 5 == 0, '{"type":"message-end"}').otherwise(F.concat(F.lit('{"type":"content-delta","delta":{"message":{"content":{"text":"t'), F.col("event_id").cast("string"), F.lit('"}}}}'))).alias("line"))
    return said.select("event_id", sse.delta_text(F.col("line")).alias("delta"))


_DELTA_SQL = "SELECT event_id, CASE WHEN event_id % 6 = 0 OR event_id % 5 = 0 THEN NULL ELSE 't' || event_id END AS delta FROM events"


def stub_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = providers.embed(_t(spark, sf_dir, "documents").select("doc_id", "text"), "text", providers.StubEmbedder(dim=16))
    return docs.select("doc_id", F.posexplode("embedding").alias("i", "x")).select("doc_id", "i", F.round(F.col("x").cast("double"), 6).alias("x"))


_STUB_SQL = "SELECT doc_id, i::INT AS i, round(0.001 * ((length(text) + i) % 7 + 1), 6)::DOUBLE AS x FROM documents, range(16) r(i)"


def display_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events")
    url = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("https://x.org/invite/tok"), F.col("event_id").cast("string"), F.lit("?a=1"))).otherwise(F.concat(F.lit(" tok"), F.col("event_id").cast("string"), F.lit(" ")))
    return e.select(
        "event_id", tx.byte_size(F.col("event_id") * 997).alias("size"), tx.invite_token(url).alias("token"), vectors.supported_dimension((F.col("event_id") % 2000).cast("int")).alias("dim"), tx.error_message(F.when(F.col("event_id") % 2 == 0, F.repeat(F.lit("e"), (F.col("event_id") % 700).cast("int")))).alias("error"), tx.email(F.when(F.col("event_id") % 3 == 0, "  ").otherwise(F.lit(" A@B.org "))).alias("email")
    )


_DISPLAY_SQL = """
SELECT event_id, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN round(n / 1024.0)::BIGINT || ' KB' ELSE round(n / 1048576.0, 1)::DECIMAL(18, 1) || ' MB' END AS size,
  'tok' || event_id AS token, CASE WHEN event_id % 2000 <= 256 THEN 256 WHEN event_id % 2000 <= 512 THEN 512 WHEN event_id % 2000 <= 1024 THEN 1024 ELSE 1536 END AS dim,
  CASE WHEN event_id % 2 = 0 THEN substring(repeat('e', (event_id % 700)::INT), 1, 500) ELSE 'Ingestion failed.' END AS error, CASE WHEN event_id % 3 > 0 THEN 'a@b.org' END AS email
FROM (SELECT event_id, event_id * 997 AS n FROM events)
"""


def status_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploads as a stream, their states as a log, and the latest of each."""
    path = f"{sf_dir}/documents.parquet"
    schema = spark.read.parquet(path).schema
    # a source that is one file is watched by its name in its folder; of a folder, all its files
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    one = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(hadoop).isFile()
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4)
    stream = reader.option("pathGlobFilter", "documents.parquet").parquet(sf_dir) if one else reader.parquet(path)
    log = ingest.state_log(stream.select("doc_id", F.size(tx.tokens(F.col("text"))).alias("n_words")), "doc_id", "n_words")
    return ingest.to_table(ingest.latest_states(log, "doc_id"), "doc_id")


_STATES_SQL = r"SELECT doc_id, CASE WHEN regexp_matches(text, '[^ \t\n\x0B\f\r]') THEN 4 ELSE 3 END AS step, CASE WHEN regexp_matches(text, '[^ \t\n\x0B\f\r]') THEN 'READY' ELSE 'FAILED' END AS state FROM documents"


def chunk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents")
    chunks = chunking.chunk_words(docs, chunking.split_pages(F.col("text")), "doc_id")
    return chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.max("page_number").alias("last_page"))


_CHUNK_COUNT_SQL = f"SELECT doc_id, count(*) AS n_chunks, max(page_number) AS last_page FROM ({_PAGES_SQL}) GROUP BY doc_id"


def vector_topk_by_course(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same search in each scope at once: three nearest rows of each label."""
    e, q = _t(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir)
    sim = F.round(vectors.cosine_similarity(F.col("embedding"), F.lit([float(x) for x in q])), 4)
    top = Window.partitionBy("label").orderBy(F.col("similarity").desc(), "vec_id")
    return e.select("label", "vec_id", sim.alias("similarity")).withColumn("rank", F.row_number().over(top)).where("rank <= 3")


_BY_COURSE_SQL = """
SELECT label, vec_id, similarity, rank FROM (SELECT label, vec_id, similarity, row_number() OVER (PARTITION BY label ORDER BY similarity DESC, vec_id)::INT AS rank FROM (
  SELECT label, vec_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 4) AS similarity FROM embeddings)) WHERE rank <= 3
"""

QUERIES = {
    f.__name__: f
    for f in (
        vector_topk, vector_topk_by_course, chunk_documents, chunk_page_attribution, chunk_counts, lexical_topk, rrf_hybrid, retrieval_signals, confidence_gate, citation_snippet, thread_title, history_last_n, prompt_assembly, citation_markers,
        dedup_documents, content_addresses, paged_listing, paged_count, membership_join, access_classification, invite_state, invite_accept, field_errors, doc_latest_status, replace_chunks, cascade_delete, constraint_violations,
        matryoshka_fit, vector_literal, embedding_coverage, sse_fold, provider_deltas, stub_embeddings, display_forms, status_stream,
    )
} | records.QUERIES | stored.QUERIES | lookups.QUERIES

ORACLE_SQL = {
    "vector_topk": _VECTOR_SQL,
    "vector_topk_by_course": _BY_COURSE_SQL,
    "chunk_documents": _CHUNKS + "SELECT doc_id, chunk_index, sha256(content) AS content_sha, ceil(length(content) / 4.0)::INT AS token_count FROM k",
    "chunk_page_attribution": _PAGES_SQL,
    "chunk_counts": _CHUNK_COUNT_SQL,
    "lexical_topk": _LEXICAL,
    "rrf_hybrid": _RRF_SQL,
    "retrieval_signals": _SIGNALS_SQL,
    "confidence_gate": _GATE_SQL,
    "citation_snippet": _SNIPPET_SQL,
    "thread_title": _TITLE_SQL,
    "history_last_n": _HISTORY_SQL,
    "prompt_assembly": _PROMPT_SQL,
    "citation_markers": _MARKERS_SQL,
    "dedup_documents": _DEDUP_SQL,
    "content_addresses": _ADDRESS_SQL,
    "paged_listing": _LISTING_SQL,
    "paged_count": _COUNT_SQL,
    "membership_join": _MEMBERS_SQL,
    "access_classification": _ACCESS_SQL,
    "invite_state": _INVITE_SQL,
    "invite_accept": _ACCEPT_SQL,
    "field_errors": _ERRORS_SQL,
    "doc_latest_status": _STATUS_SQL,
    "replace_chunks": _REPLACE_SQL,
    "cascade_delete": _CASCADE_SQL,
    "constraint_violations": _CONSTRAINT_SQL,
    "matryoshka_fit": _FIT_SQL,
    "vector_literal": _LITERAL_SQL,
    "embedding_coverage": _COVERAGE_SQL,
    "sse_fold": _SSE_SQL,
    "provider_deltas": _DELTA_SQL,
    "stub_embeddings": _STUB_SQL,
    "display_forms": _DISPLAY_SQL,
    "status_stream": _STATES_SQL,
    **records.ORACLE_SQL,
    **stored.ORACLE_SQL,
    **lookups.ORACLE_SQL,
    "indexed_topk": _LEXICAL,
    "exchanged_children": _REPLACE_SQL,
}
