"""Hand-computed cases of the retrieval library."""

import math

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from folioscan.functions import english, text as tx, vectors
from folioscan.operators import access, chunking, grounding, ingestion, library, postings, retrieval
from folioscan.plans import schema
from folioscan.sources import pages, providers, sse, tables
from folioscan.streaming import ingest


def column(spark, values, kind, *exprs):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [tuple(r)[1:] for r in df.select("i", *exprs).orderBy("i").collect()]


@pytest.mark.parametrize(("n", "chunks"), [(0, 0), (1, 1), (400, 1), (401, 2), (740, 2), (741, 3)])
def test_chunk_counts(spark, n, chunks):
    words = [f"w{i}" for i in range(n)]
    docs = spark.createDataFrame([(1, "  ".join(words))], "k int, text string")
    rows = chunking.chunk_words(docs, chunking.split_pages(F.col("text")), "k").orderBy("chunk_index").collect()
    assert [r["content"].split() for r in rows] == [words[340 * i : 340 * i + 400] for i in range(chunks)]


def test_chunk_pages(spark):
    docs = spark.createDataFrame([(1, "\n" + "a " * 339 + "\n" + "b " * 300), (2, None), (3, " \t ")], "k int, text string")
    rows = chunking.chunk_words(docs, chunking.split_pages(F.col("text")), "k").orderBy("chunk_index").collect()
    assert [(r["k"], r["page_number"]) for r in rows] == [(1, 2), (1, 3)]


def test_text_functions(spark):
    x = F.col("x")
    long = "a" * 239 + " bc"
    assert column(spark, [None, " x ", "a" * 240, "a" * 241, long], "string", tx.snippet(x)) == [("",), ("x",), ("a" * 240,), ("a" * 240 + "…",), ("a" * 239 + "…",)]
    assert column(spark, ["  a \n b\t", "x" * 201], "string", tx.thread_title(x)) == [("a b",), ("x" * 200,)]
    assert column(spark, ["", "abcd", "abcde", "😀😀😀"], "string", tx.token_estimate(x)) == [(0,), (1,), (2,), (2,)]
    assert column(spark, ["/a/b c.pdf ", "C:\\x\\y.pdf", " ", None, "/"], "string", tx.file_name(x)) == [("b c.pdf",), ("y.pdf",), ("document.pdf",)] * 1 + [("document.pdf",)] * 2
    assert column(spark, ["see [1] and [12][x]", "none"], "string", tx.markers(x)) == [([1, 12],), ([],)]
    assert column(spark, ["tok", " https://a.b/invite/tok?x=1 ", "https://a.b/invites/tok#f"], "string", tx.invite_token(x)) == [("tok",)] * 3
    assert column(spark, [1, 2048, 5 * 1024 * 1024 + 300_000], "long", tx.byte_size(x)) == [("1 B",), ("2 KB",), ("5.3 MB",)]
    assert column(spark, [b"\xff\xfe\xfd", b"a"], "binary", tx.url_token(x)) == [("__79",), ("YQ",)]
    assert column(spark, [None, "e" * 501], "string", tx.error_message(x)) == [("Ingestion failed.",), ("e" * 500,)]
    assert column(spark, [" A@B ", " ", None], "string", tx.email(x)) == [("a@b",), (None,), (None,)]
    head = tx.source_header(F.col("i"), F.lit("f"), x)
    assert column(spark, [3, None], "int", head) == [("[0] (f, p.3)",), ("[1] (f)",)]


def test_stemmer():
    want = {"caresses": "caress", "ponies": "poni", "cats": "cat", "agreed": "agre", "plastered": "plaster", "hopping": "hop", "filing": "file", "happy": "happi", "relational": "relat", "vietnamization": "vietnam", "triplicate": "triplic", "adjustment": "adjust", "probate": "probat", "controll": "control", "sky": "sky"}
    assert {w: english.stem(w) for w in want} == want
    assert english.analyse("The cats are hopping") == ["cat", "hop"] and english.analyse(None) == []


def test_vectors(spark):
    x = F.col("x")
    assert column(spark, [[3.0, 4.0], [0.0, 0.0], None, [1.0]], "array<float>", vectors.cosine_similarity(x, F.array(F.lit(1.0), F.lit(0.0)))) == [(pytest.approx(0.6),), (None,), (None,), (None,)]
    assert column(spark, [[3.0, 4.0, 9.0], [3.0, 4.0], [0.0, 0.0, 1.0]], "array<float>", vectors.fit(x, 2)) == [([pytest.approx(0.6), pytest.approx(0.8)],), ([3.0, 4.0],), ([0.0, 0.0],)]
    with pytest.raises(Exception, match="fewer than 2"):
        column(spark, [[1.0]], "array<float>", vectors.fit(x, 2))
    assert column(spark, [1, 256, 257, 9999], "int", vectors.supported_dimension(x)) == [(256,), (256,), (512,), (1536,)]
    assert column(spark, [[1.5, -2.0]], "array<float>", vectors.parse(vectors.literal(x))) == [([1.5, -2.0],)]


def test_search_and_fusion(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0], "ok"), (2, [1.0, 0.0], "ok"), (3, [0.0, 1.0], "ok"), (4, None, "ok"), (5, [1.0, 0.0], "no"), (6, [0.0, 0.0], "ok")], "k int, embedding array<float>, status string")
    near = retrieval.vector_search(rows, [1.0, 0.0], "k", scope=F.col("status") == "ok")
    assert [(r["k"], r["rank"]) for r in near.orderBy("rank").collect()] == [(1, 1), (2, 2), (3, 3)]
    texts = spark.createDataFrame([(1, "b a a"), (2, "a"), (3, "B, A!"), (4, None)], "k int, t string")
    hits = retrieval.text_search(texts, ["a", "b"], "k", "t")
    assert [r["k"] for r in hits.orderBy("rank").collect()] == [1, 3]
    assert retrieval.text_search(texts, [], "k", "t").count() == 0
    fused = retrieval.fuse(near, hits, "k", 2).collect()
    assert [(r["k"], r["score"], r["similarity"]) for r in fused] == [(1, pytest.approx(2 / 61), 1.0), (3, pytest.approx(1 / 63 + 1 / 62), 0.0)]
    assert tuple(retrieval.signals(near, hits).first()) == (1.0, 2)
    assert tuple(retrieval.signals(near.limit(0), hits.limit(0)).first()) == (None, 0)
    assert [retrieval.result_limit(k) for k in (None, 0, -1, 5, 20, 21)] == [6, 6, 6, 5, 20, 20]


def test_gate(spark):
    rows = [(0, 0.25, 0.9, 3, True), (1, 0.0, 0.1, 0, False), (1, 0.25, None, 0, False), (1, 0.25, 0.2, 0, True), (1, 0.25, 0.2, 1, False), (1, 0.25, 0.25, 0, False)]
    df = spark.createDataFrame(rows, "n int, t double, s double, h int, want boolean")
    assert all(r["want"] == r["got"] for r in df.select("want", retrieval.refuses(F.col("n"), F.col("t"), F.col("s"), F.col("h")).alias("got")).collect())


@pytest.mark.parametrize("n", [9, 10, 11])
def test_history(spark, n):
    m = spark.createDataFrame([(1, i) for i in range(n)], "c int, at int")
    rows = grounding.last_messages(m, "c", ["at"]).orderBy("position").collect()
    assert [r["at"] for r in rows] == list(range(n))[-10:] and [r["position"] for r in rows] == list(range(1, min(n, 10) + 1))


def test_prompt_and_citations(spark):
    s = spark.createDataFrame([(1, 2, "b.pdf", None, " two "), (1, 1, "a.pdf", 7, "one")], "g int, i int, f string, p int, c string")
    assert grounding.assemble_prompt(s, "g", "i", "f", "p", "c").first()["prompt"] == "[1] (a.pdf, p.7)\none\n\n[2] (b.pdf)\ntwo\n\n"
    answers = spark.createDataFrame([(1, "x [2] [9]")], "g int, a string")
    got = grounding.cited(answers, s.select("g", "i", "f"), "g", "a", "i").orderBy("position").collect()
    assert [(r["marker"], r["f"]) for r in got] == [(2, "b.pdf"), (9, None)]
    assert [r["citation_index"] for r in grounding.citations(s, [F.col("i")], "c").orderBy("i").collect()] == [1, 2]


def test_access(spark):
    asked = spark.createDataFrame([("u", "a"), ("u", "b"), ("u", "z")], "user string, course string")
    held = spark.createDataFrame([("u", "a", "OWNER")], "user string, course string, role string")
    courses = spark.createDataFrame([("a",), ("b",)], "course string")
    assert {r["course"]: r["status"] for r in access.access_state(asked, held, courses, "user", "course").collect()} == {"a": 200, "b": 403, "z": 404}
    wanted = asked.withColumn("role", F.lit("MEMBER")).union(asked.withColumn("role", F.lit("MEMBER")))
    got = {r["course"]: (r["held_role"], r["joined"]) for r in access.accept_invites(wanted, held, "user", "course", "role").collect()}
    assert got == {"a": ("OWNER", False), "b": ("MEMBER", True), "z": ("MEMBER", True)}
    rows = [(False, False, None, None, 404), (True, True, 1, None, 404), (True, False, 1, "B@x", 410), (True, False, 9, "B@x", 403), (True, False, 5, "A@X", 200), (True, False, None, None, 200)]
    df = spark.createDataFrame(rows, "f boolean, r boolean, e int, m string, want int")
    state = access.invite_state(F.col("f"), F.col("r"), F.col("e"), F.col("m"), F.lit("a@x"), F.lit(5))
    assert all(r["want"] == r["got"] for r in df.select("want", state.alias("got")).collect())
    pages_ = access.page_totals(spark.range(41)).first()
    assert tuple(pages_) == (41, 3) and [r["id"] for r in access.page(spark.range(41), [F.col("id")], 2, 20).collect()] == [40]
    rules = schema.register_rules(F.col("e"), F.col("p"), F.col("n"))
    bad = spark.createDataFrame([("not-an-email", "short", " "), ("a@b.c", "longenough", "N"), (None, None, None)], "e string, p string, n string").select(access.errors(rules).alias("m")).collect()
    assert [set(r["m"]) for r in bad] == [{"email", "password", "displayName"}, set(), {"email", "password", "displayName"}]


def test_library(spark):
    up = spark.createDataFrame([("c", "s1", 1), ("c", "s1", 2), ("d", "s1", 3)], "course string, sha string, at int")
    got = {r["at"]: (r["kept_at"], r["created"]) for r in library.dedup_uploads(up, "course", "sha", ["at"]).collect()}
    assert got == {1: (1, True), 2: (1, False), 3: (3, True)}
    states = spark.createDataFrame([(s,) for s in (*library.STATES, "FAILED")], "s string").select(library.advance(F.col("s"))).collect()
    assert [r[0] for r in states] == [*library.STATES[1:], "READY", "FAILED"]
    chunks = spark.createDataFrame([(1, "a"), (2, "b")], "doc int, c string")
    fresh = spark.createDataFrame([(1, "n")], "doc int, c string")
    once = library.replace_children(chunks, fresh, "doc")
    assert sorted(map(tuple, library.replace_children(once, fresh, "doc").collect())) == sorted(map(tuple, once.collect())) == [(1, "n"), (2, "b")]
    zipped = spark.createDataFrame([(1, ["a", "b"], [[1.0], [2.0]])], "k int, t array<string>, v array<array<float>>")
    assert [tuple(r) for r in library.zip_positions(zipped, "t", "v").collect()] == [(1, 0, "a", [1.0]), (1, 1, "b", [2.0])]
    with pytest.raises(Exception, match="as many vectors"):
        library.zip_positions(zipped.withColumn("t", F.array(F.lit("a"))), "t", "v").collect()
    sizes = spark.createDataFrame([(0, "application/pdf"), (1, "text/plain"), (1, "Application/PDF"), (1, None)], "n int, t string")
    assert [r[0] for r in sizes.select(library.valid_upload(F.col("n"), F.col("t"))).collect()] == [400, 415, None, 415]


def test_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"one\ftwo")
    (tmp_path / "b.txt").write_bytes(b"\xff\xfe")
    (tmp_path / "c.txt").write_bytes(b" \n")
    rows = {r["path"][-5:]: r for r in pages.extract_pages(pages.read_files(spark, str(tmp_path)), "text/plain").collect()}
    assert [(p["page"], p["text"]) for p in rows["a.txt"]["pages"]] == [(1, "one"), (2, "two")]
    assert rows["b.txt"]["error"] == "no UTF-8 text" and rows["c.txt"]["error"] == "No extractable text"
    wire = "event: meta\r\ndata: {}\r\n\r\nevent: delta\ndata: a\ndata: b\n\n: note\n\ndata: x\n\nevent: delta\ndata: c\n\nevent: error\ndata: bad\n\nevent: delta\ndata: late\n\n"
    df = spark.createDataFrame([(wire,)], "w string").select(sse.parse_events(F.col("w")).alias("e"))
    assert [tuple(e) for e in df.first()["e"]][:3] == [("meta", "{}"), ("delta", "a\nb"), ("message", "x")]
    assert tuple(df.select(sse.fold_events(F.col("e")).alias("f")).first()["f"]) == ("a\nbc", "failed", "bad")
    blocks = spark.createDataFrame([([("image", "x"), ("text", None), ("text", "yes")],)], "c array<struct<type:string,text:string>>")
    assert blocks.select(sse.first_text(F.col("c"))).first()[0] == "yes"
    texts = spark.createDataFrame([("abc",), (None,)], "t string")
    got = providers.embed(texts, "t", providers.StubEmbedder(dim=3, batch=1)).collect()
    assert got[0]["embedding"] == [pytest.approx(0.001 * x) for x in (4, 5, 6)]
    assert providers.embed(texts, "t", providers.embedder("none")).first()["embedding"] is None
    assert providers.embedder("unknown") is providers.EMBEDDERS["stub"] and providers.REPLIERS["echo"].complete(["a", " b "]) == "b"


def test_streams(spark, tmp_path):
    up = spark.createDataFrame([(1, "c", "s", 3), (2, "c", "s", 0), (3, "d", "s", 5)], "k long, course string, sha string, n int").withColumn("at", F.timestamp_seconds(F.col("k") * 60))
    up.repartition(3).write.parquet(str(tmp_path / "up"))
    stream = ingest.read_stream(spark, str(tmp_path / "up"), up.schema)
    latest = {r["k"]: r["state"] for r in ingest.to_memory(ingest.latest_states(ingest.state_log(stream, "k", "n"), "k"), "t_states", "complete").collect()}
    assert latest == {1: "READY", 2: "FAILED", 3: "READY"}
    assert ingest.to_memory(ingest.first_uploads(stream, "course", "sha", "at"), "t_first").count() == 2
    assert {r["n"] for r in ingest.to_memory(ingest.windowed_counts(stream, "at", "course"), "t_windows", "complete").collect()} == {1, 2}
    query = ingest.append_once(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_latest_states_stay_off_the_driver(spark, tmp_path):
    """One file a batch, and a key that three batches change; the sink is a table in the shared folder."""
    for rows in ([[(1, 0, "A"), (2, 0, "A")], [(1, 4, "C"), (None, 1, "N")], [(1, 2, "B")]]):
        spark.createDataFrame(rows, "k long, step int, state string").coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    schema_ = "k long, step int, state string"
    stream = ingest.read_stream(spark, str(tmp_path / "log"), schema_, 1)
    out = ingest.to_table(ingest.latest_states(stream, "k"), "k")
    assert {tuple(r) for r in out.collect()} == {(1, 4, "C"), (2, 0, "A"), (None, 1, "N")} and out.columns == ["k", "step", "state"]
    shared = spark.conf.get("spark.checkpoint.dir")
    assert out.inputFiles() and all(shared.removeprefix("file://") in f for f in out.inputFiles())
    (tmp_path / "none").mkdir()
    assert ingest.to_table(ingest.latest_states(ingest.read_stream(spark, str(tmp_path / "none"), schema_), "k"), "k").count() == 0


def test_status_stream_does_not_use_the_memory_sink(spark, tmp_path):
    spark.createDataFrame([(1, "a b"), (2, " ")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    out = entry.queries()["status_stream"](spark, str(tmp_path))
    assert out.inputFiles() and {tuple(r) for r in out.collect()} == {(1, 4, "READY"), (2, 3, "FAILED")}


def test_schema():
    for name in schema.TABLES:
        assert schema.schema(name).fieldNames()[0] == "id"
    assert set(schema.UNIQUE) <= set(schema.TABLES)


def test_children_are_exchanged_in_place(spark, tmp_path):
    path = str(tmp_path / "children")
    old = spark.createDataFrame([(i % 9, i, "old") for i in range(60)], "doc string, i int, text string")
    tables.write_children(old, path, "doc", buckets=4)
    fresh = spark.createDataFrame([("3", 0, "new"), ("3", 1, "new"), ("77", 0, "new")], "doc string, i int, text string")
    gone = spark.createDataFrame([("5",)], "doc string")
    for _ in range(2):
        tables.exchange_children(fresh, path, "doc", gone, buckets=4)
    want = sorted([tuple(r) for r in old.collect() if r["doc"] not in ("3", "5")] + [tuple(r) for r in fresh.collect()])
    assert sorted(map(tuple, tables.read_children(spark, path).collect())) == want
    everyone = old.select("doc").distinct().union(fresh.select("doc").distinct())
    tables.exchange_children(fresh.limit(0), path, "doc", everyone, buckets=4)
    assert tables.read_children(spark, path, old.schema).count() == 0


def test_only_buckets_of_exchanged_parents_are_written(spark, tmp_path):
    path = str(tmp_path / "children")
    tables.write_children(spark.createDataFrame([(i, i) for i in range(200)], "doc long, i int"), path, "doc", buckets=8)
    before = {str(f): f.stat().st_mtime_ns for f in (tmp_path / "children").rglob("*.parquet")}
    tables.exchange_children(spark.createDataFrame([(7, 1)], "doc long, i int"), path, "doc", buckets=8)
    after = {str(f): f.stat().st_mtime_ns for f in (tmp_path / "children").rglob("*.parquet")}
    assert sum(after.get(f) == at for f, at in before.items()) == len(before) - 1


def test_blobs_are_stored_once(spark, tmp_path):
    path = str(tmp_path / "blobs")
    blobs = spark.createDataFrame([("a", b"x"), ("a", b"x"), ("b", b"x"), ("a", b"")], "course string, content binary")
    for _ in range(2):
        named = tables.store_blobs(blobs, path, "course")
    assert spark.read.parquet(path).count() == 3 and named.count() == 4
    assert {bytes(r["content"]) for r in tables.read_blobs(named.select("storage_path"), path).collect()} == {b"x", b""}
    with pytest.raises(Exception, match="no content at b/0"):
        tables.read_blobs(spark.createDataFrame([("b/0",)], "storage_path string"), path).collect()


def test_a_cluster_must_name_its_shared_folder(spark):
    class Cluster:
        conf = type("Conf", (), {"get": lambda self, key, other: other})()
        sparkContext = type("Context", (), {"master": "spark://host:7077"})()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        tables.shared_folder(Cluster())
    assert tables.shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")


def test_postings_give_what_a_scan_gives(spark, tmp_path):
    texts = spark.createDataFrame([(1, "b a a"), (2, "a"), (3, "B, A!"), (4, None), (5, "the cats hopped"), (6, "a cat that hops and hops")], "k int, t string")
    for i, (analyse, terms) in enumerate([(postings.simple_terms, ["a", "b"]), (postings.simple_terms, ["a"]), (english.english_terms, english.analyse("hopping cat")), (postings.simple_terms, [])]):
        path = str(tmp_path / f"p{i}")
        stored = postings.with_terms(texts, "t", analyse)
        assert stored.columns == ["k", "t", "content_terms"]
        postings.write_postings(stored, path, "k", buckets=4)
        want = [tuple(r) for r in retrieval.text_search(texts, terms, "k", "t", analyse=analyse).orderBy("rank").collect()]
        assert [tuple(r) for r in postings.search_postings(spark, path, terms, "k", buckets=4).orderBy("rank").collect()] == want and len(want) == (2, 4, 2, 0)[i]
        scope = texts.where("k <> 1").select("k")
        assert 1 not in [r["k"] for r in postings.search_postings(spark, path, terms, "k", scope, buckets=4).collect()]
    plan = postings.search_postings(spark, str(tmp_path / "p0"), ["a"], "k", buckets=4)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan


def test_lexical_english_is_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    wanted, found = set(english.analyse("of the ha and reer")), []
    for r in spark.read.parquet(f"{sf}/documents.parquet").where("lang = 'en'").collect():
        terms = english.analyse(r["text"])
        if wanted <= set(terms):
            found.append((-round(sum(t in wanted for t in terms) / (1 + math.log(len(terms))), 6), r["doc_id"]))
    rows = entry.queries()["lexical_english"](spark, sf).orderBy("rank").collect()
    assert [(r["doc_id"], r["score"]) for r in rows] == [(k, -s) for s, k in sorted(found)[:20]]


def test_ingestion_ends_ready_or_failed(spark):
    uploads = spark.createDataFrame([(1, b"one two\fthree"), (2, b"\xff"), (3, b" \f "), (4, None), (5, b"")], "k int, content binary")
    done = ingestion.ingest(uploads, "k", "content", "text/plain", providers.StubEmbedder(dim=3))
    assert {r["k"]: (r["status"], r["error_message"], r["page_count"]) for r in done.documents.collect()} == {1: ("READY", None, 2), 2: ("FAILED", "no UTF-8 text", None), 3: ("FAILED", "No extractable text", 2), 5: ("FAILED", "No extractable text", 1)}
    steps = {}
    for r in sorted(done.log.collect()):
        steps.setdefault(r["k"], []).append(r["state"])
    assert steps[1] == list(library.STATES) and steps[2] == ["UPLOADED", "EXTRACTING", "FAILED"] and steps[3] == ["UPLOADED", "EXTRACTING", "CHUNKING", "FAILED"]
    assert [(r["k"], r["page_number"], r["content"], len(r["embedding"])) for r in done.chunks.collect()] == [(1, 1, "one two three", 3)]
    bare = ingestion.ingest(uploads, "k", "content", "text/plain", providers.embedder("none")).chunks.collect()
    assert [r["embedding"] for r in bare] == [None]


def test_chunks_do_not_carry_the_whole_text(spark):
    docs = spark.createDataFrame([(1, "a b c")], "k int, text string")
    chunks = chunking.chunk_words(docs, chunking.split_pages(F.col("text")), "k")
    plan = chunks._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and chunks.columns == ["k", "chunk_index", "page_number", "content", "token_count"]


def test_streams_of_providers(spark):
    body = 'event: a\r\ndata: {"type":"content-delta","delta":{"message":{"content":{"text":" x"}}}}\r\ndata:\ndata: [DONE]\nid: 1\ndata: {"type":"content-delta","delta":{"message":{"content":{"text":" y "}}}}'
    assert column(spark, [body, "data: {}", None], "string", sse.stream_text(F.col("x"))) == [("x y",), (None,), (None,)]
    assert column(spark, [body, "data: {}"], "string", F.size(sse.data_lines(F.col("x")))) == [(2,), (1,)]
    assert column(spark, ["Bearer ab", "Basic ab", None], "string", sse.bearer(F.col("x"))) == [("ab",), (None,), (None,)]
    assert list(providers.EchoReplier().stream_complete(["a", " b  c "])) == ["b", "  c"]
    asked = spark.createDataFrame([(1, ["x", " hi you "]), (2, [" "]), (3, None)], "k int, m array<string>")
    assert {r["k"]: (r["reply"], r["reply_error"]) for r in providers.reply(asked, "m", providers.EchoReplier()).collect()} == {1: ("hi you", None), 2: (None, "the reply is blank"), 3: (None, "the reply is blank")}
    assert {r["reply_error"] for r in providers.reply(asked, "m", providers.Unconfigured()).collect()} == {"no chat provider is configured"}
    assert providers.embed_query(providers.StubEmbedder(dim=2), "abc") == [0.004, 0.005]


def test_record_ids(spark):
    rows = column(spark, ["a", "b"], "string", library.record_id(F.col("x"), F.col("i")))
    assert len({r[0] for r in rows}) == 2 and rows == column(spark, ["a", "b"], "string", library.record_id(F.col("x"), F.col("i")))
    assert column(spark, [rows[0][0], "x", None], "string", library.is_record_id(F.col("x"))) == [(True,), (False,), (False,)]
