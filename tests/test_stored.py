"""The vector index, the lifecycle of uploads, the source of event logs, tables published together, cascades."""

import datetime as dt
import glob
import json
import os
import random
import subprocess
import sys
import textwrap

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from folioscan.operators import cascade, vector_index
from folioscan.sources import event_source, together
from folioscan.streaming import ingest, lifecycle

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

# vector index


def cosine(a, b):
    return float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b))


def clustered(n, width, seed, groups=12):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, width))
    x = centres[rng.integers(groups, size=n)] + 0.3 * rng.normal(size=(n, width))
    return [(i, [float(np.float32(c)) for c in v], i % 3) for i, v in enumerate(x)]


ODD = [(900, None, 0), (901, [0.0] * 6, 0), (902, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (903, [float("nan")] * 6, 1), (904, [1.0], 2), (905, [], 2), (None, [1.0] * 6, 0)]


def brute_index(rows, queries, k, keep=lambda s: True):
    usable = [(i, v, s) for i, v, s in rows if i is not None and v and len(v) == 6 and all(c is not None and np.isfinite(c) for c in v) and any(v) and keep(s)]
    out = []
    for q in queries:
        v = next(v for i, v, _ in rows if i == q)
        out += [(q, i, r + 1) for r, (_, i) in enumerate(sorted((-cosine(v, w), i) for i, w, _ in usable)[:k])]
    return sorted(out)


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rows = clustered(400, 6, 1)
    rows += [(400 + i, rows[i][1], 1) for i in range(5)] + ODD  # copies of five vectors
    path = f"file://{tmp_path_factory.mktemp('index')}/i"
    frame = spark.createDataFrame(rows, "id long, v array<float>, course int")
    return vector_index.build_index(frame, path, "id", "v", "course", cells=12), rows, frame


def asked(frame, ids):
    return frame.where(F.col("id").isin(ids)).select(F.col("id").alias("query_id"), F.col("v").alias("vector"))


def found(df):
    return sorted((r["query_id"], r["key"], r["rank"]) for r in df.collect())


def test_index_exact(spark, index):
    built, rows, frame = index
    ids = [0, 3, 50, 77, 399]
    assert found(built.search(asked(frame, ids), 7, None)) == brute_index(rows, ids, 7)
    assert found(built.search(asked(frame, ids), 7, None, F.col("scope") == 1)) == brute_index(rows, ids, 7, lambda s: s == 1)
    assert found(built.search(asked(frame, ids), 1000, None)) == brute_index(rows, ids, 1000)
    assert found(built.search(asked(frame, ids), 5, 12)) == brute_index(rows, ids, 5)
    assert built.search(asked(frame, [900, 901, 902, 903, 904, 905]), 5, None).count() == 0


def test_index_recall(spark, index):
    built, rows, frame = index
    ids = list(range(0, 400, 4))
    want = {(q, i) for q, i, _ in brute_index(rows, ids, 20)}
    probes = built.probes_for(asked(frame, ids[:30]), 20, 0.95)
    assert probes <= 4
    got = {(q, i) for q, i, _ in found(built.search(asked(frame, ids), 20, probes))}
    assert len(got & want) >= 0.9 * len(want)


def test_index_reads_the_probed_cells_only(spark, index, tmp_path):
    """Files of other cells are no Parquet: reading one would fail."""
    built, rows, frame = index
    import shutil

    shutil.copytree(built.path.removeprefix("file://"), tmp_path / "i")
    copy = vector_index.VectorIndex(spark, f"file://{tmp_path}/i")
    one = np.array([rows[0][1]])
    places = vector_index.cell_ranks(one / np.linalg.norm(one), copy.centres)[0]
    broken = [f for c in np.flatnonzero(places >= 2) for t in ("lists", "rows") for f in glob.glob(f"{tmp_path}/i/{t}/cell={c}/*.parquet")]
    for f in broken:
        with open(f, "wb") as out:
            out.write(b"no parquet at all")
        crc = os.path.join(os.path.dirname(f), f".{os.path.basename(f)}.crc")
        if os.path.exists(crc):
            os.remove(crc)
    assert broken and copy.search(asked(frame, [0]), 3, 2).count() == 3
    with pytest.raises(Exception, match="(?i)parquet"):
        copy.search(asked(frame, [0]), 3, 12).count()


def test_index_grows(spark, tmp_path):
    rows = clustered(60, 6, 3)
    frame = spark.createDataFrame(rows, "id long, v array<float>, course int")
    built = vector_index.build_index(frame.where("id < 40"), f"file://{tmp_path}/i", "id", "v", cells=4)
    built.add(frame.where("id >= 40"), "id", "v")
    again = vector_index.VectorIndex(spark, f"file://{tmp_path}/i")
    assert again.sizes()[0].sum() == 60
    assert found(again.search(asked(frame, [1, 45]), 9, None)) == brute_index(rows, [1, 45], 9)


def test_index_of_nothing(spark, tmp_path):
    frame = spark.createDataFrame([], "id long, v array<float>")
    built = vector_index.build_index(frame, f"file://{tmp_path}/i", "id", "v")
    one = spark.createDataFrame([(1, [1.0])], "query_id long, vector array<float>")
    assert built.search(one, 3, None).count() == 0 and built.search(one, 3, 1).count() == 0


# lifecycle

SHAPE = "key long, at timestamp, seq long, event string, reason string"
START = dt.datetime(2024, 1, 1)


def at(minute):
    return START + dt.timedelta(minutes=minute)


def run(events, limits=lifecycle.Limits()):
    state, out = None, []
    for minute, event in events:
        state, lines = lifecycle.step(state, minute * 60_000, event, None, limits)
        out += [(*line[2:5],) for line in lines]
    return state and state.name, out


def test_steps():
    assert run([(0, "UPLOADED"), (1, "EXTRACTING"), (2, "CHUNKING"), (3, "EMBEDDING"), (4, "READY")])[0] == "READY"
    assert run([(0, "UPLOADED"), (1, "FAILED"), (2, "EXTRACTING")]) == ("FAILED", [(None, "UPLOADED", "moved"), ("UPLOADED", "FAILED", "moved"), ("FAILED", "EXTRACTING", "refused")])
    assert run([(0, "UPLOADED"), (1, "READY")])[1][-1] == ("UPLOADED", "READY", "refused")
    assert run([(5, "UPLOADED"), (4, "EXTRACTING")])[1][-1] == ("UPLOADED", "EXTRACTING", "refused")
    assert run([(1, "EXTRACTING")]) == (None, [(None, "EXTRACTING", "ignored")])
    assert run([(0, "UPLOADED"), (1, "DELETED"), (2, "EXTRACTING")])[1][-1] == ("DELETED", "EXTRACTING", "ignored")
    assert run([(0, "UPLOADED"), (61, "EXTRACTING")]) == ("FAILED", [(None, "UPLOADED", "moved"), ("UPLOADED", "FAILED", "moved"), ("FAILED", "EXTRACTING", "refused")])
    assert run([(0, "UPLOADED"), (60, "EXTRACTING")])[0] == "EXTRACTING"  # just in time
    assert run([(0, "UPLOADED"), (1, "DELETED"), (2000, "UPLOADED")])[0] == "UPLOADED"  # forgotten after a day
    assert run([(0, "UPLOADED"), (1, "nonsense")])[1][-1][2] == "refused"


def test_stream_and_fold_agree_after_restarts(spark, tmp_path):
    """Random events, dealt over runs of one checkpoint, give the log and the states of one fold; stuck uploads fail by timer."""
    rng, rows = random.Random(4), []
    kinds = ["UPLOADED", "EXTRACTING", "CHUNKING", "EMBEDDING", "READY", "FAILED", "DELETED"]
    for key in range(40):
        minute, path = 0.0, list(kinds[:5])
        for n in range(rng.randint(1, 8)):
            minute += rng.choice([1, 2, 5, -1])
            event = path.pop(0) if path and rng.random() < 0.7 else rng.choice(kinds)
            rows.append((key, at(max(0, minute)), n, event, None))
    rows += [(None, at(1), 0, "UPLOADED", None), (3, None, 9, "READY", None)]
    parts = [[r for r in rows if r[2] < 3], [r for r in rows if r[2] >= 3], [(99, at(600), 0, "UPLOADED", None)]]
    for i, part in enumerate(parts):
        spark.createDataFrame(part, SHAPE).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = ingest.read_stream(spark, f"{tmp_path}/in", spark.createDataFrame([], SHAPE).schema)
        lifecycle.run_transitions(stream, f"file://{tmp_path}/log", f"file://{tmp_path}/checkpoint").awaitTermination()
    got, want = spark.read.parquet(f"{tmp_path}/log").drop("batch"), lifecycle.fold_events(spark.read.parquet(f"{tmp_path}/in"))
    text = lambda df: sorted(str(tuple(r)) for r in df.select(*want.columns).collect())
    assert text(got) == text(want)
    reasons = {r["reason"] for r in got.collect()}
    assert any(r and r.startswith("stuck") for r in reasons) and "late" in reasons
    states = {r["key"]: r["state"] for r in lifecycle.current_states(got).collect()}
    assert states == {r["key"]: r["state"] for r in lifecycle.current_states(want).collect()} and states[99] == "UPLOADED"
    assert not set(states.values()) & {"EXTRACTING", "CHUNKING", "EMBEDDING"}


def test_fold_of_nothing(spark):
    assert lifecycle.fold_events(spark.createDataFrame([], SHAPE)).count() == 0


# event logs


def whole(data):
    """Each complete event's place and bytes, by hand."""
    import re

    out, start = [], 0
    for m in re.finditer(rb"(?:\r?\n){2,}", data):
        if data[start : m.start()].strip():
            out.append((start, data[start : m.start()]))
        start = m.end()
    return out, start


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"data: x", b"\n", b"\r\n", b"\n\n", b"\r\n\r\n", "é".encode(), b"id: 1\n"]), max_size=40), st.lists(st.integers(0, 60), max_size=6), st.integers(1, 9))
def test_any_split_of_the_bytes_gives_the_same_events(pieces, cuts, chunk):
    data = b"".join(pieces)
    want, stop = whole(data)
    bounds = sorted({0, stop, *(min(c, stop) for c in cuts)})
    read = lambda position, n: data[position : position + n]
    got = [e for a, b in zip(bounds, bounds[1:], strict=False) for e in event_source.events_between(read, a, b, chunk)]
    assert got == want


def test_logs_as_a_stream(spark, tmp_path):
    """Logs grow, within an event too; limits cut anywhere; the query is stopped and starts again; each event comes once."""
    spark.dataSource.register(event_source.EventLogs)
    logs = tmp_path / "logs"
    logs.mkdir()
    events = [f"id: {i}\nevent: delta\ndata: {'x' * (i % 50)}é{i}".encode() for i in range(200)]
    half = b"\n\n".join(events[:100]) + b"\n\nid: 100\nda"
    (logs / "a.log").write_bytes(half)
    (logs / "_b.log").write_bytes(b"data: hidden\n\n")

    def run_(limit):
        stream = spark.readStream.format("event_logs").option("path", str(logs)).option("max_bytes", limit).option("split_bytes", 300).option("progress", str(tmp_path / "progress")).load()
        query = stream.writeStream.foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={n}")).option("checkpointLocation", f"{tmp_path}/checkpoint").start()
        query.processAllAvailable()
        query.stop()
        return spark.read.schema(event_source.SCHEMA).parquet(f"{tmp_path}/out").collect()

    first = run_(1111)
    assert sorted(r["body"] for r in first) == sorted(e.decode() for e in events[:100])
    (logs / "a.log").write_bytes(b"\n\n".join(events[:150]) + b"\r\n\r\n")
    (logs / "c.log").write_bytes(b"\n\n".join(events[150:]) + b"\n\ndata: no end")
    again = run_(700)
    assert sorted(r["body"] for r in again) == sorted(e.decode() for e in events)
    assert len({(r["file"], r["position"]) for r in again}) == len(events)


def test_limits_need_a_place_for_what_was_planned():
    with pytest.raises(ValueError, match="progress"):
        event_source.EventReader({"path": "/x", "max_bytes": "5"})


# tables published together

COURSES, MEMBERS = "id long, name string", "course long, member long"


def both(spark, ids):
    n = F.col("id")
    return spark.createDataFrame([(i,) for i in ids], "id long").repartition(3).select(F.struct(n, F.concat(F.lit("c"), n).alias("name")).alias("courses"), F.when(n % 2 == 0, F.struct(n.alias("course"), (n * 10).alias("member"))).alias("members"))


def stored(spark, path):
    return tuple(sorted(tuple(r) for r in together.read_together(spark, path, t, s).collect()) for t, s in (("courses", COURSES), ("members", MEMBERS)))


def test_both_tables_or_neither(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    assert stored(spark, path) == ([], [])
    together.write_together(both(spark, range(6)), path, "one")
    before = stored(spark, path)
    assert before == ([(i, f"c{i}") for i in range(6)], [(i, 10 * i) for i in (0, 2, 4)])
    bad = both(spark, range(100, 160)).withColumn("courses", F.when(F.col("courses.id") == 133, F.raise_error(F.lit("midway")).cast("struct<id:bigint,name:string>")).otherwise(F.col("courses")))
    with pytest.raises(Exception, match="midway"):
        together.write_together(bad, path, "two")
    assert stored(spark, path) == before
    together.write_together(both(spark, [7, 8]), path, "one")  # a transaction that has been published
    assert stored(spark, path) == before
    together.write_together(both(spark, [8]), path, "three")
    assert stored(spark, path) == (before[0] + [(8, "c8")], before[1] + [(8, 80)])
    together.sweep(spark, path, ["courses", "members"])
    assert together.sweep(spark, path, ["courses", "members"]) == 0 and len(stored(spark, path)[0]) == 7
    with pytest.raises(ValueError, match="transaction"):
        together.write_together(both(spark, [8]), path, "../x")


def test_a_task_that_runs_again_adds_nothing(tmp_path):
    """In a session of its own, which tries tasks again: the first attempt fails after it has written."""
    code = f"""
        from pyspark.sql import SparkSession, functions as F
        from pyspark import TaskContext
        from folioscan.sources import together
        spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").getOrCreate()

        def once(batches):
            for b in batches:
                yield b
            if TaskContext.get().attemptNumber() == 0:
                raise RuntimeError("lost")

        rows = spark.range(40).repartition(2).mapInPandas(once, "id long").select(F.struct("id").alias("a"), F.struct((F.col("id") * 2).alias("id")).alias("b"))
        together.write_together(rows, "file://{tmp_path}/t", "one")
        print("ROWS", *[together.read_together(spark, "file://{tmp_path}/t", t, "id long").agg(F.count("id"), F.sum("id")).first() for t in "ab"])
        print("SWEPT", together.sweep(spark, "file://{tmp_path}/t", ["a", "b"]))
    """
    done = subprocess.run([sys.executable, "-c", textwrap.dedent(code)], capture_output=True, text=True, cwd=tmp_path, env={**os.environ, "PYTHONPATH": ROOT})
    assert "ROWS Row(count(id)=40, sum(id)=780) Row(count(id)=40, sum(id)=1560)" in done.stdout, done.stderr[-3000:]


def test_writer_commits_the_attempt_that_told(tmp_path):
    """Two attempts of one task have written; the one whose message comes is published, and abort takes away what it is told of."""
    import pyarrow as pa
    from pyspark.sql.types import StructType

    batch = pa.RecordBatch.from_pydict({"a": pa.array([{"id": 1}, None, {"id": 2}])})
    writer = together.TogetherWriter({"path": str(tmp_path), "txn": "t", "job": "j"}, StructType.fromDDL("a struct<id:bigint>"))
    first, second, third = (writer.write(iter([batch])) for _ in range(3))
    writer.abort([first, None])
    writer.commit([second, None])
    named = [json.loads(line) for line in (tmp_path / "_log" / "t.json").read_text().splitlines()]
    assert [(n["table"], n["file"], n["rows"]) for n in named] == second.files and second.files[0][2] == 2
    assert len(glob.glob(f"{tmp_path}/a/*.parquet")) == 2  # second, and third, which nobody names


# cascades

K = cascade.ForeignKey


def test_order_has_parents_first():
    keys = [K("message", "t", "thread", "id"), K("thread", "c", "course", "id"), K("chunk", "d", "document", "id"), K("document", "c", "course", "id"), K("message", "re", "message", "id")]
    flat = [t for g in cascade.order(keys) for t in g]
    assert flat.index("course") < flat.index("thread") < flat.index("message") and flat.index("document") < flat.index("chunk")
    assert sorted(map(tuple, cascade.order([K("a", "x", "b", "id"), K("b", "y", "a", "id"), K("c", "z", "b", "id")]))) == [("a", "b"), ("c",)]


def brute_cascade(tables, ids, keys, gone):
    dead = {t: {r[ids[t]] for r in rows if r[ids[t]] in gone.get(t, ())} for t, rows in tables.items()}
    while True:
        size = sum(map(len, dead.values()))
        for k in keys:
            refs = {r[k.key] for r in tables[k.parent] if r[ids[k.parent]] in dead[k.parent]} - {None}
            dead[k.child] |= {r[ids[k.child]] for r in tables[k.child] if r[k.column] in refs}
        if sum(map(len, dead.values())) == size:
            return {t: sorted((tuple(r.items()) for r in rows if r[ids[t]] not in dead[t]), key=str) for t, rows in tables.items()}


def test_cascade_by_brute_force(spark):
    """Several paths to one table, a table that refers to itself, a circle, a reference to another unique column, nulls."""
    rng = random.Random(3)
    some = lambda n: rng.choice([None, *range(n)])
    tables = {
        "course": [{"id": i, "code": f"k{i}", "main": some(30)} for i in range(12)],
        "document": [{"id": i, "course": rng.choice(["k1", "k5", "k9", None])} for i in range(30)],
        "thread": [{"id": i, "course": some(12), "document": some(30)} for i in range(30)],
        "message": [{"id": i, "thread": some(30), "reply": some(i) if i else None} for i in range(80)],
    }
    ids = dict.fromkeys(tables, "id")
    keys = [K("document", "course", "course", "code"), K("thread", "course", "course", "id"), K("thread", "document", "document", "id"), K("message", "thread", "thread", "id"), K("message", "reply", "message", "id"), K("course", "main", "document", "id")]
    shapes = {"course": "id long, code string, main long", "document": "id long, course string", "thread": "id long, course long, document long", "message": "id long, thread long, reply long"}
    frames = {t: spark.createDataFrame([tuple(r.values()) for r in rows], shapes[t]) for t, rows in tables.items()}
    for gone in ({"course": {5}}, {"message": {0, 7}, "course": set()}, {"document": {3}}):
        named = {t: spark.createDataFrame([(i,) for i in g] + [(12345,), (None,)], "id long") for t, g in gone.items()}
        left = cascade.cascade(frames, ids, keys, named).left
        assert {t: sorted((tuple(r.asDict().items()) for r in df.collect()), key=str) for t, df in left.items()} == brute_cascade(tables, ids, keys, gone), gone


def test_cascade_restricts_and_sets_null(spark):
    users, courses, notes = spark.createDataFrame([(1,), (2,)], "id long"), spark.createDataFrame([(10, 1), (11, 2)], "id long, owner long"), spark.createDataFrame([(5, 1), (6, 2), (7, None)], "id long, author long")
    keys = [K("course", "owner", "user", "id", cascade.RESTRICT), K("note", "author", "user", "id", cascade.SET_NULL)]
    tables, ids, gone = {"user": users, "course": courses, "note": notes}, {"user": "id", "course": "id", "note": "id"}, users.where("id = 1")
    with pytest.raises(cascade.Restricted, match="1 rows of course"):
        cascade.cascade(tables, ids, keys, {"user": gone})
    left = cascade.cascade(tables, ids, keys, {"user": gone, "course": courses.where("id = 10").select("id")}).left  # the row that forbids it goes as well
    assert [r["id"] for r in left["user"].collect()] == [2] and [r["id"] for r in left["course"].collect()] == [11]
    assert sorted((r["id"], r["author"]) for r in left["note"].collect()) == [(5, None), (6, 2), (7, None)] or {(r["id"], r["author"]) for r in left["note"].collect()} == {(5, None), (6, 2), (7, None)}


def test_a_state_is_asked_for_once():
    """Each question to the store is a round trip of its own."""
    asked = []

    class Held:
        value = None

        def exists(self):
            asked.append("exists")
            return self.value is not None

        def get(self):
            asked.append("get")
            return self.value

    machine = lifecycle.Lifecycle(lifecycle.Limits())
    machine.held = Held()
    assert machine._now() is None and asked == ["get"]
    machine.held.value = ("READY", 5, 7, 2)
    assert machine._now() == lifecycle.State("READY", 5, 7, 2) and asked == ["get", "get"]


def test_few_vectors_meet_the_centres_at_once():
    batches = [pd.DataFrame({"x": range(a, b)}, index=range(b - a)) for a, b in ((0, 0), (0, 1), (1, 2000))]
    parts = list(vector_index._parts(iter(batches)))
    assert all(0 < len(p) <= vector_index.MEET and list(p.index) == list(range(len(p))) for p in parts)
    assert [x for p in parts for x in p["x"]] == list(range(2000))
