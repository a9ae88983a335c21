"""Pages of stored orders, stored keys with filters, calls in a bounded window."""

import os
import random
import threading
import time
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from folioscan.operators import calls, existence, paging


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def spoil(path, keep):
    """Files of folders that keep doesn't name can't be read any more."""
    n = 0
    for folder in os.listdir(path):
        if "=" in folder and folder not in keep:
            for f in os.listdir(f"{path}/{folder}"):
                if f.endswith(".parquet"):
                    open(f"{path}/{folder}/{f}", "wb").write(b"spoilt")
                    n += 1
                elif f.endswith(".crc"):
                    os.remove(f"{path}/{folder}/{f}")
    return n


# pages

ROWS = [(i, random.Random(i).choice(["a", "a", "a", "b", None]), None if i % 17 == 0 else i * 7919 % 50) for i in range(600)] + [(1000, "c", 1)]


def ordered(scope, scoped=True):
    kept = [r for r in ROWS if r[1] == scope or not scoped]
    return [r[0] for r in sorted(kept, key=lambda r: (r[2] is None, -(r[2] or 0), r[0]))]


@pytest.fixture(scope="module")
def orders(spark, tmp_path_factory):
    frame = spark.createDataFrame(ROWS, "id long, scope string, worth int").repartition(5)
    by = [F.col("worth").desc(), F.col("id").asc()]
    write = lambda scope: paging.write_ordered(frame, f"file://{tmp_path_factory.mktemp('order')}/o", by, scope, range_rows=40)
    return write("scope"), write(None)


@pytest.mark.parametrize("scope", ["a", "b", None, "c", "none such"])
@pytest.mark.parametrize("number,size", [(0, 20), (1, 20), (4, 20), (17, 20), (0, 500), (2, 45), (10**6, 20), (6, 1)])
def test_page_is_the_sorted_slice(orders, scope, number, size):
    found = orders[0].page(number, size, scope).collect()
    want = ordered(scope)[number * size : (number + 1) * size]
    assert [(r["id"], r["place"]) for r in found] == [(i, number * size + n) for n, i in enumerate(want)]


def test_pages_without_scope(orders):
    everything = ordered(None, scoped=False)
    for number in (0, 3, 30, 31):
        assert [r["id"] for r in orders[1].page(number).collect()] == everything[number * 20 : number * 20 + 20]


def test_many_pages_at_once(spark, orders):
    asked = [("a", 0), ("a", 9), ("a", 9), ("a", 99), (None, 1), ("c", 0), ("none such", 0), ("b", None)]
    got = orders[0].pages(spark.createDataFrame(asked, "scope string, page int"), 20).collect()
    want = {(s, p, i) for s, p in set(asked) if p is not None for i in ordered(s)[p * 20 : p * 20 + 20]}
    assert {(r["scope"], r["page"], r["id"]) for r in got} == want and len(got) == len(want)
    one = orders[1].pages(spark.createDataFrame([(0, 2)], "scope int, page int"), 20).collect()
    assert {r["id"] for r in one} == set(ordered(None, scoped=False)[40:60])


def test_totals_are_those_of_the_counts(orders):
    got = {r["scope"]: (r["total_elements"], r["total_pages"]) for r in orders[0].totals(20).collect()}
    assert got == {s: (len(ordered(s)), -(-len(ordered(s)) // 20)) for s in ("a", "b", "c", None)}


def test_a_page_reads_its_ranges_and_sorts_nothing_else(spark, orders, tmp_path_factory):
    frame = spark.createDataFrame(ROWS, "id long, scope string, worth int")
    path = f"{tmp_path_factory.mktemp('order')}/o"
    index = paging.write_ordered(frame, f"file://{path}", [F.col("worth").desc(), F.col("id").asc()], "scope", range_rows=40)
    found = index.page(5, 20, "a")
    text = plan(found)
    assert "Exchange" not in text and "PartitionFilters: [" in text and "_range" in text.split("PartitionFilters: [")[1].split("]")[0]
    held = {f"_range={r['_range']}" for r in index.counts().where("scope = 'a' AND before < 120 AND before + n > 100").collect()}
    assert len(held) <= 3 and spoil(f"{path}/rows", held) >= 10
    assert [r["id"] for r in found.collect()] == ordered("a")[100:120]
    many = plan(index.pages(spark.createDataFrame([("a", 0)], "scope string, page int")))
    assert "rangepartitioning" not in many


def test_hot_scope_is_split(orders):
    sizes = orders[0].counts().groupBy("_range").agg(F.sum("n").alias("n")).collect()
    assert len(sizes) >= 10 and max(r["n"] for r in sizes) <= 3 * 40


def test_order_of_an_empty_table_and_clashing_names(spark, tmp_path):
    empty = spark.createDataFrame([], "id long, scope string")
    index = paging.write_ordered(empty, f"file://{tmp_path}/e", [F.col("id").asc()], "scope")
    assert index.page(0, 20, "a").collect() == [] and index.totals().collect() == []
    with pytest.raises(ValueError, match="place"):
        paging.write_ordered(empty.withColumn("place", F.lit(1)), f"file://{tmp_path}/f", [F.col("id").asc()])
    with pytest.raises(ValueError, match="no page"):
        index.page(-1)


# existence

KEYS = [(i % 7, f"d{i}") for i in range(3000)] + [(1, "d1")] * 50 + [(None, "d5"), (2, None)]


@pytest.fixture
def stored(spark, tmp_path):
    frame = spark.createDataFrame(KEYS, "course int, digest string")
    return existence.store_keys(frame, f"file://{tmp_path}/k", "course", "digest", bucket_keys=100)


def test_exists_is_the_join(spark, stored):
    asked = [(n, c, d) for n, (c, d) in enumerate([(i % 7, f"d{i}") for i in range(0, 6000, 3)] + [(1, "d2")] * 2 + [(None, "d5"), (2, None), (None, None)])]
    got = stored.exists(spark.createDataFrame(asked, "n long, course int, digest string")).collect()
    have = {k for k in KEYS if None not in k}
    assert {r["n"]: r["exists"] for r in got} == {n: (c, d) in have for n, c, d in asked} and len(got) == len(asked)
    assert stored.stored().count() == len(have)


def test_filters_rule_out_nearly_all_strangers_and_no_key(spark, stored):
    strangers = spark.createDataFrame([(i % 7, f"x{i}") for i in range(20_000)], "course int, digest string")
    assert stored.possible(strangers).count() < 400 and stored.found(strangers).count() == 0
    mine = spark.createDataFrame(KEYS, "course int, digest string")
    assert stored.possible(mine).count() == 3000


def test_a_filters_wrong_yes_is_no_answer(spark, tmp_path):
    rows = spark.createDataFrame([(f"d{i}",) for i in range(500)], "digest string")
    crowded = existence.store_keys(rows, f"file://{tmp_path}/k", "digest", block_keys=500)  # all bits are set
    strangers = spark.createDataFrame([(f"x{i}",) for i in range(300)], "digest string")
    assert crowded.possible(strangers).count() > 250 and crowded.found(strangers).count() == 0
    assert not any(r["exists"] for r in crowded.exists(strangers).collect())


def test_only_touched_partitions_are_read_and_stored_keys_stay(spark, stored, tmp_path):
    asked = spark.createDataFrame([(3, "d3"), (4, "d4"), (5, "x5")], "course int, digest string")
    buckets = {f"bucket={r['bucket']}" for r in stored.possible(asked).select("bucket").distinct().collect()}
    asked_buckets = {f"bucket={r['bucket']}" for r in stored._placed(asked).select("bucket").distinct().collect()}
    assert spoil(f"{tmp_path}/k/keys", buckets) >= 20 and spoil(f"{tmp_path}/k/filters", asked_buckets) >= 20
    found = stored.found(asked)
    assert {tuple(r) for r in found.collect()} == {(3, "d3"), (4, "d4")}
    text = plan(found)
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text
    assert "bucket" in text.split("PartitionFilters: [")[1].split("]")[0]


def test_added_keys_merge_and_come_once(spark, stored):
    more = spark.createDataFrame([(i % 7, f"d{i}") for i in range(2900, 3300)] + [(None, "z")], "course int, digest string")
    for _ in range(2):
        stored.add(more)
    assert stored.stored().count() == 3300 and stored.stored().distinct().count() == 3300
    assert stored.found(more).count() == 400


def test_bits_without_keys_are_harmless(spark, stored):
    """What an add leaves that fails after its filters."""
    more = spark.createDataFrame([(1, "lost")], "course int, digest string")
    placed = stored._placed(more)
    placed.select("block", "w0", "w1", "w2", "w3", "bucket").write.partitionBy("bucket").mode("append").parquet(f"{stored.path}/filters")
    assert stored.possible(more).count() == 1 and stored.found(more).count() == 0
    stored.add(more)
    assert stored.found(more).count() == 1


def test_keys_of_an_empty_table(spark, tmp_path):
    none = spark.createDataFrame([], "digest string")
    empty = existence.store_keys(none, f"file://{tmp_path}/k", "digest")
    some = spark.createDataFrame([("a",), (None,)], "digest string")
    assert [r["exists"] for r in empty.exists(some).collect()] == [False, False] and empty.exists(none).collect() == []
    empty.add(some)
    assert sorted((r["digest"] or "", r["exists"]) for r in empty.exists(some).collect()) == [("", False), ("a", True)]


# calls


def test_window_is_full_and_never_more():
    lock, state, taken = threading.Lock(), {"now": 0, "most": 0, "ahead": 0, "done": 0}, []

    def call(n):
        with lock:
            state["now"] += 1
            state["most"] = max(state["most"], state["now"])
        time.sleep(0.002 * (n % 5))
        with lock:
            state["now"] -= 1
            state["done"] += 1
        return n

    def values():
        for n in range(200):
            taken.append(n)
            state["ahead"] = max(state["ahead"], len(taken) - state["done"])
            yield n

    with ThreadPoolExecutor(6) as pool:
        assert [r for r, _ in calls.windowed(values(), call, pool, 6)] == list(range(200))
    assert state["most"] == 6 and state["ahead"] <= 7  # six under way, one at the door


class Counting:
    """A call whose answer is how many were under way in its process."""

    now, lock = 0, threading.Lock()

    def __call__(self, n):
        with Counting.lock:
            Counting.now += 1
            seen = Counting.now
        time.sleep(0.003)
        with Counting.lock:
            Counting.now -= 1
        if n % 10 == 3:
            raise OSError(f"no answer to {n}" + "!" * 600)
        return seen


def test_calls_of_a_task_keep_order_and_fail_alone(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)  # windows go over batches
    try:
        rows = spark.range(101, numPartitions=1).select("id", F.when(F.col("id") % 10 != 9, F.col("id")).alias("n"))
        got = calls.call_each(rows, "n", Counting(), LongType(), 4).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [r["id"] for r in got] == list(range(101))
    for r in got:
        if r["id"] % 10 == 9:
            assert r["result"] is None and r["error"] is None
        elif r["id"] % 10 == 3:
            assert r["result"] is None and r["error"].startswith(f"OSError: no answer to {r['id']}!") and len(r["error"]) == 500
        else:
            assert 1 <= r["result"] <= 4 and r["error"] is None
    assert max(r["result"] or 0 for r in got) > 1


def test_calls_of_an_empty_table_and_clashing_names(spark):
    none = spark.createDataFrame([], "id long, n long")
    assert calls.call_each(none, "n", Counting(), LongType()).collect() == []
    with pytest.raises(ValueError, match="error"):
        calls.call_each(none.withColumn("error", F.lit("")), "n", Counting(), LongType())
    with pytest.raises(ValueError, match="one call"):
        calls.call_each(none, "n", Counting(), LongType(), 0)
