"""Ranges of stored terms against a scan of the texts, and what a search reads of them."""

import itertools
import math
import random

import pytest

from pyspark.sql import functions as F

from folioscan.functions import text as tx
from folioscan.operators import postings, ranked_postings

WORDS = ["the", "and", "of", "a", "b", "c"]


def texts_of(n, seed=1):
    """Texts of very different lengths; few of the long ones are dense in "the" and "and"."""
    rng = random.Random(seed)
    return [[rng.choice(WORDS[:2] if i % 97 == 0 else WORDS) for _ in range(rng.choice([1, 2, 5, 20, 80]))] for i in range(n)]


def stored(spark, texts, folder, **more):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "id long, content_terms array<string>, score string")
    return ranked_postings.write_ranges(df, str(folder), "id", **more)


def scan(texts, terms, k, scope=None):
    found = []
    for i, t in enumerate(texts):
        if t and set(terms) <= set(t) and (scope is None or i in scope):
            found.append((round(sum(t.count(x) for x in set(terms)) / (1 + math.log(len(t))), 6), i))
    return [(i, pytest.approx(s), n + 1) for n, (s, i) in enumerate(sorted(found, key=lambda x: (-x[0], x[1]))[:k])]


@pytest.mark.parametrize("first", [1, 3, 1000])
def test_search_is_the_scan(spark, tmp_path, first):
    texts = texts_of(900)
    index = stored(spark, texts, tmp_path / "t", range_texts=16)
    for terms, k in ((["the", "and"], 7), (["the", "and", "of", "the"], 20), (["a"], 1), (["the", "nowhere"], 5), ([], 5), (["b"], 2000)):
        want = scan(texts, terms, k) if terms else []
        assert [(r["id"], r["score"], r["rank"]) for r in index.search(terms, k, first).orderBy("rank").collect()] == want
    even = spark.range(0, 900, 2)
    assert [(r["id"], r["score"], r["rank"]) for r in index.search(["the", "of"], 9, first, even).orderBy("rank").collect()] == scan(texts, ["the", "of"], 9, set(range(0, 900, 2)))


def test_search_reads_few_ranges(spark, tmp_path):
    index = stored(spark, texts_of(4000), tmp_path / "t", range_texts=16)
    terms = ["the", "and"]
    read = index.to_read(terms, 10, 4)
    assert read.count() * 4 < index.bounds(terms).count()
    classes = {r[0] for r in read.select("size_class").distinct().collect()}
    plan = index.texts(terms, read)._jdf.queryExecution().executedPlan().toString()
    assert "size_class" in plan.split("PartitionFilters: [")[1].split("]")[0] and len(classes) < 4
    # what bounds read has no texts in it
    assert "gaps" not in index.bounds(terms)._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]


def brute_cover(places):
    return min(max(c) - min(c) + 1 for c in itertools.product(*places))


def test_least_cover_by_brute_force():
    rng = random.Random(5)
    for _ in range(500):
        places = [sorted(rng.sample(range(40), rng.randint(1, 6))) for _ in range(rng.randint(1, 4))]
        assert ranked_postings.least_cover([[b - a for a, b in zip([0, *p], p)] for p in places]) == brute_cover(places)


def test_closest_by_brute_force(spark, tmp_path):
    texts = texts_of(300, seed=2)
    index = stored(spark, texts, tmp_path / "t", range_texts=16)
    for terms in (["the", "and", "of"], ["c"], ["a", "nowhere"], []):
        found = [(brute_cover([[i for i, w in enumerate(t) if w == x] for x in terms]), k) for k, t in enumerate(texts) if terms and set(terms) <= set(t) and len(t) < 30]
        want = [(k, c, n + 1) for n, (c, k) in enumerate(sorted(found)[:15])]
        short = {k for k, t in enumerate(texts) if len(t) < 30}
        got = [(r["id"], r["cover"]) for r in index.closest(terms, 1000).orderBy("rank").collect() if r["id"] in short]
        assert got[:15] == [(k, c) for k, c, _ in want]


def test_postings_of_odd_rows(spark, tmp_path):
    rows = [(1, []), (2, None), (None, ["a"]), (3, ["a", None, "a"]), (4, ["a"])]
    index = ranked_postings.write_ranges(spark.createDataFrame(rows, "key long, content_terms array<string>"), str(tmp_path / "o"), "key")
    assert [(r["key"], r["rank"]) for r in index.search(["a"], 5).orderBy("rank").collect()] == [(4, 1), (3, 2)]
    none = ranked_postings.write_ranges(spark.createDataFrame([], "key long, content_terms array<string>"), str(tmp_path / "e"), "key")
    assert none.search(["a"]).collect() == [] and none.closest(["a"]).collect() == []


def shuffled_rows(spark, work):
    """Rows that the shuffles of some work write."""
    store, sc = spark._jsc.sc().statusStore(), spark.sparkContext
    none, no_quantiles = sc._jvm.java.util.ArrayList(), sc._gateway.new_array(sc._jvm.double, 0)

    def total():
        spark._jsc.sc().listenerBus().waitUntilEmpty()
        stages = store.stageList(none, False, False, no_quantiles, none)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = total()
    work()
    return total() - before


def test_occurrences_by_brute_force(spark):
    texts = [*texts_of(60, seed=3), [], None, ["a", None, "a"], [None]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, t array<string>")
    for r in df.select("id", tx.occurrences(F.col("t")).alias("o")).collect():
        t = texts[r["id"]] or []
        want = [(x, [i for i, w in enumerate(t) if w == x]) for x in sorted({w for w in t if w is not None})]
        assert [(o["term"], o["places"]) for o in r["o"] or []] == want


def test_words_are_not_shuffled(spark, tmp_path):
    """Neither a text's words nor, where ranges are made, its distinct terms; postings move once."""
    rows = spark.createDataFrame([(i, [f"w{j % 100}" for j in range(150)]) for i in range(300)], "id long, content_terms array<string>")
    assert shuffled_rows(spark, lambda: ranked_postings.write_ranges(rows, str(tmp_path / "r"), "id")) < 1000
    assert shuffled_rows(spark, lambda: postings.write_postings(rows, str(tmp_path / "p"), "id")) <= 300 * 100


def test_postings_of_rows_that_share_a_key(spark, tmp_path):
    rows = spark.createDataFrame([(1, ["a", "b"]), (1, ["a"]), (2, ["a", "a"])], "id long, content_terms array<string>")
    postings.write_postings(rows, str(tmp_path / "p"), "id", buckets=2)
    assert [r["id"] for r in postings.search_postings(spark, str(tmp_path / "p"), ["a", "b"], "id", buckets=2).collect()] == [1]
    assert {r["id"] for r in postings.search_postings(spark, str(tmp_path / "p"), ["a"], "id", buckets=2).collect()} == {1, 2}
