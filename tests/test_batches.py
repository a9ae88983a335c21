"""Python workers hold some megabytes of a batch at a time, however long its texts are."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioscan.functions import batches, english
from folioscan.sources import pages, providers


def test_pieces_are_the_batch():
    values = ["ab", None, "", "c" * 50, "d", "e" * 9, None]
    for limit in (1, 10, 1000):
        parts = [p.to_pylist() for p in batches.pieces(pa.array(values), limit)]
        assert sum(parts, []) == values and all(len(p) == 1 or sum(len(x or "") for x in p) <= limit for p in parts)
    assert list(batches.pieces(pa.array([], pa.string()))) == []


def _held():
    """A worker's memory in MB, as a function that it can be sent."""

    def held() -> int:
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * 4096 >> 20

    return held


class Watched:
    """Vectors of 768 components, the first of which is the worker's memory."""

    batch = 96

    def __init__(self):
        held = _held()
        self.embed = lambda texts: [[float(held()), *(0.001 * i + len(t) for i in range(767))] for t in texts]

    def configured(self):
        return True


def test_embedding_holds_one_batch_of_the_provider(spark):
    rows = spark.range(0, 8000, 1, 1).select("id", F.when(F.col("id") % 5 > 0, F.col("id").cast("string")).alias("t"))
    out = providers.embed(rows, "t", Watched()).select(F.size("embedding").alias("n"), F.col("embedding")[0].alias("mb")).agg(F.count("n"), F.min("n"), F.max("mb") - F.min("mb")).first()
    assert out[:2] == (8000, 768) and out[2] < 80


def test_extraction_holds_few_files(spark, monkeypatch):
    held = _held()
    monkeypatch.setitem(pages.EXTRACTORS, "watched", lambda raw: [str(held()), "x" * 1_000_000])
    files = spark.range(0, 300, 1, 1).select("id", F.encode(F.col("id").cast("string"), "utf-8").alias("content"))
    out = pages.extract_pages(files, "watched").select(F.col("pages")[0]["text"].cast("long").alias("mb"), F.length(F.col("pages")[1]["text"]).alias("n")).agg(F.count("n"), F.min("n"), F.max("mb") - F.min("mb")).first()
    assert out[:2] == (300, 1_000_000) and out[2] < 100


@pytest.mark.parametrize("repeat", [1, 40_000])
def test_english_terms_of_long_texts(spark, repeat):
    said = ["Running dogs. ", None, "", "the of ", "caresses ponies "] * 3
    df = spark.createDataFrame([(i, t) for i, t in enumerate(said)], "id long, t string").coalesce(1).withColumn("t", F.repeat("t", F.lit(repeat)))
    got = {r["id"]: (r["n"], r["first"]) for r in df.select("id", english.english_terms(F.col("t")).alias("x")).select("id", F.size("x").alias("n"), F.slice("x", 1, 2).alias("first")).collect()}
    want = [english.analyse(t) for t in said]
    assert got == {i: (len(w) * (repeat if w else 1), w[:2]) for i, w in enumerate(want)}
