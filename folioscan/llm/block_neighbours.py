"""Nearest neighbours by a block matrix join: products of int8 codes bound distances, what survives is computed in double.

A vector x is coded as s * c with whole c of at most 127 in size; e = |x - s c| is known exactly. By the triangle
inequality the distance of two vectors differs from that of their codes by the sum of their e at most. Rows and queries
are packed into blocks, one row of bytes each. For a pair of blocks the codes' product gives all distances of codes; a
query's k-th smallest upper bound rules out what has a larger lower bound, and only the survivors' distances are computed
from the vectors themselves. Each tile leaves sorted heaps, k entries for a query, which are merged FAN tiles at a time
until one is left. So the result is exact; the bounds only decide what needn't be computed.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import groupby, islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from folioscan.llm.common import materialise, table

#: Bytes of a block's vectors and codes; queries that a task multiplies at once; tiles that are merged at once.
BLOCK_BYTES, SLICE, FAN = 4 << 20, 256, 32
#: What a bound gives way to rounding, as a share of both lengths.
SLACK = 1e-7
#: An entry of a heap, in the order in which entries are compared.
ENTRY = np.dtype([("query", "i8"), ("score", "f8"), ("id", "i8"), ("row", "i8"), ("query_id", "i8")])
BLOCK = "block long, rows binary, ids binary, cells binary, codes binary, scales binary, errors binary"


def encode(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, their scales, and the length of what a code leaves out, for each row."""
    with np.errstate(all="ignore"):
        scale = np.abs(cells).max(1) / 127
        scale = np.where((scale > 0) & np.isfinite(1 / scale), scale, 1.0)
        codes = np.clip(np.rint(cells / scale[:, None]), -127, 127).astype(np.int8)
        error = np.sqrt(((cells - codes * scale[:, None]) ** 2).sum(1))
    return codes, scale, error


def code_distances(a: np.ndarray, a_scale: np.ndarray, b: np.ndarray, b_scale: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distances between the vectors that codes stand for, and how far rounding may put them off."""
    product = np.zeros((len(a), len(b)))
    for i in range(0, a.shape[1], 1024):  # 1,024 products of int8 are exact in float32
        product += a[:, i : i + 1024].astype(np.float32) @ b[:, i : i + 1024].astype(np.float32).T
    a_square, b_square = (a.astype(np.float64) ** 2).sum(1) * a_scale**2, (b.astype(np.float64) ** 2).sum(1) * b_scale**2
    square = a_square[:, None] + b_square[None, :] - 2 * product * a_scale[:, None] * b_scale[None, :]
    return np.sqrt(np.maximum(square, 0)), SLACK * (np.sqrt(a_square)[:, None] + np.sqrt(b_square)[None, :])


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean, row by row, in double precision, components added in order."""
    return np.sqrt(np.add.accumulate((x - y) ** 2, axis=1)[:, -1])


def _tile(r, k: int) -> np.ndarray:
    """The heaps of a pair of blocks."""
    queries, rows = (np.frombuffer(x, dtype=np.int64) for x in (r.q_rows, r.rows))
    query_ids, ids = (np.frombuffer(x, dtype=np.int64) for x in (r.q_ids, r.ids))
    q, x = np.frombuffer(r.q_cells).reshape(len(queries), -1), np.frombuffer(r.cells).reshape(len(rows), -1)
    q_codes, codes = np.frombuffer(r.q_codes, dtype=np.int8).reshape(q.shape), np.frombuffer(r.codes, dtype=np.int8).reshape(x.shape)
    q_scale, scale, q_error, error = (np.frombuffer(v) for v in (r.q_scales, r.scales, r.q_errors, r.errors))
    found = []
    for i in range(0, len(q), SLICE):
        part = slice(i, i + SLICE)
        about, give = code_distances(q_codes[part], q_scale[part], codes, scale)
        give = give + q_error[part][:, None] + error[None, :]
        own = queries[part][:, None] == rows[None, :]
        upper = np.where(own, np.inf, about + give)
        bound = np.partition(upper, k - 1, axis=1)[:, k - 1] if upper.shape[1] > k else np.full(len(upper), np.inf)
        at, to = np.nonzero(~(about - give > bound[:, None]) & ~own)  # what can't be compared survives
        for start in range(0, len(at), 1 << 15):
            a, b = at[start : start + (1 << 15)], to[start : start + (1 << 15)]
            e = np.empty(len(a), dtype=ENTRY)
            e["query"], e["score"], e["id"], e["row"], e["query_id"] = a + i, distances(q[a + i], x[b]), ids[b], rows[b], query_ids[a + i]
            found.append(e)
    return best(found, k)


def best(parts: list[np.ndarray], k: int) -> np.ndarray:
    """Each query's k first entries of several parts, sorted: a query's part is cut to a heap of k first, then heaps are merged."""
    heaps = []
    for p in parts:
        p = p[np.argsort(p["query"], kind="stable")]
        ends = np.flatnonzero(np.diff(p["query"], append=-1)) + 1
        for one in np.split(p, ends[:-1]) if len(p) else []:
            if len(one) > k:  # ties at the k-th stay until the heap has seen them
                one = one[~(one["score"] > np.partition(one["score"], k - 1)[k - 1])]
            heaps.append(heapq.nsmallest(k, one.tolist()))
    heaps.sort(key=lambda h: h[0][0])
    out: list[tuple] = []
    for _, same in groupby(heaps, key=lambda h: h[0][0]):
        out += islice(heapq.merge(*same), k)
    return np.array(out, dtype=ENTRY)


def _merge(parts: list[bytes], k: int) -> bytes:
    """Sorted heaps of several tiles of the same queries."""
    each = heapq.merge(*[np.frombuffer(p, dtype=ENTRY).tolist() for p in parts])
    return np.array([e for _, same in groupby(each, key=lambda e: e[0]) for e in islice(same, k)], dtype=ENTRY).tobytes()


def nearest(vectors: DataFrame, queries: Column, k: int, id_col: str, vector_col: str, block_bytes: int = BLOCK_BYTES, fan: int = FAN) -> DataFrame:
    """query_id, rank (from 1), id, score: for each row where `queries` holds, the k nearest others by Euclidean distance, ties to the smaller id.

    Rows take no part whose id or vector is null, whose vector is zero or empty, or holds a null, NaN or infinite
    component. Each other row counts, repeated ids and repeated rows too; only a query's own row is left out. Shorter
    vectors count as ending in zeros. A query with fewer than k others gets them all; one alone, none. An empty table
    gives no rows. `k` is at least 1."""
    spark = vectors.sparkSession
    schema = "query_id long, rank int, id long, score double"
    v = F.col(vector_col).cast("array<double>")
    whole = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(v, lambda c: c != 0)
    rows = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.when(whole, v).alias("v"), F.coalesce(queries, F.lit(False)).alias("is_query")).where("v IS NOT NULL")
    rows = materialise(rows.withColumn("row", F.monotonically_increasing_id()), "nearest-rows")
    known = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("is_query").cast("long")).alias("queries"), F.max(F.size("v")).alias("width")).first()
    if not known["queries"]:
        return spark.createDataFrame([], schema)
    width = known["width"]
    most = max(16, block_bytes // (9 * width))
    n_rows, n_queries = -(-known["n"] // most), -(-known["queries"] // most)

    def pack(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        cells = np.zeros((len(b), width))
        for i, x in enumerate(b["v"]):
            cells[i, : len(x)] = x
        codes, scale, error = encode(cells)
        return pd.DataFrame({"block": key[0], "rows": [b["row"].to_numpy().tobytes()], "ids": [b["id"].to_numpy().tobytes()], "cells": [cells.tobytes()], "codes": [codes.tobytes()], "scales": [scale.tobytes()], "errors": [error.tobytes()]})

    def packed(part: DataFrame, blocks: int) -> DataFrame:
        return part.groupBy(F.pmod(F.xxhash64("row"), F.lit(blocks)).alias("block")).applyInPandas(pack, BLOCK)

    spread = lambda blocks: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    asked = packed(rows.where("is_query"), n_queries)
    asked = asked.select(F.col("block").alias("q_block"), *[F.col(c).alias(f"q_{c}") for c in asked.columns if c != "block"], spread(n_rows).alias("block"))
    met = asked.join(packed(rows, n_rows).withColumn("q_block", spread(n_queries)).hint("shuffle_merge"), ["q_block", "block"])

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                yield pd.DataFrame({"q_block": [r.q_block], "part": [r.block], "heaps": [_tile(r, k).tobytes()]})

    heaps, parts = materialise(met.mapInPandas(solve, "q_block long, part long, heaps binary"), "nearest-heaps"), n_rows
    while parts > 1:
        group = F.floor(F.col("part") / fan).alias("part")
        merge = lambda key, b: pd.DataFrame({"q_block": [key[0]], "part": [key[1]], "heaps": [_merge(list(b["heaps"]), k)]})
        heaps, parts = heaps.groupBy("q_block", group).applyInPandas(merge, "q_block long, part long, heaps binary"), -(-parts // fan)

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for h in b["heaps"]:
                e = np.frombuffer(h, dtype=ENTRY)
                first = np.searchsorted(e["query"], e["query"])
                yield pd.DataFrame({"query_id": e["query_id"], "rank": (np.arange(len(e)) - first + 1).astype(np.int32), "id": e["id"], "score": e["score"]})

    return heaps.mapInPandas(unpack, schema)


def op13_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score: the 10 nearest of every vector whose id is divisible by 100."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 10, "vec_id", "embedding").withColumnRenamed("id", "vec_id")


OP13_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), s AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, sqrt(list_reduce(list_transform(list_zip(q.v, c.v), lambda p: (coalesce(p[1], 0) - coalesce(p[2], 0)) * (coalesce(p[1], 0) - coalesce(p[2], 0))), lambda a, b: a + b)) AS score
  FROM v q JOIN v c ON c.r <> q.r WHERE q.vec_id % 100 = 0
)
SELECT query_id, (row_number() OVER (PARTITION BY r ORDER BY score, vec_id))::INT AS rank, vec_id, score FROM s QUALIFY rank <= 10
"""
