"""Exact top-k search by inner product: a Voronoi kNN join.

Pivots cut space into cells. A cell's summary is its pivot p, its count and its radius r, the largest distance of a
member to p; for a query q every member x has q.p - |q| r <= q.x <= q.p + |q| r. Cells are packed into groups of about
PACK rows, a cell of more rows (copies of one vector, say) being dealt over several. A query is solved in its own group
first. The k-th best score there, or what the summaries alone say if that is more, bounds its k-th best from below; it then
goes only to cells whose upper bound reaches that, and only scores that reach it come back. What is asked of a group is
counted, and the group's rows are copied once for each BATCH of these queries, so not at all if no query needs them; a
task solves a group for a batch as a matrix product, and a query's partial answers are merged. Only the summaries, at most
MAX_PIVOTS rows, are on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from folioscan.llm.common import materialise, table

MAX_PIVOTS, PACK, BATCH = 2048, 2048, 4096


def quantise(x: Column, scale: int = 64) -> Column:
    """floor(scale * component) of each component; null where the vector is null or has a null, NaN or infinite one."""
    whole = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.when(whole, F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("double")))


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    """Rows of one width; shorter vectors end in zeros."""
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _nearest(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    square = (x * x).sum(1)[:, None] - 2 * (x @ pivots.T) + (pivots * pivots).sum(1)[None, :]
    cell = square.argmin(1)
    return cell, np.sqrt(((x - pivots[cell]) ** 2).sum(1))


def needed(q: np.ndarray, pivots: np.ndarray, radius: np.ndarray, count: np.ndarray, k: int, least: np.ndarray | None = None) -> np.ndarray:
    """Which cells may hold one of a query's k best, for each query: a boolean matrix. Bounds give way by a rounding error.

    least: a score that the k-th best has at least, for each query, if it is known."""
    mid, reach = q @ pivots.T, np.sqrt((q * q).sum(1))[:, None] * radius[None, :]
    slack = 1e-6 * (1 + np.abs(mid) + reach)
    low, high = mid - reach - slack, mid + reach + slack
    order = np.argsort(-low, axis=1)
    enough = np.cumsum(count[order], axis=1) >= k + 1  # a query's own row may be one of them
    at = np.where(enough.any(1), enough.argmax(1), 0)
    rows = np.arange(len(q))
    bound = np.where(enough.any(1), low[rows, order[rows, at]], -np.inf)
    if least is not None:
        bound = np.maximum(bound, least)
    return (high >= bound[:, None]) & (count > 0)[None, :]


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> list[np.ndarray]:
    """Positions of each row's k largest finite scores, ties to the smaller id; ids ascend."""
    out = []
    for s in scores:
        keep = np.flatnonzero(np.isfinite(s))
        if len(keep) > k:
            least = np.partition(s[keep], len(keep) - k)[len(keep) - k]
            keep = keep[s[keep] >= least]
        out.append(keep[np.lexsort((ids[keep], -s[keep]))][:k])
    return out


def copies(data: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """data (id, v, pack, ...) and queries (id, v, pack, least, ...) with the batch of a pack in which they meet: queries once, data as often as its pack has batches."""
    batches = asked.groupBy(F.col("pack").alias("_p")).agg(F.ceil(F.count(F.lit(1)) / BATCH).alias("_batches"))
    batches = materialise(batches, "knn-batches")
    dealt = asked.join(batches, F.col("pack") == F.col("_p")).select(*asked.columns, F.pmod(F.xxhash64(F.lit(5), "id"), F.col("_batches")).alias("batch"))
    return data.join(batches, F.col("pack") == F.col("_p")).select(*data.columns, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_batches") - 1)).alias("batch")), dealt


def knn_join(vectors: DataFrame, queries: Column, k: int, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64) -> DataFrame:
    """query_id, rank (from 1), id, score: for each row where `queries` holds, the k others of highest integer inner product.

    Components are floor(scale * x). Ties go to the smaller id. Vectors that are null or hold null, NaN or infinite
    components take no part, nor do rows without an id. Each other row counts, repeated ids and repeated rows too; only a
    query's own row is left out. Shorter vectors count as ending in zeros; empty vectors score 0. A query with fewer than k
    others gets them all; one alone, none. An empty table gives no rows. Scores are exact up to 2**53."""
    spark = vectors.sparkSession
    rows = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("name"), quantise(F.col(vector_col), scale).alias("v"), queries.alias("is_query")).where("v IS NOT NULL")
    rows = materialise(rows.withColumn("id", F.monotonically_increasing_id()), "knn-rows")  # a row is told by its place, as names may repeat
    known = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("width")).first()
    schema = "query_id long, rank int, id long, score long"
    if not known["n"]:
        return spark.createDataFrame([], schema)
    width = max(1, known["width"])
    wanted = int(min(MAX_PIVOTS, max(16, known["n"] ** 0.5 / 2)))
    pivots = _matrix(rows.orderBy(F.xxhash64("id"), "id").limit(wanted).toPandas()["v"], width)  # at most MAX_PIVOTS rows
    pivots = np.unique(pivots, axis=0)

    def assign(batches_: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches_:
            cell, far = _nearest(_matrix(b["v"], width), pivots)
            yield b.assign(cell=cell, far=far)

    placed = materialise(rows.mapInPandas(assign, "name long, v array<double>, is_query boolean, id long, cell int, far double"), "knn-placed")
    cells = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far")).toPandas()  # a row for each pivot
    count, radius = np.zeros(len(pivots), dtype=np.int64), np.zeros(len(pivots))
    count[cells["cell"]], radius[cells["cell"]] = cells["n"], cells["far"]
    first, split, at, room = np.zeros(len(pivots), dtype=np.int64), np.ones(len(pivots), dtype=np.int64), -1, 0
    for c in np.argsort(pivots @ pivots.mean(0)):  # neighbours share a pack
        if count[c] > PACK:
            split[c] = -(-count[c] // PACK)
            first[c], at, room = at + 1, at + split[c], 0
        else:
            if count[c] > room:
                at, room = at + 1, PACK
            first[c], room = at, room - count[c]

    def send(batches_: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches_:
            q = _matrix(b["v"], width)
            for i in range(0, len(b), 512):
                part = b.iloc[i : i + 512]
                want = needed(q[i : i + 512], pivots, radius, count, k, part["least"].to_numpy())
                to = [sorted({int(p) for c in np.flatnonzero(w) for p in range(first[c], first[c] + split[c])} - {own}) for w, own in zip(want, part["pack"], strict=True)]
                yield part.assign(pack=to)[["id", "name", "v", "pack", "least"]].explode("pack", ignore_index=True).dropna(subset=["pack"]).astype({"pack": "int64"})

    def solve(key: tuple, data: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        data = data.sort_values(["name", "id"], ignore_index=True)
        x, ids, names = _matrix(data["v"], width), data["id"].to_numpy(), data["name"].to_numpy()
        found = []
        for i in range(0, len(asked) if len(ids) else 0, 256):
            part = asked.iloc[i : i + 256]
            own = part["id"].to_numpy()
            scores = _matrix(part["v"], width) @ x.T
            scores[(ids[None, :] == own[:, None]) | (scores < part["least"].to_numpy()[:, None])] = -np.inf
            for one, name, top, s in zip(own, part["name"], best(scores, names, k), scores, strict=True):
                found.append(pd.DataFrame({"query": one, "query_id": name, "id": names[top], "score": s[top].astype(np.int64)}))
        return pd.concat(found) if found else pd.DataFrame({"query": [], "query_id": [], "id": [], "score": []}).astype("int64")

    cell = F.col("cell") + 1
    firsts, splits = F.element_at(F.lit(first.tolist()), cell), F.element_at(F.lit(split.tolist()), cell)
    data = placed.select("id", "name", "v", "is_query", (firsts + F.pmod(F.xxhash64(F.lit(3), "id"), splits)).cast("long").alias("pack"))
    rows = data.select("id", "name", "v", "pack")

    def answers(asked: DataFrame) -> DataFrame:
        copied, dealt = copies(rows, asked)
        return copied.groupBy("pack", "batch").cogroup(dealt.groupBy("pack", "batch")).applyInPandas(solve, "query long, query_id long, id long, score long")

    home = materialise(data.where("is_query").select("id", "name", "v", "pack", F.lit(float("-inf")).alias("least")), "knn-home")
    near = materialise(answers(home), "knn-near")
    known_ = near.groupBy(F.col("query").alias("_q")).agg(F.count(F.lit(1)).alias("_n"), F.min("score").cast("double").alias("_least")).where(F.col("_n") >= k)
    far = home.join(known_, F.col("id") == F.col("_q"), "left").select("id", "name", "v", "pack", F.coalesce("_least", "least").alias("least"))
    asked = materialise(far.mapInPandas(send, "id long, name long, v array<double>, pack long, least double"), "knn-asked")
    partial = near.unionByName(answers(asked))
    top = Window.partitionBy("query").orderBy(F.col("score").desc(), "id")
    return partial.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def op6_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score: the 20 best of every vector whose id is divisible by 20."""
    return knn_join(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20).withColumnRenamed("id", "vec_id")


OP6_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON c.r <> q.r WHERE q.vec_id % 20 = 0
)
SELECT query_id, (row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score
FROM s QUALIFY rank <= 20
"""
