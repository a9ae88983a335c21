"""Hard negatives by a two-dimensional block matrix product, SUMMA-style.

Rows are dealt over blocks and components over chunks. A task multiplies a chunk of a block of anchors with the same chunk
of a block of rows, which gives a partial tile of int64 scores; the partial tiles of a pair of blocks meet in a shuffle,
are added and reduced to each window's best. That is done twice: first over rows of the anchors' own labels, where a
window is an anchor and its best are its positives; then over all rows, where a window is an anchor and a positive, and
its best are the rows of other labels whose scores lie between a share of the positive's and all of it.

For the first product blocks are made within packs of labels, so that only blocks which may share a label meet; a label
of any size is spread over as many blocks as it needs. Each block is one row of bytes, a partial tile as well.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from folioscan.llm.common import materialise, table
from folioscan.llm.voronoi_knn import quantise

#: Rows of a block, anchors of a block, components of a chunk (wider where there would be more than CHUNKS chunks).
ROWS, ANCHORS, CHUNK, CHUNKS = 4096, 256, 32, 8
PACKED = "pack long, block long, others long, chunk int, cells binary, about binary"


def _ints(*columns: np.ndarray) -> bytes:
    """Columns of int64 as bytes, one after the other."""
    return np.concatenate([np.asarray(c, dtype=np.int64).ravel() for c in columns]).tobytes() if columns else b""


def _columns(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, dtype=np.int64).reshape(n, -1)


def _packed(rows: DataFrame, chunk: int, width: int, about: list[str]) -> DataFrame:
    """rows (pack, block, others, row, v, ...) as one row for each block and chunk of components; `about` are int64 columns that go with chunk 0."""

    def pack(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("row", ignore_index=True)
        cells = np.zeros((len(b), width))
        for i, v in enumerate(b["v"]):
            cells[i, : len(v)] = v
        starts = range(0, width, chunk)
        return pd.DataFrame(
            {
                "pack": key[0],
                "block": key[1],
                "others": b["others"].iloc[0],
                "chunk": np.arange(len(starts), dtype=np.int32),
                "cells": [np.ascontiguousarray(cells[:, s : s + chunk]).tobytes() for s in starts],
                "about": [_ints(*[np.concatenate(b[c].to_numpy()) if b[c].dtype == object else b[c] for c in about]) if s == 0 else None for s in starts],
            }
        )

    return rows.groupBy("pack", "block").applyInPandas(pack, PACKED)


def _multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for r in b.itertuples(index=False):
            width = r.width
            left, right = np.frombuffer(r.a_cells).reshape(-1, width), np.frombuffer(r.cells).reshape(-1, width)
            tile = (left @ right.T).astype(np.int64)  # sums of whole numbers, exact up to 2**53
            yield pd.DataFrame({"pack": [r.pack], "a_block": [r.a_block], "block": [r.block], "tile": [tile.tobytes()], "a_about": [r.a_about], "about": [r.about]})


def score_tiles(anchors: DataFrame, rows: DataFrame, chunk: int, width: int, reduce: Callable[[np.ndarray, np.ndarray, np.ndarray], pd.DataFrame], schema: str) -> DataFrame:
    """What `reduce` makes of each tile: the scores (anchors x rows) of a block of anchors with a block of rows of its pack, and what is known about either (int64 columns, one after the other).

    anchors, rows: as _packed gives them; `others` is how many blocks of the other kind the pack has."""
    spread = lambda b: F.explode(F.sequence(F.lit(0).cast("long"), F.col("others") - 1))
    left = anchors.select("pack", F.col("block").alias("a_block"), "chunk", F.col("cells").alias("a_cells"), F.col("about").alias("a_about"), spread("a").alias("block"))
    right = rows.select("pack", "block", "chunk", "cells", "about", spread("b").alias("a_block"))
    last = (width - 1) // chunk
    wide = F.when(F.col("chunk") == last, width - last * chunk).otherwise(chunk).cast("int")
    met = left.join(right.hint("shuffle_merge"), ["pack", "a_block", "block", "chunk"]).withColumn("width", wide)
    partial = met.mapInPandas(_multiply, "pack long, a_block long, block long, tile binary, a_about binary, about binary")

    def add(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        total = np.frombuffer(b["tile"].iloc[0], dtype=np.int64).copy()
        for t in b["tile"].iloc[1:]:
            total += np.frombuffer(t, dtype=np.int64)
        a_about, about = (next(np.frombuffer(x, dtype=np.int64) for x in b[c] if x is not None) for c in ("a_about", "about"))
        n = len(about) // 3
        return reduce(total.reshape(-1, n), a_about, about.reshape(3, n))

    return partial.groupBy("pack", "a_block", "block").applyInPandas(add, schema)


def _top(scores: np.ndarray, allowed: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best allowed ones, ties to the smaller id."""
    at = np.flatnonzero(allowed)
    if len(at) > k:
        least = np.partition(scores[at], len(at) - k)[len(at) - k]
        at = at[scores[at] >= least]
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def mine(vectors: DataFrame, anchors: Column, id_col: str, label_col: str, vector_col: str, positives: int = 5, negatives: int = 5, low: int = 80, scale: int = 256, rows_a_block: int = ROWS, anchors_a_block: int = ANCHORS, chunk: int = CHUNK) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    For each row where `anchors` holds and each of its best rows of its own label (`positives` of them), the best rows of
    other labels (`negatives`) whose scores are at least `low` hundredths of the positive's and at most all of it. Scores
    are inner products of floor(scale * component); ties go to the smaller id. Rows take no part whose id, label or vector
    is null or whose vector holds a null, NaN or infinite component. Each row counts, repeated ids and repeated rows
    too; only an anchor's own row is left out. Shorter vectors count as ending in zeros. Anchors without positives, or
    positives without such negatives, give no rows, nor does an empty table. Scores are exact up to 2**53."""
    spark = vectors.sparkSession
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), quantise(F.col(vector_col), scale).alias("v"), F.coalesce(anchors, F.lit(False)).alias("is_anchor")).where("v IS NOT NULL")
    rows = materialise(rows.withColumn("row", F.monotonically_increasing_id()), "mine-rows")
    known = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("is_anchor").cast("long")).alias("anchors"), F.max(F.size("v")).alias("width")).first()
    if not known["anchors"]:
        return spark.createDataFrame([], schema)
    width = max(1, known["width"])
    chunk = max(chunk, -(-width // CHUNKS))
    deal = lambda parts: F.pmod(F.xxhash64("row"), parts)
    blocks = lambda n, most: F.ceil(n / most).cast("long")

    packs = max(1, known["n"] // rows_a_block)
    labelled = rows.withColumn("pack", F.pmod(F.xxhash64("label"), F.lit(packs)))
    sizes = labelled.groupBy(F.col("pack").alias("_pack")).agg(blocks(F.count(F.lit(1)), rows_a_block).alias("n_rows"), blocks(F.sum(F.col("is_anchor").cast("long")), anchors_a_block).alias("n_anchors"))
    sized = materialise(labelled.join(sizes, F.col("pack") == F.col("_pack")).where("n_anchors > 0").drop("_pack"), "mine-packs")

    def own_label(scores: np.ndarray, a_about: np.ndarray, about: np.ndarray) -> pd.DataFrame:
        a_row, a_label = a_about.reshape(2, -1)
        row, id_, label = about
        found = [(a, _top(s, (label == own) & (row != a), id_, positives), s) for a, own, s in zip(a_row, a_label, scores, strict=True)]
        at = np.concatenate([t for _, t, _ in found])
        return pd.DataFrame({"a_row": np.repeat([a for a, _, _ in found], [len(t) for _, t, _ in found]), "id": id_[at], "row": row[at], "score": np.concatenate([s[t] for _, t, s in found])})

    def best(part: DataFrame, k: int, *window: str) -> DataFrame:
        order = Window.partitionBy(*window).orderBy(F.col("score").desc(), "id", "row")
        return part.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    left = _packed(sized.where("is_anchor").select("pack", deal(F.col("n_anchors")).alias("block"), F.col("n_rows").alias("others"), "row", "label", "v"), chunk, width, ["row", "label"])
    right = _packed(sized.select("pack", deal(F.col("n_rows")).alias("block"), F.col("n_anchors").alias("others"), "row", "id", "label", "v"), chunk, width, ["row", "id", "label"])
    near = best(score_tiles(left, right, chunk, width, own_label, "a_row long, id long, row long, score long"), positives, "a_row")
    near = materialise(near.select("a_row", "rank", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "mine-positives")

    with_rank = near.groupBy("a_row").agg(F.sort_array(F.collect_list(F.struct("rank", "positive_score"))).alias("_p"))  # at most `positives` each
    none = -(2**63)
    wanted = rows.where("is_anchor").join(with_rank, F.col("row") == F.col("a_row")).withColumn("bounds", F.transform(F.sequence(F.lit(0), F.lit(positives - 1)), lambda i: F.coalesce(F.get("_p", i)["positive_score"], F.lit(none).cast("long"))))
    n_rows, n_anchors = -(-known["n"] // rows_a_block), -(-known["anchors"] // anchors_a_block)

    def other_labels(scores: np.ndarray, a_about: np.ndarray, about: np.ndarray) -> pd.DataFrame:
        n = len(scores)
        a_row, a_label, bounds = a_about[:n], a_about[n : 2 * n], a_about[2 * n :].reshape(n, positives)
        row, id_, label = about
        out = []
        for a, own, tops, s in zip(a_row, a_label, bounds, scores, strict=True):
            other = label != own
            for i, p in enumerate(tops):
                if p == none:
                    continue
                t = _top(s, other & (100 * s >= low * p) & (s <= p), id_, negatives)
                out.append((a, i + 1, t, s))
        at = np.concatenate([t for _, _, t, _ in out]) if out else np.zeros(0, dtype=np.int64)
        sizes_ = [len(t) for _, _, t, _ in out]
        return pd.DataFrame({"a_row": np.repeat([a for a, *_ in out], sizes_).astype(np.int64), "place": np.repeat([p for _, p, _, _ in out], sizes_).astype(np.int32), "id": id_[at], "row": row[at], "score": np.concatenate([s[t] for *_, t, s in out]) if out else at})

    one = F.lit(0).cast("long").alias("pack")
    left = _packed(wanted.select(one, deal(F.lit(n_anchors)).alias("block"), F.lit(n_rows).cast("long").alias("others"), "row", "label", "v", "bounds"), chunk, width, ["row", "label", "bounds"])
    right = _packed(rows.select(one, deal(F.lit(n_rows)).alias("block"), F.lit(n_anchors).cast("long").alias("others"), "row", "id", "label", "v"), chunk, width, ["row", "id", "label"])
    hard = best(score_tiles(left, right, chunk, width, other_labels, "a_row long, place int, id long, row long, score long"), negatives, "a_row", "place")
    named = hard.select(F.col("a_row").alias("_a"), "place", F.col("rank").alias("_rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    ids = rows.where("is_anchor").select(F.col("row").alias("_row"), F.col("id").alias("anchor_id"))
    out = near.join(named, (F.col("a_row") == F.col("_a")) & (F.col("rank") == F.col("place"))).join(ids, F.col("a_row") == F.col("_row"))
    return out.select("anchor_id", "positive_id", F.col("_rank").alias("rank"), "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: anchors' ids are divisible by 100; a seventh of the labels is shifted by one."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label")).alias("label"))
    return mine(rows, F.col("vec_id") % 100 == 0, "vec_id", "label", "embedding")


OP12_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.r AS a, a.vec_id AS anchor_id, b.vec_id AS other, b.r AS b, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM v a JOIN v b ON a.r <> b.r WHERE a.vec_id % 100 = 0
), p AS (
  SELECT a, anchor_id, other AS positive_id, b, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, other) <= 5
)
SELECT p.anchor_id, positive_id, (row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.other))::INT AS rank, s.other AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.a = p.a AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score QUALIFY rank <= 5
"""
