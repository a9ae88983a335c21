"""A stored inverted file for vectors: rows by cell, codes of what a cell's centre leaves over, searches that read few cells.

Vectors are scaled to unit length, so that the order by cosine is the order by distance. Centres come from k-means over a
bounded sample. An index is a folder with four tables:

    centres   cell, centre; key and scope, which are null and have their types
    sizes     cell, n, far: counts and largest distances to the centre, a row for each cell and each time rows were added
    lists     packed codes, up to PACK rows of one cell and scope in each: keys, int8 codes of residuals, scales, errors
    rows      key, scope, vector

The last two are partitioned by cell. A search goes to the cells whose centres are nearest; it multiplies the codes there,
whose errors are known, and reads the vectors of those rows only whose upper bound reaches a query's k-th lower bound.
So its answers are the best of the cells that it reads. An exact search goes on to every cell that can hold a better row:
|x - centre| <= far gives q.x <= q.centre + far.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from folioscan.functions.vectors import cosine_similarity, norm
from folioscan.sources.tables import scratch

#: Cells at most, rows of the sample for each cell, rows of a packed list, queries of a block, vectors that meet all centres at once, what rounding may add to a bound.
CELLS, SAMPLE, PACK, BLOCK, MEET, SLACK = 1024, 64, 1024, 256, 512, 1e-6


def _parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches in slices of MEET rows: matrices of vectors by centres stay small."""
    for b in batches:
        for i in range(0, len(b), MEET):
            yield b.iloc[i : i + MEET].reset_index(drop=True)


def _units(vectors: pd.Series) -> np.ndarray:
    x = np.array(vectors.tolist(), dtype=np.float64).reshape(len(vectors), -1)
    return x / np.sqrt((x * x).sum(1))[:, None]


def _usable(vector: Column, width: int | None = None) -> Column:
    whole = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & (norm(vector) > 0)
    return F.coalesce(whole if width is None else (F.size(vector) == width) & whole, F.lit(False))


class VectorIndex:
    """An index that has been built. `centres` are CELLS rows at most."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        cells = spark.read.parquet(f"{path}/centres")
        key, scope, cell = cells.schema["key"], cells.schema["scope"], cells.schema["cell"]
        self.key_type = key.dataType
        self.rows_type = StructType([key, scope, *StructType.fromDDL("vector array<float>"), cell])
        self.lists_type = StructType([StructField("keys", ArrayType(self.key_type)), scope, *StructType.fromDDL("codes binary, scales binary, errors binary"), cell])
        held = cells.select("cell", "centre").orderBy("cell").toPandas()
        self.centres = np.array(held["centre"].tolist(), dtype=np.float64).reshape(len(held), -1)

    @property
    def width(self) -> int:
        return self.centres.shape[1]

    def sizes(self) -> tuple[np.ndarray, np.ndarray]:
        """Each cell's count and largest distance to its centre."""
        n, far = np.zeros(len(self.centres), dtype=np.int64), np.zeros(len(self.centres))
        for r in self.spark.read.parquet(f"{self.path}/sizes").groupBy("cell").agg(F.sum("n").alias("n"), F.max("far").alias("far")).collect():  # a row for each cell
            n[r["cell"]], far[r["cell"]] = r["n"], r["far"]
        return n, far

    def add(self, rows: DataFrame, key: str, vector: str, scope: str | None = None) -> None:
        """Adds rows to the cells of their nearest centres. Rows without a key and vectors that are null, zero, of another width or not finite are passed over."""
        centres = self.centres
        held = rows.where(F.col(key).isNotNull() & _usable(F.col(vector), self.width))
        held = held.select(F.col(key).alias("key"), (F.col(scope) if scope else F.lit(None).cast("string")).alias("scope"), F.col(vector).cast("array<float>").alias("vector"))

        def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in _parts(batches):
                x = _units(b["vector"])
                cell = ((centres * centres).sum(1)[None, :] - 2 * x @ centres.T).argmin(1)
                rest = x - centres[cell]
                scale = np.maximum(np.abs(rest).max(1) / 127, 1e-300)
                codes = np.clip(np.rint(rest / scale[:, None]), -127, 127).astype(np.int8)
                error = np.sqrt(((rest - codes * scale[:, None]) ** 2).sum(1))
                yield b.assign(code=[c.tobytes() for c in codes], scale=scale, error=error, far=np.sqrt((rest * rest).sum(1)), cell=cell.astype(np.int32))

        fields = [*held.schema.fields, *StructType.fromDDL("code binary, scale double, error double, far double, cell int").fields]
        work = scratch(self.spark, "placed")
        held.mapInPandas(place, StructType(fields)).write.parquet(work)
        placed = self.spark.read.schema(StructType(fields)).parquet(work)
        placed.select("key", "scope", "vector", "cell").hint("rebalance", "cell").write.partitionBy("cell").mode("append").parquet(f"{self.path}/rows")

        def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                runs = b.groupby(["cell", "scope"], sort=False, dropna=False)
                for (cell, scope_), r in runs:
                    for i in range(0, len(r), PACK):
                        p = r.iloc[i : i + PACK]
                        yield pd.DataFrame({"keys": [p["key"].tolist()], "scope": [None if pd.isna(scope_) else scope_], "codes": [b"".join(p["code"])], "scales": [p["scale"].to_numpy().tobytes()], "errors": [p["error"].to_numpy().tobytes()], "cell": [cell]})

        near = placed.select("key", "scope", "code", "scale", "error", "cell").hint("rebalance", "cell").sortWithinPartitions("cell", "scope")
        near.mapInPandas(pack, self.lists_type).write.partitionBy("cell").mode("append").parquet(f"{self.path}/lists")
        placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far")).coalesce(1).write.mode("append").parquet(f"{self.path}/sizes")

    def _asked(self, queries: DataFrame) -> DataFrame:
        return queries.where(F.col("query_id").isNotNull() & _usable(F.col("vector"), self.width)).select("query_id", F.col("vector").cast("array<float>").alias("vector"), "least")

    def _answers(self, asked: DataFrame, choose, k: int, scope: Column | None) -> DataFrame:
        """(query_id, key, cell, similarity): the k best rows of the cells that `choose` names for each query, and perhaps more; choose(unit vectors, least) gives a boolean matrix, queries x cells."""
        centres, schema = self.centres, asked.schema

        def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in _parts(batches):
                x = _units(b["vector"])
                wanted = choose(x, b["least"].to_numpy())
                for cell in np.flatnonzero(wanted.any(0)):
                    at = np.flatnonzero(wanted[:, cell])
                    for i in range(0, len(at), BLOCK):
                        t = at[i : i + BLOCK]
                        yield pd.DataFrame({"q_cell": [np.int32(cell)], "q_ids": [b["query_id"].iloc[t].tolist()], "q_units": [x[t].tobytes()], "q_least": [b["least"].to_numpy()[t].tobytes()]})

        ids = StructField("q_ids", ArrayType(schema["query_id"].dataType))
        work = scratch(self.spark, "probes")
        shape = StructType([StructField("q_cell", IntegerType()), ids, *StructType.fromDDL("q_units binary, q_least binary").fields])
        asked.mapInPandas(probe, shape).write.parquet(work)
        probes = self.spark.read.schema(shape).parquet(work)
        cells = sorted(r[0] for r in probes.select("q_cell").distinct().collect())  # CELLS at most
        lists = self.spark.read.schema(self.lists_type).parquet(f"{self.path}/lists").where(F.col("cell").isin(cells))
        lists = lists.where(scope) if scope is not None else lists

        def bound(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for r in b.itertuples(index=False):
                    q, scales, errors = np.frombuffer(r.q_units).reshape(len(r.q_ids), -1), np.frombuffer(r.scales), np.frombuffer(r.errors)
                    codes = np.frombuffer(r.codes, dtype=np.int8).reshape(len(scales), -1)
                    about = (q @ centres[r.cell])[:, None] + (q @ codes.T.astype(np.float64)) * scales[None, :]
                    low, high = about - errors - SLACK, about + errors + SLACK
                    least = np.frombuffer(r.q_least) - SLACK
                    if len(scales) > k:
                        least = np.maximum(least, np.partition(low, len(scales) - k, axis=1)[:, len(scales) - k])
                    at, to = np.nonzero(high >= least[:, None])
                    keys = np.empty(len(r.keys), dtype=object)
                    keys[:] = list(r.keys)
                    yield pd.DataFrame({"query_id": [r.q_ids[i] for i in at], "key": keys[to], "cell": np.int32(r.cell), "low": low[at, to], "high": high[at, to]})

        found = StructType([schema["query_id"], StructField("key", self.key_type), *StructType.fromDDL("cell int, low double, high double").fields])
        work = scratch(self.spark, "bounds")
        lists.join(probes, F.col("cell") == F.col("q_cell")).mapInPandas(bound, found).write.parquet(work)
        bounds = self.spark.read.schema(found).parquet(work)
        order = Window.partitionBy("query_id").orderBy(F.col("low").desc())
        kth = bounds.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).groupBy(F.col("query_id").alias("_q")).agg(F.min("low").alias("_low"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= k)
        survive = bounds.join(kth, F.col("query_id") == F.col("_q"), "left").where(F.col("_low").isNull() | (F.col("high") >= F.col("_low"))).select("query_id", "key", "cell")
        rows = self.spark.read.schema(self.rows_type).parquet(f"{self.path}/rows").where(F.col("cell").isin(cells))
        rows = rows.where(scope) if scope is not None else rows
        rows = rows.select(F.col("key").alias("_key"), F.col("cell").alias("_cell"), F.col("vector").alias("_row"))
        return survive.distinct().join(rows, (F.col("key") == F.col("_key")) & (F.col("cell") == F.col("_cell"))).join(asked.select(F.col("query_id").alias("_q"), "vector"), F.col("query_id") == F.col("_q")).select("query_id", "key", "cell", cosine_similarity(F.col("_row"), F.col("vector")).alias("similarity"))

    def search(self, queries: DataFrame, k: int, probes: int | None, scope: Column | None = None) -> DataFrame:
        """(query_id, key, cell, similarity, rank) for queries (query_id, vector): each one's k best rows by cosine, ties to the smaller key.

        probes: how many cells are searched for each query; None: as many as it takes to find the very best. scope: a
        condition on the column `scope`. A key that was added twice counts twice. Queries whose vectors are null, zero, of
        another width or not finite have no answers; an empty index gives none."""
        centres = self.centres
        asked = self._asked(queries.select("query_id", "vector", F.lit(-2.0).alias("least")))
        first = max(1, min(len(centres), probes or -(-len(centres) // 16)))

        def nearest(x: np.ndarray, least: np.ndarray) -> np.ndarray:
            return cell_ranks(x, centres) < first

        near = self._answers(asked, nearest, k, scope)
        if probes is None and first < len(centres):
            near = self._kept(near, "near")
            kth = near.withColumn("_r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("similarity").desc()))).where(F.col("_r") == k).select(F.col("query_id").alias("_q"), F.col("similarity").alias("_least"))
            again = self._kept(asked.join(kth, F.col("query_id") == F.col("_q"), "left").select("query_id", "vector", F.coalesce("_least", "least").alias("least")), "again")
            n, far = self.sizes()

            def further(x: np.ndarray, least: np.ndarray) -> np.ndarray:
                return (x @ centres.T + far[None, :] + SLACK >= least[:, None]) & (n > 0)[None, :] & (cell_ranks(x, centres) >= first)

            near = near.unionByName(self._answers(again, further, k, scope))
        best = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), "key")
        return near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "key", "cell", "similarity", "rank")

    def _kept(self, df: DataFrame, name: str) -> DataFrame:
        work = scratch(self.spark, name)
        df.write.parquet(work)
        return self.spark.read.schema(df.schema).parquet(work)

    def probes_for(self, queries: DataFrame, k: int, recall: float) -> int:
        """The fewest cells for each query that give this share of the true answers of some queries (a bounded sample of a user's own)."""
        best = self.search(queries, k, None).select("query_id", "cell")
        centres = self.centres

        def ranks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in _parts(batches):
                yield pd.DataFrame({"place": cell_ranks(_units(b["vector"]), centres)[np.arange(len(b)), b["cell"].to_numpy()]})

        placed = best.join(self._asked(queries.withColumn("least", F.lit(0.0))), "query_id").select("cell", "vector").mapInPandas(ranks, "place long")
        counts = placed.groupBy("place").count().orderBy("place").collect()  # a row for each cell at most
        total, seen = sum(r["count"] for r in counts), 0
        for r in counts:
            seen += r["count"]
            if seen >= recall * total:
                return r["place"] + 1
        return len(centres)


def cell_ranks(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Each cell's place, from 0, in a query's order of cells by the distance of their centres; ties to the smaller cell."""
    order = np.argsort((centres * centres).sum(1)[None, :] - 2 * x @ centres.T, axis=1, kind="stable")
    out = np.empty_like(order)
    np.put_along_axis(out, order, np.arange(len(centres))[None, :], axis=1)
    return out


def build_index(rows: DataFrame, path: str, key: str, vector: str, scope: str | None = None, cells: int | None = None, sample: int = SAMPLE, seed: int = 7) -> VectorIndex:
    """An index of rows at a new path. cells: about the root of their number, CELLS at most; centres are fitted to about `sample` rows for each cell, all rows are indexed.

    Vectors of the largest width count. There is an index of no rows: one centre of one component, and no answers."""
    spark = rows.sparkSession
    held = rows.where(F.col(key).isNotNull() & _usable(F.col(vector)))
    known = held.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(vector)).alias("width")).first()
    n, width = known["n"], known["width"] or 1
    cells = max(1, min(CELLS, cells or round(n**0.5)))
    share = max(1, n // (cells * sample))
    unit = F.transform(vector, lambda c: c.cast("double") / norm(F.col(vector)))
    few = held.where((F.size(vector) == width) & (F.pmod(F.xxhash64(F.lit(seed), key), F.lit(share)) == 0)).select(array_to_vector(unit).alias("features"))
    if n:
        model = KMeans(k=cells, seed=seed, maxIter=10).fit(few)
        centres = [c.tolist() for c in model.clusterCenters()]
    else:
        centres = [[0.0] * width]
    key_type, scope_type = rows.schema[key].dataType, rows.schema[scope].dataType if scope else StringType()
    typed = [F.lit(None).cast(key_type).alias("key"), F.lit(None).cast(scope_type).alias("scope")]
    spark.createDataFrame(list(enumerate(centres)), "cell int, centre array<double>").select("cell", "centre", *typed).coalesce(1).write.parquet(f"{path}/centres")
    for name, schema in (("rows", "vector array<float>"), ("lists", "codes binary")):  # the folders are there without any row
        spark.createDataFrame([], schema).write.parquet(f"{path}/{name}/cell=0")
    spark.createDataFrame([], "cell int, n long, far double").write.parquet(f"{path}/sizes")
    index = VectorIndex(spark, path)
    index.add(rows, key, vector, scope)
    return index
