"""Connected components of a table of links, by contraction.

Each task first reduces its own links to a forest, LINKS of them at a time. In a round, every node goes over to that of
its neighbours (or itself) whose id hashes lowest, and links are drawn between the nodes that are left; in a random
order that halves a path and swallows a star at once, so rounds grow with the logarithm of the longest path. Least
neighbours are pre-aggregated, and joins with a hub's links are split by adaptive execution. Each round's tables are in
the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from folioscan.llm.common import materialise

LINKS = 200_000


def _forest(links: DataFrame) -> DataFrame:
    """As few links between the same nodes as a task can tell by itself; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}

        def find(x: int) -> int:
            while up[x] != x:
                up[x] = x = up[up[x]]
            return x

        def out() -> pa.RecordBatch:
            pairs = [(x, r) for x in up if (r := find(x)) != x]
            up.clear()
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.int64()), pa.array([r for _, r in pairs], pa.int64())], names=["u", "v"])

        for b in batches:
            for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                up.setdefault(u, u)
                up.setdefault(v, v)
                up[find(u)] = find(v)
            if len(up) > LINKS:
                yield out()
        yield out()

    return links.select("u", "v").mapInArrow(run, "u long, v long")


def components(links: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(node, root) for every node that links (u, v) join to another: root is one of the component's nodes. Repeated links and loops are fine."""
    edges = materialise(_forest(links.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"))), "links")
    named = None
    for _ in range(most_rounds):
        ways = edges.union(edges.select("v", "u"))
        low = F.least(F.min(F.struct(F.xxhash64("v").alias("h"), F.col("v").alias("to"))), F.struct(F.xxhash64(F.first("u")).alias("h"), F.first("u").alias("to")))
        goes = materialise(ways.groupBy(F.col("u").alias("node")).agg(low["to"].alias("root")), "links-goes")
        if named is None:
            named = goes
        else:
            over = goes.select(F.col("node").alias("root"), F.col("root").alias("_next"))
            named = materialise(named.join(over, "root", "left").select("node", F.coalesce("_next", "root").alias("root")), "links-named")
        left = edges.join(goes.withColumnsRenamed({"node": "u", "root": "_u"}), "u").join(goes.withColumnsRenamed({"node": "v", "root": "_v"}), "v")
        edges = materialise(_forest(left.select(F.col("_u").alias("u"), F.col("_v").alias("v")).where("u <> v")), "links")
        if not edges.take(1):
            return named
    raise RuntimeError(f"links did not contract in {most_rounds} rounds")
