"""Pages of a stored order: rows by ranges of their sort key, and how many rows of each scope lie in and before a range.

A page is found in the counts, which name the ranges and the places in them that hold it; nothing else is read, and
nothing is sorted but the page. The number of all rows comes from the same counts.

Below `path`, `rows` has the rows with `_at`, their place in their range, partitioned by `_range`; `counts` has (scope,
_range, first, n, before): where a scope's rows begin in a range, how many there are, and how many ranges before hold.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import LongType, StructField, StructType

#: Rows of a range.
RANGE_ROWS = 1_000_000
#: Bits that monotonically_increasing_id gives to the place in a partition. A fixed value.
_BITS = 33


def write_ordered(rows: DataFrame, path: str, order: list[Column], scope: str | None = None, range_rows: int = RANGE_ROWS) -> "OrderedRows":  # noqa: UP037
    """Stores rows in an order within each scope (all rows are one without it).

    The order's columns end with a unique one, so that ranges can split what is equal before it and pages are the same
    each time. Nulls come first, or last where the order descends; a null scope is a scope. An empty table has no pages.
    Equal rows have places of their own."""
    taken = {"_range", "_at", "place"} & set(rows.columns)
    if taken:
        raise ValueError(f"columns of the index: {sorted(taken)}")
    by = [*([F.col(scope).asc()] if scope else []), *order]
    ranges = max(1, -(-rows.count() // range_rows))
    numbered = rows.repartitionByRange(ranges, *by).sortWithinPartitions(*by).withColumn("_id", F.monotonically_increasing_id())
    placed = numbered.withColumn("_range", F.shiftright("_id", _BITS)).withColumn("_at", F.col("_id").bitwiseAND(F.lit((1 << _BITS) - 1))).drop("_id")
    placed.sortWithinPartitions("_range", "_at").write.partitionBy("_range").parquet(f"{path}/rows")
    index = OrderedRows(rows.sparkSession, path, scope, StructType([*rows.schema, StructField("_at", LongType()), StructField("_range", LongType())]))
    # a group has a row for each range of its scope, as few as there are ranges
    earlier = Window.partitionBy("scope").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    each = index.rows().groupBy(index.scope_of().alias("scope"), "_range").agg(F.min("_at").alias("first"), F.count(F.lit(1)).alias("n"))
    each.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)).cast("long")).write.parquet(f"{path}/counts")
    return index


@dataclass(frozen=True)
class OrderedRows:
    """What write_ordered stored, and its pages, which are counted from 0."""

    spark: SparkSession
    path: str
    scope: str | None
    schema: StructType

    def scope_of(self) -> Column:
        return F.col(self.scope) if self.scope else F.lit(0)

    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/rows")

    def counts(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/counts")

    def _of(self, scope: object) -> DataFrame:
        return self.counts().where(F.col("scope").eqNullSafe(F.lit(scope if self.scope else 0)))

    def totals(self, size: int = 20) -> DataFrame:
        """(scope, total_elements, total_pages) of each scope."""
        return self.counts().groupBy("scope").agg(F.sum("n").alias("total_elements")).withColumn("total_pages", F.ceil(F.col("total_elements") / size).cast("long"))

    def page(self, number: int, size: int = 20, scope: object = None) -> DataFrame:
        """A page of a scope, with each row's `place`, in order; no rows behind the last page."""
        if number < 0 or size < 1:
            raise ValueError(f"no page {number} of {size} rows")
        low, high = number * size, (number + 1) * size
        spans = self._of(scope).where((F.col("before") < high) & (F.col("before") + F.col("n") > low)).collect()  # each has a row of the page or more
        held, place = F.lit(False), F.lit(None).cast("long")
        for s in spans:
            here = F.col("_range") == s["_range"]
            at = F.col("_at") - s["first"] + s["before"]
            held = held | (here & (F.col("_at") >= s["first"] + max(low - s["before"], 0)) & (F.col("_at") < s["first"] + min(high - s["before"], s["n"])))
            place = F.when(here, at).otherwise(place)
        found = self.rows().where(F.col("_range").isin([s["_range"] for s in spans]) & held)
        return found.withColumn("place", place).drop("_range", "_at").coalesce(1).sortWithinPartitions("place")

    def pages(self, asked: DataFrame, size: int = 20) -> DataFrame:
        """Rows of the pages in asked (scope, page), with `page` and `place`; without a scope of its own, scope is 0.

        For many pages at once: one pass over the ranges of the scopes asked for, without a sort. asked may repeat a page."""
        wanted = asked.select(F.col("scope").alias("_scope"), F.col("page").cast("long").alias("page")).distinct()
        scopes = wanted.select("_scope").distinct()
        spans = self.counts().join(scopes, F.col("scope").eqNullSafe(F.col("_scope")), "left_semi").select(F.col("scope").alias("_s"), F.col("_range").alias("_r"), "first", "before")
        placed = self.rows().withColumn("_of", self.scope_of()).join(spans, (F.col("_range") == F.col("_r")) & F.col("_of").eqNullSafe(F.col("_s"))).drop("_r", "_s")
        numbered = placed.withColumn("place", F.col("before") + F.col("_at") - F.col("first")).withColumn("page", F.floor(F.col("place") / size))
        kept = numbered.alias("n").join(wanted.alias("w"), (F.col("n.page") == F.col("w.page")) & F.col("n._of").eqNullSafe(F.col("w._scope")), "left_semi")
        return kept.drop("_range", "_at", "_of", "first", "before")
