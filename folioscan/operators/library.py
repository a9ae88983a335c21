"""The library of documents: uploads, content addresses, states, children and constraints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: In the order that ingestion passes them. Fixed values.
STATES = ("UPLOADED", "EXTRACTING", "CHUNKING", "EMBEDDING", "READY")
FAILED = "FAILED"
IN_FLIGHT = STATES[:-1]


def dedup_uploads(uploads: DataFrame, scope: str, digest: str, order: list[str]) -> DataFrame:
    """uploads with the first of equal content in a scope (`kept_` + its order columns) and `created`: whether a row is that one.

    The first is found by aggregation, so copies are combined before the shuffle."""
    first = uploads.groupBy(F.col(scope).alias("_s"), F.col(digest).alias("_d")).agg(F.min(F.struct(*order)).alias("_f"))
    out = uploads.join(first, F.col(scope).eqNullSafe(F.col("_s")) & (F.col(digest) == F.col("_d")))
    return out.select(*uploads.columns, *[F.col("_f")[c].alias(f"kept_{c}") for c in order], F.struct(*order).eqNullSafe(F.col("_f")).alias("created"))


def latest(log: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """Each key's last row of a log, by a mergeable maximum and not by a sort."""
    top = log.groupBy(key).agg(F.max(F.struct(*order, *[c for c in columns if c not in order])).alias("_m"))
    return top.select(key, *[F.col("_m")[c].alias(c) for c in columns])


def advance(state: Column) -> Column:
    """The state after this one; final states stay."""
    out = state
    for a, b in zip(STATES[-2::-1], STATES[:0:-1], strict=True):
        out = F.when(state == a, b).otherwise(out)
    return out


def valid_upload(size: Column, content_type: Column) -> Column:
    """400 for an empty file, 415 for any type but application/pdf in any case, else null."""
    return F.when(F.coalesce(size, F.lit(0)) == 0, 400).when(F.coalesce(F.lower(content_type), F.lit("")) != "application/pdf", 415)


def content_path(scope: Column, digest: Column) -> Column:
    return F.concat_ws("/", scope.cast("string"), digest)


def replace_children(children: DataFrame, fresh: DataFrame, parent: str) -> DataFrame:
    """children with those of fresh's parents exchanged for fresh; the same twice is the same once."""
    return children.join(fresh.select(parent).distinct(), parent, "left_anti").unionByName(fresh)


def cascade_delete(parents: DataFrame, gone: DataFrame, key: str, *children: tuple[DataFrame, str]) -> list[DataFrame]:
    """parents without the gone keys, and each table of children without theirs."""
    keys = gone.select(key).distinct()
    return [parents.join(keys, key, "left_anti"), *[c.join(keys.withColumnRenamed(key, fk), fk, "left_anti") for c, fk in children]]


def duplicate_keys(rows: DataFrame, *key: str) -> DataFrame:
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def orphans(children: DataFrame, fk: str, parents: DataFrame, pk: str) -> DataFrame:
    return children.where(F.col(fk).isNotNull()).join(parents.select(F.col(pk).alias(fk)).distinct(), fk, "left_anti")


def zip_positions(left: DataFrame, a: str, b: str) -> DataFrame:
    """A row for each position of two arrays of equal length, else an error."""
    same = F.when(F.size(a) == F.size(b), F.arrays_zip(a, b)).otherwise(F.raise_error(F.lit("as many vectors as texts are needed")).cast(f"array<struct<{a}:string,{b}:array<float>>>"))
    return left.select(*[c for c in left.columns if c not in (a, b)], F.posexplode(same).alias("position", "_z")).select("*", f"_z.{a}", f"_z.{b}").drop("_z")


def upsert_latest(rows: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """rows with those of fresh's keys exchanged, and fresh's other rows; fresh has a row for each of its keys."""
    return rows.join(fresh.select(key), key, "left_anti").unionByName(fresh)


def record_id(*parts: Column) -> Column:
    """A UUID made from what identifies a row, so that a task that is run again gives it the same one."""
    h = F.sha2(F.concat_ws("\x1f", *[p.cast("string") for p in parts]), 256)
    return F.concat_ws("-", h.substr(1, 8), h.substr(9, 4), h.substr(13, 4), h.substr(17, 4), h.substr(21, 12))


def is_record_id(text: Column) -> Column:
    return F.coalesce(F.regexp_like(text, F.lit(r"\A[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\z")), F.lit(False))
