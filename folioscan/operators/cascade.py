"""Deletion along a graph of foreign keys: what goes with a row, what loses its reference, and what forbids it."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from folioscan.sources.tables import scratch

CASCADE, SET_NULL, RESTRICT = "cascade", "set null", "restrict"


@dataclass(frozen=True)
class ForeignKey:
    """child.column refers to parent.key. A null refers to nothing."""

    child: str
    column: str
    parent: str
    key: str
    on_delete: str = CASCADE


@dataclass
class Deleted:
    """left: each table without the rows that went; gone: (id) of these rows, by table."""

    left: dict[str, DataFrame]
    gone: dict[str, DataFrame] = field(default_factory=dict)


class Restricted(ValueError):
    """Rows that stay refer to rows that should go."""


def order(keys: list[ForeignKey]) -> list[list[str]]:
    """Tables in groups, parents first; a group has several tables, or one that refers to itself, only where references run in a circle."""
    tables = sorted({t for k in keys for t in (k.child, k.parent)})
    below = {t: {k.child for k in keys if k.parent == t and k.on_delete == CASCADE} for t in tables}

    def reached(t: str) -> set[str]:
        seen, todo = set(), [*below[t]]
        while todo:
            if (x := todo.pop()) not in seen:
                seen.add(x)
                todo += below[x]
        return seen

    down = {t: reached(t) for t in tables}
    groups = {frozenset({t} | {u for u in down[t] if t in down[u]}) for t in tables}
    # whoever reaches more comes first: a group reaches all that the groups below it do
    return [sorted(g) for g in sorted(groups, key=lambda g: (-len(set().union(*(down[t] for t in g)) | g), sorted(g)))]


def _kept(ids: DataFrame) -> DataFrame:
    """Written and read again: a step is computed once, and a lost executor costs a read."""
    path = scratch(ids.sparkSession, "gone")
    ids.write.parquet(path)
    return ids.sparkSession.read.schema(ids.schema).parquet(path)


def cascade(tables: dict[str, DataFrame], ids: dict[str, str], keys: list[ForeignKey], gone: dict[str, DataFrame]) -> Deleted:
    """tables without the rows whose ids are in `gone` (a table's name to a DataFrame of one column) and without all that goes with them.

    ids: each table's primary key. Only keys are joined and moved. Groups of tables are taken parents first, so that each
    is joined once for each of its references; where references run in a circle, it is done again with the rows that were
    new until there are none, as often as the longest chain is long. References that are `set null` lose their value.
    Raises Restricted where a row that stays refers by `restrict` to one that goes. Nulls in ids or references go with
    nothing; ids that aren't there count for nothing."""
    found: dict[str, DataFrame] = {}
    for name, named in gone.items():
        wanted = named.select(F.col(named.columns[0]).alias("id")).where("id IS NOT NULL").distinct()
        found[name] = _kept(tables[name].select(F.col(ids[name]).alias("id")).join(wanted, "id", "left_semi").distinct())

    def children(key: ForeignKey, parents: DataFrame) -> DataFrame:
        """ids of a child's rows that go with these parents."""
        if key.key != ids[key.parent]:  # the reference is to another unique column
            parents = tables[key.parent].join(parents.withColumnRenamed("id", ids[key.parent]), ids[key.parent], "left_semi").select(F.col(key.key).alias("id"))
        refers = tables[key.child].select(F.col(ids[key.child]).alias("id"), F.col(key.column).alias("_fk"))
        return refers.join(parents.withColumnRenamed("id", "_fk"), "_fk", "left_semi").select("id").where("id IS NOT NULL")

    cascades = [k for k in keys if k.on_delete == CASCADE]
    for group in order(keys):
        for name in group:  # from groups that are done
            parts = [children(k, found[k.parent]) for k in cascades if k.child == name and k.parent not in group and k.parent in found]
            for p in parts:
                found[name] = found[name].unionByName(p) if name in found else p
            if parts:
                found[name] = _kept(found[name].distinct())
        inner = [k for k in cascades if k.child in group and k.parent in group]
        fresh = {n: found[n] for n in group if n in found}
        while inner and fresh:
            news: dict[str, DataFrame] = {}
            for k in inner:
                if k.parent in fresh:
                    p = children(k, fresh[k.parent])
                    news[k.child] = news[k.child].unionByName(p) if k.child in news else p
            fresh = {}
            for name, p in news.items():
                new = _kept((p.join(found[name], "id", "left_anti") if name in found else p).distinct())
                if not new.isEmpty():
                    fresh[name] = new
            for name, new in fresh.items():
                found[name] = found[name].unionByName(new) if name in found else new

    left = {n: t.join(found[n].withColumnRenamed("id", ids[n]), ids[n], "left_anti").select(*t.columns) if n in found else t for n, t in tables.items()}
    for k in keys:
        if k.on_delete == CASCADE or k.parent not in found:
            continue
        lost = found[k.parent].withColumnRenamed("id", ids[k.parent])
        lost = (lost if k.key == ids[k.parent] else tables[k.parent].join(lost, ids[k.parent], "left_semi")).select(F.col(k.key).alias(k.column)).distinct()
        if k.on_delete == RESTRICT:
            n = left[k.child].join(lost, k.column, "left_semi").count()
            if n:
                raise Restricted(f"{n} rows of {k.child} refer to {k.parent} by {k.column}")
        else:
            t = left[k.child]
            marked = t.join(lost.select(F.col(k.column).alias("_lost")), F.col(k.column) == F.col("_lost"), "left")
            left[k.child] = marked.select(*[F.when(F.col("_lost").isNull(), F.col(c)).alias(c) if c == k.column else F.col(c) for c in t.columns])
    return Deleted(left, found)
