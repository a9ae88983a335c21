"""Prompts, citations and the history of threads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from folioscan.functions.text import markers, snippet, source_header, strip

HISTORY = 10


def last_messages(messages: DataFrame, thread: str, order: list[str], n: int = HISTORY) -> DataFrame:
    """The last n messages of each thread, with `position` from 1 in the order of time. Spark cuts each task's rows to n first."""
    late = Window.partitionBy(thread).orderBy(*[F.col(c).desc() for c in order])
    kept = messages.withColumn("_late", F.row_number().over(late)).where(F.col("_late") <= n)
    return kept.withColumn("position", F.row_number().over(Window.partitionBy(thread).orderBy(F.col("_late").desc()))).drop("_late")


def assemble_prompt(sources: DataFrame, group: str, index: str, filename: str, page: str, content: str) -> DataFrame:
    """(group, prompt): "[i] (filename, p.N)", the content and a blank line for each source, by index. As many as a result has."""
    block = F.concat(source_header(F.col(index), F.col(filename), F.col(page)), F.lit("\n"), strip(F.coalesce(F.col(content), F.lit(""))), F.lit("\n\n"))
    parts = F.array_sort(F.collect_list(F.struct(F.col(index).alias("i"), block.alias("block"))))
    return sources.groupBy(group).agg(F.array_join(F.transform(parts, lambda x: x["block"]), "").alias("prompt"))


def citations(hits: DataFrame, order: list[Column], content: str) -> DataFrame:
    """hits with citation_index from 1 and the content's snippet."""
    return hits.withColumn("citation_index", F.row_number().over(Window.orderBy(*order))).withColumn("snippet", snippet(F.col(content)))


def cited(answers: DataFrame, sources: DataFrame, key: str, answer: str, index: str) -> DataFrame:
    """A row for each [n] of an answer, with its source's columns, null where no source has that number."""
    found = answers.select(key, F.posexplode(markers(F.col(answer))).alias("position", "marker"))
    return found.join(sources.withColumnRenamed(index, "marker"), [key, "marker"], "left")
