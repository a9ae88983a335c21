"""Ingestion of uploads in one pass: pages, chunks, embeddings, and the state that each document ends in."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from folioscan.functions.text import error_message
from folioscan.operators.chunking import chunk_words
from folioscan.operators.library import FAILED, STATES
from folioscan.sources.pages import extract_pages
from folioscan.sources.providers import Embedder, embed


@dataclass
class Ingested:
    """documents: key, status, error_message, page_count. log: key, step, state, every state passed, in order. chunks: of documents that are READY."""

    documents: DataFrame
    log: DataFrame
    chunks: DataFrame


def ingest(uploads: DataFrame, key: str, content: str, content_type: str, provider: Embedder) -> Ingested:
    """Uploads (key, content) through extraction, chunking and embedding.

    What can't be read fails while it is extracted, with the extractor's reason cut to 500 characters; text without words
    fails while it is chunked. Uploads without content are gone before ingestion ran: they have no state and no chunks. A
    provider that isn't configured leaves chunks without embeddings."""
    there = uploads.where(F.col(content).isNotNull())
    read = extract_pages(there.select(key, content), content_type, content).drop(content)
    broken = F.size("pages") == 0
    ends = F.when(broken, 2).when(F.col("error").isNotNull(), 3).otherwise(len(STATES))
    failed = F.col("error").isNotNull()
    passed = F.transform(F.slice(F.array(*map(F.lit, STATES)), F.lit(1), ends), lambda s, i: F.struct(i.alias("step"), s.alias("state")))
    states = F.when(failed, F.concat(passed, F.array(F.struct(ends.alias("step"), F.lit(FAILED).alias("state"))))).otherwise(passed)
    documents = read.select(key, F.when(failed, FAILED).otherwise(STATES[-1]).alias("status"), F.when(failed, error_message(F.col("error"))).alias("error_message"), F.when(~broken, F.size("pages")).alias("page_count"))
    log = read.select(key, F.explode(states).alias("_s")).select(key, "_s.*")
    chunks = chunk_words(read.where(~failed), F.col("pages"), key)
    return Ingested(documents, log, embed(chunks, "content", provider))
