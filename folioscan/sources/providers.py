"""Providers of embeddings and replies, by name. Those given here need no network and always answer alike."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F


class Embedder(Protocol):
    batch: int

    def configured(self) -> bool: ...

    def embed(self, texts: list[str]) -> list[list[float]]: ...


def embed_query(provider: Embedder, question: str) -> list[float]:
    """A question's vector; a provider may have an embed_query of its own, and otherwise takes it as any text."""
    own = getattr(provider, "embed_query", None)
    found = [own(question)] if own else provider.embed([question])
    if not found:
        raise ValueError("the question has no embedding")
    return found[0]


class Replier(Protocol):
    def configured(self) -> bool: ...

    def complete(self, messages: list[str]) -> str: ...

    def stream_complete(self, messages: list[str]) -> Iterator[str]: ...


class StubEmbedder:
    """Component i of n is a thousandth of ((length + i) mod 7) + 1."""

    def __init__(self, dim: int = 768, batch: int = 96):
        self.dim, self.batch = dim, batch

    def configured(self) -> bool:
        return True

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [[0.001 * ((len(t) + i) % 7 + 1) for i in range(self.dim)] for t in texts]


class Unconfigured:
    batch = 1

    def configured(self) -> bool:
        return False

    def embed(self, texts: list[str]) -> list[list[float]]:
        raise RuntimeError("no embedding provider is configured")

    def complete(self, messages: list[str]) -> str:
        raise RuntimeError("no chat provider is configured")

    def stream_complete(self, messages: list[str]) -> Iterator[str]:
        raise RuntimeError("no chat provider is configured")


class EchoReplier:
    """Repeats the last message, trimmed; a blank reply is an error."""

    def configured(self) -> bool:
        return True

    def complete(self, messages: list[str]) -> str:
        said = messages[-1].strip() if messages else ""
        if not said:
            raise RuntimeError("the reply is blank")
        return said

    def stream_complete(self, messages: list[str]) -> Iterator[str]:
        """Word by word, each with the spaces after it."""
        return iter(re.findall(r"\s*\S+", self.complete(messages)))


EMBEDDERS: dict[str, Embedder] = {"stub": StubEmbedder(), "none": Unconfigured()}
REPLIERS: dict[str, Replier] = {"echo": EchoReplier(), "none": Unconfigured()}


def embedder(name: str | None, default: str = "stub") -> Embedder:
    """By name; an unknown name gives the default."""
    return EMBEDDERS.get((name or "").lower(), EMBEDDERS[default])


def embed(rows: DataFrame, text: str, provider: Embedder, out: str = "embedding") -> DataFrame:
    """rows with their embeddings, asked for in the provider's batches; nulls from a provider that isn't configured."""
    if not provider.configured():
        return rows.withColumn(out, F.lit(None).cast("array<float>"))

    @F.arrow_udf("array<float>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            for i in range(0, len(b), provider.batch):  # a provider's batch is handed on before the next
                texts = [t or "" for t in b.slice(i, provider.batch).to_pylist()]
                part = provider.embed(texts)
                if len(part) != len(texts):
                    raise ValueError("as many vectors as texts are needed")
                yield pa.array(part, pa.list_(pa.float32()))

    return rows.withColumn(out, run(F.col(text)))


def reply(rows: DataFrame, messages: str, provider: Replier, size: int = 32) -> DataFrame:
    """rows with `reply`, trimmed, and `reply_error`, of which one is null: messages is an array of strings. A blank reply is an error."""
    if not provider.configured():
        return rows.withColumns({"reply": F.lit(None).cast("string"), "reply_error": F.lit("no chat provider is configured")})

    def one(said) -> tuple[str | None, str | None]:
        try:
            text = "".join(provider.stream_complete(list(said if said is not None else []))).strip()
            return (text, None) if text else (None, "the reply is blank")
        except RuntimeError as e:
            return None, str(e)

    @F.pandas_udf("struct<reply:string,reply_error:string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([one(x) for x in b], columns=["reply", "reply_error"])

    return rows.withColumn("_reply", run(F.col(messages))).select("*", "_reply.reply", "_reply.reply_error").drop("_reply")
