"""Files to pages of text. The extractor is pluggable, as no PDF library comes with Spark."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from folioscan.functions.batches import PIECE

#: Bytes to the texts of pages; it raises ValueError on what it can't read.
Extractor = Callable[[bytes], list[str]]


def plain_pages(content: bytes) -> list[str]:
    """UTF-8 text with form feeds between pages."""
    try:
        return content.decode("utf-8").split("\f")
    except UnicodeDecodeError as e:
        raise ValueError("no UTF-8 text") from e


EXTRACTORS: dict[str, Extractor] = {"text/plain": plain_pages}


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, modificationTime, length, content) of files, each whole."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)


def extract_pages(files: DataFrame, content_type: str, content: str = "content") -> DataFrame:
    """files with `pages`, array of (page from 1, text), and `error`: null, or why a file gave none."""
    extractor = EXTRACTORS.get(content_type)
    shape = pa.struct([("pages", pa.list_(pa.struct([("page", pa.int32()), ("text", pa.string())]))), ("error", pa.string())])

    def pages_of(raw: bytes) -> dict:
        try:
            if extractor is None:
                raise ValueError(f"no extractor for {content_type}")
            pages = [{"page": i + 1, "text": t} for i, t in enumerate(extractor(raw))]
            return {"pages": pages, "error": None if any(p["text"] and not p["text"].isspace() for p in pages) else "No extractable text"}
        except ValueError as e:
            return {"pages": [], "error": str(e)}

    @F.arrow_udf("struct<pages:array<struct<page:int,text:string>>,error:string>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            found, held = [], 0
            for raw in b:  # what has been read is handed on before it is much, however small the files
                found.append(pages_of(raw.as_py()))
                held += sum(len(p["text"]) for p in found[-1]["pages"])
                if held >= PIECE:
                    yield pa.array(found, shape)
                    found, held = [], 0
            if found:
                yield pa.array(found, shape)

    return files.withColumn("_x", run(F.col(content))).select("*", "_x.pages", "_x.error").drop("_x")
