"""Pages to overlapping chunks of words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from folioscan.functions.text import token_estimate, tokens

SIZE, OVERLAP = 400, 60


def split_pages(text: Column, separator: str = "\n") -> Column:
    """(page from 1, text) of a text that is kept whole."""
    return F.transform(F.split(F.coalesce(text, F.lit("")), separator), lambda t, i: F.struct((i + 1).alias("page"), t.alias("text")))


def chunk_words(docs: DataFrame, pages: Column, key: str, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(key, chunk_index, page_number, content, token_count): windows of `size` words that share `overlap` with the last.

    Words run on over pages; a chunk's page is that of its first word; the last chunk is the first that reaches the
    end. A document without words has no chunks. A narrow transformation: nothing is shuffled."""
    step = size - overlap
    words = F.flatten(F.transform(pages, lambda p: F.transform(tokens(p["text"]), lambda w: F.struct(w.alias("w"), p["page"].alias("page")))))

    def chunks(ws: Column) -> Column:
        last = F.greatest(F.ceil((F.size(ws) - size) / step), F.lit(0)).cast("int")
        content = lambda i: F.array_join(F.transform(F.slice(ws, i * step + 1, size), lambda x: x["w"]), " ")
        one = lambda i: F.struct(i.alias("chunk_index"), F.element_at(ws, i * step + 1)["page"].alias("page_number"), content(i).alias("content"))
        return F.when(F.size(ws) > 0, F.transform(F.sequence(F.lit(0), last), one)).otherwise(F.array().cast("array<struct<chunk_index:int,page_number:int,content:string>>"))

    # finished chunks are exploded, so that no row carries the words of the whole text; the words are made once, as an array's element
    made = F.flatten(F.transform(F.array(words), chunks))
    rows = docs.select(key, F.explode(made).alias("_chunk")).select(key, "_chunk.*")
    return rows.withColumn("token_count", token_estimate(F.col("content")))
