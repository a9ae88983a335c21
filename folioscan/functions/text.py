"""Text expressions: tokens, titles, snippets, file names, markers. All are built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: White space of the tokeniser, and what else counts as white space at a text's edges. Fixed values.
SPACE = r"[ \t\n\x0B\f\r]+"
_EDGE = r"[\s\x1C-\x1F  -  -    　]+"


def tokens(text: Column) -> Column:
    """Words between ASCII white space; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def strip(text: Column) -> Column:
    """Without white space at either edge, Unicode's included (no-break spaces stay)."""
    return F.regexp_replace(text, rf"\A{_EDGE}|{_EDGE}\z", "")


def strip_end(text: Column) -> Column:
    return F.regexp_replace(text, rf"{_EDGE}\z", "")


def token_estimate(text: Column) -> Column:
    """A quarter of the UTF-16 length, rounded up."""
    units = F.length(text) + F.length(F.regexp_replace(text, r"[^\x{10000}-\x{10FFFF}]", ""))
    return F.ceil(units / 4.0).cast("int")


def thread_title(question: Column, most: int = 200) -> Column:
    """White space collapsed, cut to `most` characters."""
    return F.substring(F.trim(F.regexp_replace(question, SPACE, " ")), 1, most)


def snippet(content: Column, most: int = 240) -> Column:
    """Stripped; over `most` characters, cut, stripped at the cut and ended by an ellipsis. Null gives the empty text."""
    plain = strip(F.coalesce(content, F.lit("")))
    return F.when(F.length(plain) <= most, plain).otherwise(F.concat(strip_end(F.substring(plain, 1, most)), F.lit("…")))


def error_message(reason: Column, most: int = 500, default: str = "Ingestion failed.") -> Column:
    return F.substring(F.coalesce(reason, F.lit(default)), 1, most)


def file_name(name: Column, most: int = 255, default: str = "document.pdf") -> Column:
    """The base name, trimmed and cut; a default where nothing is left."""
    base = F.element_at(F.split(F.regexp_replace(F.coalesce(name, F.lit("")), r"\\", "/"), "/"), -1)
    return F.substring(F.coalesce(F.nullif(F.trim(base), F.lit("")), F.lit(default)), 1, most)


def byte_size(n: Column) -> Column:
    """Bytes as B, KB without or MB with one decimal."""
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024 * 1024, F.concat(F.round(n / 1024).cast("long").cast("string"), F.lit(" KB"))).otherwise(F.concat(F.round(n / (1024.0 * 1024), 1).cast("decimal(18,1)").cast("string"), F.lit(" MB")))


def markers(answer: Column) -> Column:
    """The numbers in the [n] of an answer, in order."""
    return F.transform(F.regexp_extract_all(answer, F.lit(r"\[(\d+)\]"), 1), lambda x: x.cast("int"))


def source_header(index: Column, filename: Column, page: Column) -> Column:
    """"[i] (filename, p.N)", without the page where it is null."""
    return F.concat(F.lit("["), index.cast("string"), F.lit("] ("), filename, F.coalesce(F.concat(F.lit(", p."), page.cast("string")), F.lit("")), F.lit(")"))


def invite_token(pasted: Column) -> Column:
    """The token of a bare token or of an invitation's URL."""
    return F.regexp_extract(F.trim(pasted), r"(?:.*/invites?/)?([^/?#]*)[^/]*\z", 1)


def url_token(data: Column) -> Column:
    """Bytes in base64url without padding."""
    return F.rtrim(F.translate(F.base64(data), "+/", "-_"), F.lit("="))


def email(address: Column) -> Column:
    """Trimmed, in lower case, null where blank."""
    return F.nullif(F.lower(F.trim(address)), F.lit(""))


def occurrences(terms: Column) -> Column:
    """(term, places from 0, ascending) of each distinct term of an array, by term; null terms have none. Pairs are sorted
    and cut where the term changes, so that nothing is shuffled and a long text costs no more than its sort."""

    def cut(pairs: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(pairs) - 1), lambda i: (i == 0) | (F.get(pairs, i)["term"] != F.get(pairs, i - 1)["term"]))

        def runs(at: Column) -> Column:
            end = lambda j: F.coalesce(F.get(at, j + 1), F.size(pairs))
            return F.transform(at, lambda i, j: F.struct(F.get(pairs, i)["term"].alias("term"), F.transform(F.slice(pairs, i + 1, end(j) - i), lambda x: x["at"]).alias("places")))

        return F.when(F.size(pairs) > 0, F.flatten(F.transform(F.array(starts), runs)))

    pairs = F.filter(F.transform(terms, lambda t, i: F.struct(t.alias("term"), i.alias("at"))), lambda x: x["term"].isNotNull())
    # pairs and starts are made once, as arrays' elements
    return F.flatten(F.transform(F.array(F.sort_array(pairs)), cut))
