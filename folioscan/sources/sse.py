"""Server-sent events: blocks of text to events, and events to answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

EVENT = "struct<event:string,data:string>"


def parse_events(raw: Column) -> Column:
    """array of (event, data): blocks between blank lines; several data lines are joined by line ends; "message" is the event where none is named; blocks without data are none."""
    blocks = F.split(F.regexp_replace(raw, "\r\n?", "\n"), "\n\n+")

    def one(b: Column) -> Column:
        lines = F.split(b, "\n")
        field = lambda name: F.transform(F.filter(lines, lambda x: x.startswith(f"{name}:")), lambda x: F.regexp_replace(x, rf"\A{name}: ?", ""))
        return F.struct(F.coalesce(F.get(field("event"), F.lit(0)), F.lit("message")).alias("event"), F.when(F.size(field("data")) > 0, F.array_join(field("data"), "\n")).alias("data"))

    return F.filter(F.transform(blocks, one), lambda e: e["data"].isNotNull())


def delta_text(payload: Column) -> Column:
    """The text of a provider's content delta; null for other payloads and for bad JSON."""
    return F.when(F.get_json_object(payload, "$.type") == "content-delta", F.get_json_object(payload, "$.delta.message.content.text"))


def data_lines(body: Column) -> Column:
    """Payloads of the lines of a provider's stream that begin with "data:", trimmed, without empty ones and [DONE]."""
    lines = F.filter(F.split(body, "\r?\n"), lambda x: x.startswith("data:"))
    return F.filter(F.transform(lines, lambda x: F.trim(F.substring(x, 6, 2**31 - 1))), lambda x: (x != "") & (x != "[DONE]"))


def stream_text(body: Column) -> Column:
    """The reply that a provider's stream spells, trimmed; null where it is blank."""
    deltas = F.filter(F.transform(data_lines(body), delta_text), lambda x: x.isNotNull())
    return F.nullif(F.trim(F.array_join(deltas, "")), F.lit(""))


def bearer(header: Column) -> Column:
    """The token of an authorization header; null for another kind of header."""
    return F.when(header.startswith("Bearer "), F.substring(header, 8, 2**31 - 1))


def first_text(content: Column) -> Column:
    """The text of the first block of type text that has one, of an array of (type, text)."""
    return F.get(F.filter(content, lambda c: (c["type"] == "text") & c["text"].isNotNull()), F.lit(0))["text"]


def fold_events(events: Column) -> Column:
    """(text, state, error) after all events: deltas are appended, "done" and "error" end the turn."""
    start = F.struct(F.lit("").alias("text"), F.lit("streaming").alias("state"), F.lit(None).cast("string").alias("error"))

    def step(acc: Column, e: Column) -> Column:
        live = acc["state"] == "streaming"
        return F.struct(
            F.when(live & (e["event"] == "delta"), F.concat(acc["text"], e["data"])).otherwise(acc["text"]).alias("text"),
            F.when(live & (e["event"] == "done"), "done").when(live & (e["event"] == "error"), "failed").otherwise(acc["state"]).alias("state"),
            F.when(live & (e["event"] == "error"), e["data"]).otherwise(acc["error"]).alias("error"),
        )

    return F.aggregate(events, start, step)


def emit(answers: DataFrame, key: str, text: str, size: int = 40) -> DataFrame:
    """(key, position, event, data): meta, deltas of `size` characters, done."""
    n = F.ceil(F.length(text) / size).cast("int")
    deltas = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.lit("delta").alias("event"), F.substring(F.col(text), i * size + 1, F.lit(size)).alias("data")))).otherwise(F.array().cast(f"array<{EVENT}>"))
    mark = lambda name: F.array(F.struct(F.lit(name).alias("event"), F.lit("").alias("data")))
    return answers.select(key, F.posexplode(F.concat(mark("meta"), deltas, mark("done"))).alias("position", "_e")).select(key, "position", "_e.event", "_e.data")
