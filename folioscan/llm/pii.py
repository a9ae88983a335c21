"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score.

All of it is built-in expressions. Spark's regex functions give no offsets, so a pattern's matches are enclosed in two
marks, the text is split there, and running sums of the pieces' lengths, within blocks of pieces and over the blocks,
give the offsets in code points. Context comes from the neighbouring pieces, so time grows with the text and not with
spans times text. The patterns
keep Java's matcher from recursing on long inputs: runs are possessive, and a repeated group is nested in atomic ones.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from folioscan.llm.common import table

# Marks; a text's own are exchanged for \x03, which no pattern has. Each is one code point, so offsets stay.
_OPEN, _CLOSE = "\x01", "\x02"

_LABELS = r"(?>(?>(?>\.[A-Za-z0-9-]++){1,200}){1,200}){1,200}"
#: A match begins where its run of local characters does, or where the last match ended: later starts in a run fail as the first does.
_EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)([A-Za-z0-9._%+-]++@[A-Za-z0-9-]++" + _LABELS + ")"
_IP = r"(?<![0-9])([0-9]++\.[0-9]++\.[0-9]++\.[0-9]++)"
_PHONE = r"(\+[0-9][\x20().0-9-]+[0-9])"
#: Digits with at most one separator between them; the two ends of such a run, as places.
_CARD_START = r"(?<![0-9])(?<![0-9][\x20-])(?=[0-9][\x20-]?[0-9])"
_CARD_END = r"(?:(?<=[0-9][0-9])|(?<=[0-9][\x20-][0-9]))(?![\x20-]?[0-9])"
_IBAN = r"(?<![A-Za-z0-9])([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])"
#: A value of 16 characters or more that is given to a name of secrets.
_SECRET = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_-]{16})(?<=\b(?:token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key|private[_-]?key)[\"']?\x20{0,3}[=:]\x20{0,3}[\"']?)([A-Za-z0-9+/_=-]++)"

#: In the order that a contract lists them; kinds of the method's own follow.
KINDS = ("email", "ip", "card", "phone")
OWN_KINDS = ("iban", "secret")

CONTEXT = {
    "email": ["mail", "contact", "write", "kontakt", "correo", "courriel"],
    "ip": ["ip", "address", "server", "host", "adresse"],
    "card": ["card", "visa", "credit", "payment", "karte", "carte", "tarjeta"],
    "phone": ["phone", "call", "tel", "mobile", "fax", "telefon", "téléphone", "teléfono"],
    "iban": ["iban", "bank", "account", "konto", "compte", "cuenta"],
    "secret": ["secret", "password", "login", "credential", "geheim", "passwort"],
}
BASE_SCORE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.5, "iban": 0.8, "secret": 0.7}
CONTEXT_CHARS, CONTEXT_GAIN = 40, 0.2

#: Pieces that are summed at a time: an even number, so that each block begins outside of the marks. Arrays are copied
#: when they are appended to, so a sum over all pieces at once would take their square.
BLOCK = 64
_SPAN = "array<struct<start:int,`end`:int,match:string,piece:int>>"
_CANDIDATES = "array<struct<start:int,`end`:int,match:string,near:string>>"


def _enclosed(text: Column, pattern: str) -> Column:
    return F.regexp_replace(text, pattern, f"{_OPEN}$1{_CLOSE}")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.transform(F.array(value), use)[0]


def _within(pieces: Column, block: Column) -> Column:
    """(at, n, found) of a block of pieces: their length, their number, and what its odd pieces are, offsets counted from the block's start."""
    return F.aggregate(
        F.slice(pieces, block * BLOCK + 1, BLOCK),
        F.struct(F.lit(0).alias("at"), F.lit(0).alias("n"), F.array().cast(_SPAN).alias("found")),
        lambda acc, x: F.struct(
            (acc["at"] + F.length(x)).alias("at"),
            (acc["n"] + 1).alias("n"),
            F.when(acc["n"] % 2 == 1, F.concat(acc["found"], F.array(F.struct(acc["at"].alias("start"), (acc["at"] + F.length(x)).alias("end"), x.alias("match"), (acc["n"] + block * BLOCK).alias("piece"))))).otherwise(acc["found"]).alias("found"),
        ),
    )


def _starts(blocks: Column) -> Column:
    """Where each block starts."""
    return F.aggregate(
        blocks,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts")),
        lambda acc, b: F.struct((acc["at"] + b["at"]).alias("at"), F.concat(acc["starts"], F.array(acc["at"])).alias("starts")),
    )["starts"]


def _spans(marked: Column, sure: Callable[[Column], Column]) -> Column:
    """Structs (start, end, match, near) of what is enclosed, pieces 1, 3, ... of the marked text, and sure."""

    def of_pieces(pieces: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / BLOCK).cast("int")), lambda b: _within(pieces, b))
        heads, tails = F.transform(pieces, lambda x: F.left(x, F.lit(CONTEXT_CHARS))), F.transform(pieces, lambda x: F.right(x, F.lit(CONTEXT_CHARS)))

        def near(i: Column, heads: Column, tails: Column) -> Column:
            # every other piece has two characters at least, so that so many pieces hold the context
            before = F.array_join(F.slice(tails, F.greatest(i - CONTEXT_CHARS, F.lit(0)) + 1, F.least(i, F.lit(CONTEXT_CHARS))), "")
            return F.concat(F.right(before, F.lit(CONTEXT_CHARS)), F.lit(" "), F.left(F.array_join(F.slice(heads, i + 2, CONTEXT_CHARS), ""), F.lit(CONTEXT_CHARS)))

        def placed(found: Column, start: Column, heads: Column, tails: Column) -> Column:
            return F.transform(F.filter(found, lambda s: sure(s["match"])), lambda s: F.struct((s["start"] + start).alias("start"), (s["end"] + start).alias("end"), s["match"].alias("match"), near(s["piece"], heads, tails).alias("near")))

        return _let(
            F.struct(blocks.alias("blocks"), heads.alias("heads"), tails.alias("tails")),
            lambda v: _let(_starts(v["blocks"]), lambda starts: F.flatten(F.transform(v["blocks"], lambda b, i: placed(b["found"], F.get(starts, i), v["heads"], v["tails"])))),
        )

    return _let(F.split(marked, f"[{_OPEN}{_CLOSE}]", -1), of_pieces)


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn: from the right, each second digit doubled, less 9 if above 9."""
    backwards = F.split(F.reverse(digits), "")
    doubled = F.transform(backwards, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(2 * d.cast("int") - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN leaves 1 modulo 97, its first four characters moved to the end and letters read as 10 to 35."""
    plain = F.regexp_replace(iban, " ", "")
    chars = F.split(F.concat(plain.substr(F.lit(5), F.length(plain)), plain.substr(F.lit(1), F.lit(4))), "")
    return F.aggregate(chars, F.lit(0), lambda a, c: F.when(c.between("0", "9"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)) == 1


def _sure(kind: str, x: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(x, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.right(p, F.lit(9)).cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.length(_digits(x)).between(16, 19) & luhn(_digits(x))
    if kind == "phone":
        return F.length(_digits(x)).between(8, 15)
    if kind == "iban":
        return F.length(F.regexp_replace(x, " ", "")).between(15, 34) & mod97(x)
    if kind == "secret":
        return F.regexp_like(x, F.lit("[0-9]")) & F.regexp_like(x, F.lit("[A-Za-z]"))
    return F.lit(True)


def _found(text: Column, kind: str) -> Column:
    """Confirmed spans of one kind. Texts without the character that a match must have skip the matcher."""
    none = F.array().cast(_CANDIDATES)
    if kind == "card":
        marked, hint = F.regexp_replace(F.regexp_replace(text, _CARD_END, _CLOSE), _CARD_START, _OPEN), F.regexp_like(text, F.lit("[0-9](?:[\\x20-]?[0-9]){15}"))
    else:
        marked = _enclosed(text, {"email": _EMAIL, "ip": _IP, "phone": _PHONE, "iban": _IBAN, "secret": f"(?i){_SECRET}"}[kind])
        hint = {"email": F.contains(text, F.lit("@")), "phone": F.regexp_like(text, F.lit(r"\+[0-9]")), "ip": F.regexp_like(text, F.lit(r"[0-9]\.[0-9]")), "iban": F.regexp_like(text, F.lit("[A-Z]{2}[0-9]{2}")), "secret": F.regexp_like(text, F.lit("(?i)(?:token|secret|passw|pwd|key)[\"']?\\x20{0,3}[=:]"))}[kind]
    return F.when(hint, _spans(marked, lambda x: _sure(kind, x))).otherwise(none)


def _scored(kind: str, spans: Column) -> Column:
    words = rf"(?i)\b(?:{'|'.join(CONTEXT[kind])})"

    def one(s: Column) -> Column:
        score = F.least(F.lit(1.0), F.lit(BASE_SCORE[kind]) + F.when(F.regexp_like(s["near"], F.lit(words)), CONTEXT_GAIN).otherwise(0.0))
        return F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["match"].alias("match"), score.alias("score"))

    return F.transform(spans, one)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of id and spans: array of (kind, start, end, match, score), by kind in the order of KINDS and OWN_KINDS, then start.

    Offsets are code points, end exclusive. A candidate that its validator refuses is dropped and nothing inside it is
    tried again. Kinds may overlap one another. Null and empty texts have no spans; rows with one id are each answered;
    other columns are ignored; an empty table gives no rows."""
    text = F.translate(F.coalesce(F.col(text_col), F.lit("")), _OPEN + _CLOSE, "\x03\x03")
    rows = docs.select(F.col(id_col).alias(id_col), text.alias("_text"))
    # texts without any of these hold no candidate of any kind
    may = F.regexp_like("_text", F.lit("[0-9@]"))
    spans = F.concat(*[_scored(k, _found(F.col("_text"), k)) for k in KINDS + OWN_KINDS])
    empty = F.array().cast("array<struct<kind:string,start:int,`end`:int,match:string,score:double>>")
    return rows.select(id_col, F.when(may, spans).otherwise(empty).alias("spans"))


def mask_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the confirmed spans of every kind exchanged for [kind], whatever their context; other columns stay.

    Spans that overlap are exchanged together, for the kind of the one that starts first (of those, of the longest).
    Refused candidates, texts without spans and null stay as they are; rows that repeat are each masked; an empty table
    stays empty. id_col is not used."""
    text = F.col(text_col)
    plain = F.translate(text, _OPEN + _CLOSE, "\x03\x03")  # as find_pii reads it; offsets are the same
    of_kind = lambda kind: F.transform(_found(plain, kind), lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), F.lit(kind).alias("kind")))
    found = F.concat(*map(of_kind, KINDS + OWN_KINDS))
    fold = F.aggregate(
        F.array_sort(found),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts")),
        lambda acc, s: F.struct(
            F.greatest(acc["at"], -s["back"]).alias("at"),
            F.when(s["start"] < acc["at"], acc["parts"]).otherwise(F.concat(acc["parts"], F.array(text.substr(acc["at"] + 1, s["start"] - acc["at"]), F.concat(F.lit("["), s["kind"], F.lit("]"))))).alias("parts"),
        ),
        lambda acc: F.concat(F.array_join(acc["parts"], ""), text.substr(acc["at"] + 1, F.length(text))),
    )
    return docs.withColumn(text_col, F.when(F.regexp_like(text, F.lit("[0-9@]")), fold).otherwise(text))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, counts and digest of the base kinds, spans of all kinds and their scores, of every document."""
    found = find_pii(table(spark, sf_dir, "documents"))
    said = lambda kinds: F.array_join(F.transform(F.filter("spans", lambda s: s["kind"].isin(*kinds)), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(said(KINDS), 256).alias("base_sha256"), said(KINDS + OWN_KINDS).alias("spans"), F.array_join(F.transform("spans", lambda s: F.round(s["score"], 2).cast("string")), ",").alias("scores"))
