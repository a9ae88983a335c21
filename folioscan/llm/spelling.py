"""Spelling variants: words that differ by one inserted, deleted or replaced code point, found by parities of letters.

A word's mask has a bit for each letter, set where the letter occurs an odd number of times. One edit flips two bits at
most, so of three bands of the mask one is equal. Words are joined on an equal band, on the length of the shorter of the
two, and on the half of it that the edit can't have touched: the first or the last. The half keeps a band that says
little (few distinct letters) from gathering a large part of all words, and a band parts words that share a half. Where
several bands or both halves agree, the first counts, so that a pair comes up once. What is left is compared by masks and
then by edit distance, inside the join.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from folioscan.llm.common import lower_ascii, materialise, table

#: Maximal runs of letters are words. Fixed value.
LETTERS = r"[A-Za-zÀ-ÿ]"
#: Bits of a mask: 26 for a-z, the others shared by the letters that remain. A band has every third bit.
BITS, BANDS = 60, [sum(1 << i for i in range(k, 60, 3)) for k in range(3)]
LEAST_LENGTH, LEAST_COUNT, RATIO = 7, 2, 10


def letter_runs(text: Column, least: int = LEAST_LENGTH) -> Column:
    """The runs of at least so many letters, whole, with A-Z in lower case."""
    return F.regexp_extract_all(lower_ascii(text), F.lit(f"({LETTERS}{{{least},}})"), 1)


def letter_mask(word: Column) -> Column:
    """Parities of letters as bits."""
    code = lambda c: F.ascii(c)  # noqa: E731  the code point
    bit = lambda c: F.when(code(c).between(97, 122), code(c) - 97).otherwise(26 + F.pmod(code(c), F.lit(BITS - 26)))
    return F.aggregate(F.transform(F.split(word, ""), bit), F.lit(0).cast("long"), lambda m, b: m.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), b.cast("int"))))


def _keys(words: DataFrame, shorter: list[int]) -> DataFrame:
    """words under each of their keys; shorter: 0 where a word is the shorter one of a pair or as long, 1 where it is longer by one.

    The last three bits of a key are its slot, two for each band: the first half and the last one."""
    size, slots = F.char_length("word"), []
    for less in shorter:
        m = size - less
        half = F.floor(m / 2).cast("int")
        for k, band in enumerate(BANDS):
            bits = F.col("mask").bitwiseAND(F.lit(band))
            for t, part in enumerate((F.substring("word", F.lit(1), half), F.substring("word", size - (m - half) + 1, m - half))):
                slots.append(F.xxhash64(bits, m, F.lit(t), part).bitwiseAND(F.lit(-8)).bitwiseOR(F.lit(2 * k + t).cast("long")))
    return words.select(F.explode(F.array(*slots)).alias("key"), "word", "mask", "n")


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n): each pair of words (word, n; all distinct) at an edit distance of exactly one, once; a is the shorter or else the smaller one."""
    masked = materialise(words.select("word", "n", letter_mask(F.col("word")).alias("mask")), "spelling-masks")
    left = _keys(masked, [0]).select("key", F.col("word").alias("a"), F.col("mask").alias("a_mask"), F.col("n").alias("a_n"))
    right = _keys(masked, [0, 1]).select("key", F.col("word").alias("b"), F.col("mask").alias("b_mask"), F.col("n").alias("b_n"))
    a, b = F.col("a"), F.col("b")
    flips = F.col("a_mask").bitwiseXOR(F.col("b_mask"))
    equal = [flips.bitwiseAND(F.lit(band)) == 0 for band in BANDS]
    half = F.floor(F.char_length(a) / 2).cast("int")
    start = F.substring(a, F.lit(1), half) == F.substring(b, F.lit(1), half)
    slot = 2 * F.when(equal[0], 0).when(equal[1], 1).otherwise(2) + F.when(start, 0).otherwise(1)
    longer = F.char_length(b) - F.char_length(a)
    near = (F.bit_count(flips) <= 2) & ((longer == 1) | ((longer == 0) & (a < b))) & (slot == F.col("key").bitwiseAND(F.lit(7))) & (F.levenshtein(a, b, 1) == 1)
    return left.join(right.withColumnRenamed("key", "_key"), (F.col("key") == F.col("_key")) & near).select("a", "a_n", "b", "b_n")


def follow(forms: DataFrame, longest: int) -> DataFrame:
    """(word, root) of forms (word, form): the last word that forms lead to, over at most `longest` steps and without circles.

    Each round doubles the steps that are done."""
    at = materialise(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    for _ in range(math.ceil(math.log2(max(1, longest)))):
        further = at.select(F.col("word").alias("_w"), F.col("root").alias("_r"))
        at = materialise(at.join(further, F.col("root") == F.col("_w"), "left").select("word", F.coalesce("_r", "root").alias("root")), "spelling-roots")
    return at


def group_variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n for words (word string, n long).

    form: the near word of largest n, ties to the smallest by code points, if that n is at least `ratio` (2 or more) times
    the word's; root: where forms lead to from there, the word itself without one. n_near: how many words are near.
    Rows of one word are added up; null words and null counts take no part. An empty table gives no rows."""
    words = words.where("word IS NOT NULL").groupBy("word").agg(F.sum("n").cast("long").alias("n")).where("n IS NOT NULL")
    words = materialise(words, "spelling-words")
    two = F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n"))))
    best = near_pairs(words).select(two.alias("_p")).select("_p.*").groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("_best"))
    enough = -F.col("_best.less") >= ratio * F.col("n")
    told = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("_best.near")).alias("form"), F.when(enough, -F.col("_best.less")).alias("form_n"))
    told = materialise(told, "spelling-forms")
    most = words.agg(F.max("n")).first()[0] or 1
    roots = follow(told.where("form IS NOT NULL"), math.ceil(math.log(max(2, most), ratio)) + 1)  # each step multiplies n by ratio at least
    return told.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def count_runs(docs: DataFrame, id_col: str, text_col: str, every: int = 31) -> DataFrame:
    """(word, n): runs of letters of whole texts, those whose crc32 with their document's id `every` divides without one code point.

    Null texts have no words; a null id counts as empty. Words of under 7 code points or under 2 occurrences are left out."""
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_id"), F.explode(letter_runs(F.col(text_col))).alias("_run"))
    h = F.crc32(F.concat("_id", F.lit(":"), "_run").cast("binary"))
    at = (h % F.char_length("_run")).cast("int")
    damaged = F.concat(F.substring("_run", F.lit(1), at), F.substring("_run", at + 2, F.char_length("_run")))
    words = runs.select(F.when(h % every == 0, damaged).otherwise(F.col("_run")).alias("word")).where(F.char_length("word") >= LEAST_LENGTH)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_COUNT)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """word, form, root, n, n_near, form_n of all documents' words."""
    return group_variants(count_runs(table(spark, sf_dir, "documents"), "doc_id", "text"))


OP11_SQL = r"""
WITH RECURSIVE run AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS r FROM documents) GROUP BY 1, 2
), hashed AS (
  SELECT r, n, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(octet_length(encode(id || ':' || r))),
    lambda i: list_prepend(('0x' || substr(hex(encode(id || ':' || r)), 2 * i::INT + 1, 2))::BIGINT, [-1, -1, -1, -1, -1, -1, -1, -1]::BIGINT[])))),
    lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END), 4294967295) AS h
  FROM run WHERE length(r) >= 7
), word AS (
  SELECT CASE WHEN h % 31 = 0 THEN left(r, (h % length(r))::INT) || substr(r, (h % length(r))::INT + 2) ELSE r END AS word, sum(n)::BIGINT AS n
  FROM hashed GROUP BY 1 HAVING length(word) >= 7 AND sum(n) >= 2
), less AS (
  SELECT word, n, i, left(word, i::INT) || substr(word, i::INT + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM word)
), near AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM less a JOIN less b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN word b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM less a JOIN word b ON a.rest = b.word
), best AS (
  SELECT word, count(*) AS n_near, min({'less': -near_n, 'near': near}) AS best FROM near GROUP BY 1
), told AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.less >= 10 * n THEN best.near END AS form, CASE WHEN -best.less >= 10 * n THEN -best.less END AS form_n
  FROM word LEFT JOIN best USING (word)
), path AS (
  SELECT word, word AS at FROM told UNION ALL SELECT p.word, t.form FROM path p JOIN told t ON t.word = p.at WHERE t.form IS NOT NULL
), root AS (
  SELECT p.word, p.at AS root FROM path p JOIN told t ON t.word = p.at WHERE t.form IS NULL
)
SELECT word, form, root, n, n_near, form_n FROM told JOIN root USING (word)
"""
