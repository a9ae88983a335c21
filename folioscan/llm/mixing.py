"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Words are dealt in blocks of BLOCK. Blocks go to sources, and a source's blocks to its shards, by the highest quotients
weight / (2 seats + 1), which gives integer quotas. Each source's documents are dealt by hash over shards and laid end to
end there in a seeded order; a shard takes its quota of blocks of that stream from a seeded block on, and around again
where the quota exceeds the stream. So the choice is random by document, and few documents are cut.

Work is by (source, shard), with as many shards as a source needs to hold SHARD_WORDS words or SHARD_DOCS documents in
each (MOST_SHARDS at most, which are larger then), so no task gets a whole source. Sources are ranked by ranges, and
levels and quotas found from sums over sources and shards: only the seats that are in question are ranked together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from folioscan.llm.common import WORD, materialise, table

BLOCK, SHARD_WORDS, SHARD_DOCS, MOST_SHARDS, SEED = 32, 1 << 18, 2048, 1 << 16, 17
#: By code point of the source's name, null last, repeating.
WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2
#: Seats of a group that are ranked in one task, and the divisors that are tried at once where more are in question.
RANKED, TRIED = 1 << 16, 32

_PIECES = "array<struct<start:bigint,words:bigint>>"


def ranked(rows: DataFrame, order: Column) -> DataFrame:
    """rows with their rank (from 0) in an order that leaves no ties, by ranges."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = materialise(rows.repartitionByRange(parts, order).withColumn("_part", F.spark_partition_id()), "mix-ranges")
    held = {r["_part"]: r["n"] for r in placed.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each range
    before = [sum(n for p, n in held.items() if p < i) for i in range(max(held, default=0) + 1)]
    within = F.row_number().over(Window.partitionBy("_part").orderBy(order)) - 1
    return placed.withColumn("rank", within + F.element_at(F.lit(before), F.col("_part") + 1)).drop("_part")


def _seats(weight: Column, quotient: Column) -> Column:
    """How many of weight / 1, weight / 3, weight / 5, ... reach a quotient."""
    return F.when(weight >= quotient, F.floor((weight / quotient + 1) / 2)).otherwise(0).cast("long")


def sainte_lague(parties: DataFrame, group: str, key: str, weight: str, seats: str) -> DataFrame:
    """parties with a column quota: in each group, `seats` seats by the highest quotients, ties to the smaller key.

    With n parties of total weight w, the last seat's quotient lies between w / (2 seats + n) and w / (2 seats - n). Above,
    seats are sure; below, out of the question; those between are ranked, after divisors in between have been tried for
    as long as they are many. Seats of a group without weight stay free."""
    w, total, n = F.col("_weight"), F.col("_total"), F.col("_n")
    bids = materialise(parties.select(F.col(group).alias("_group"), F.col(key).alias("_key"), F.col(weight).cast("double").alias("_weight"), F.col(seats).alias("_want")).where("_weight > 0"), "mix-bids")
    bounds = bids.groupBy("_group").agg(F.sum("_weight").alias("_total"), F.count(F.lit(1)).alias("_n"), F.max("_weight").alias("_most"), F.max("_want").alias("_want"))
    high = F.when(2 * F.col("_want") > n, total / (2 * F.col("_want") - n)).otherwise(2 * F.col("_most"))
    bounds = materialise(bounds.select("_group", "_want", (total / (2 * F.col("_want") + n) * (1 - 1e-9)).alias("_low"), (high * (1 + 1e-9)).alias("_high")), "mix-bounds")
    bids = bids.drop("_want")
    for _ in range(4):
        open_ = bids.join(bounds, "_group").groupBy("_group").agg(F.sum(_seats(w, F.col("_low")) - _seats(w, F.col("_high"))).alias("n"))
        if (open_.agg(F.max("n")).first()[0] or 0) <= RANKED:
            break
        tried = lambda k: F.col("_low") + (F.col("_high") - F.col("_low")) * k / TRIED
        counts = bids.join(bounds, "_group").groupBy("_group", "_want", "_low", "_high").agg(F.array(*(F.sum(_seats(w, tried(k))) for k in range(1, TRIED))).alias("_got"))
        at = F.transform("_got", lambda c, i: F.struct(tried(i + 1).alias("q"), c.alias("c")))
        found = lambda keep: F.transform(F.filter(at, keep), lambda x: x["q"])
        low = F.coalesce(F.array_max(found(lambda x: x["c"] >= F.col("_want"))), "_low")
        high = F.coalesce(F.array_min(found(lambda x: x["c"] <= F.col("_want"))), "_high")
        bounds = materialise(counts.select("_group", "_want", low.alias("_low"), high.alias("_high")), "mix-bounds")
    bids = bids.join(bounds, "_group").withColumn("_sure", _seats(w, F.col("_high"))).withColumn("_may", _seats(w, F.col("_low")))
    bids = materialise(bids.select("_group", "_key", "_weight", "_want", "_sure", "_may"), "mix-sure")
    free = bids.groupBy(F.col("_group").alias("_g")).agg((F.max("_want") - F.sum("_sure")).alias("_free"))
    asked = bids.where("_may > _sure").join(free, F.col("_group") == F.col("_g")).select("_group", "_key", "_free", "_weight", F.explode(F.sequence("_sure", F.col("_may") - 1)).alias("_j"))
    best = Window.partitionBy("_group").orderBy((F.col("_weight") / (2 * F.col("_j") + 1)).desc(), "_key", "_j")
    won = asked.withColumn("_rank", F.row_number().over(best)).where(F.col("_rank") <= F.col("_free")).groupBy("_group", "_key").agg(F.count(F.lit(1)).alias("_won"))
    quotas = bids.join(won, ["_group", "_key"], "left").select("_group", "_key", (F.col("_sure") + F.coalesce("_won", F.lit(0))).alias("_quota"))
    out = parties.join(quotas, (F.col(group) == F.col("_group")) & (F.col(key) == F.col("_key")), "left")
    return out.withColumn("quota", F.coalesce("_quota", F.lit(0)).cast("long")).drop("_group", "_key", "_quota")


def source_targets(sizes: DataFrame, share: float = SHARE, most: int = MOST, weights: tuple[int, ...] = WEIGHTS) -> tuple[DataFrame, float]:
    """(a row for each source: source, rank (from 0), weight, source_size, source_docs, target; words of the targets that aren't at their bound).

    Targets are level * weight, but `most` times the source's size where that is less. The level is what the sources at
    their bound leave of the share, over the other sources' weights: it rises until no further source reaches its bound."""
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_docs"))
    s = ranked(s, F.col("source").asc_nulls_last())
    s = materialise(s.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))), "mix-ranked")
    total = s.agg(F.sum("source_size")).first()[0] or 0
    at_bound, level, left, full = F.lit(False), 0.0, 0.0, None
    while True:
        x = s.agg(F.coalesce(F.sum(F.when(at_bound, F.col("source_size"))), F.lit(0)).alias("full"), F.sum(F.when(~at_bound, F.col("weight"))).alias("weight"), F.count_if(at_bound).alias("n")).first()
        left = share * total - most * x["full"]
        if not x["weight"]:
            level, left = float("inf"), 0.0
            break
        if full == x["n"]:
            break
        level, full = left / x["weight"], x["n"]
        at_bound = F.col("weight") * F.lit(level) >= most * F.col("source_size")
    return s.withColumn("target", F.least(F.col("weight") * F.lit(level), (most * F.col("source_size")).cast("double"))), left


def _plan(items: DataFrame, keys: list[str], seed: int, block: int, share: float, most: int, weights: tuple[int, ...]) -> DataFrame:
    """items (source, size, ...) with source_size, target, passes and pieces; they go by their keys, and those alike in all of them are taken alike or change places."""
    s, open_ = source_targets(items, share, most, weights)
    full = F.col("target") >= most * F.col("source_size")
    s = s.withColumn("_bid", F.when(full, 0.0).otherwise(F.col("target"))).withColumn("_all", F.lit(0)).withColumn("_blocks", F.lit(round(open_ / block)).cast("long"))
    s = sainte_lague(s, "_all", "rank", "_bid", "_blocks")
    shards = F.least(F.greatest(F.lit(1), F.ceil(F.col("source_size") / SHARD_WORDS), F.ceil(F.col("source_docs") / SHARD_DOCS)), F.lit(MOST_SHARDS)).cast("long")
    s = materialise(s.select(F.col("source").alias("_source"), "rank", "source_size", "target", F.when(full, F.lit(None)).otherwise(F.col("quota")).alias("quota"), shards.alias("_shards")), "mix-sources")

    here = Window.partitionBy("rank", "_shard")
    dealt = items.join(s.drop("quota"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source").withColumn("_shard", F.pmod(F.xxhash64(F.lit(seed), *keys), F.col("_shards")))
    placed = dealt.withColumn("_held", F.sum("size").over(here)).withColumn("_end", F.sum("size").over(here.orderBy(F.xxhash64(F.lit(seed + 1), *keys), *keys, "size").rowsBetween(Window.unboundedPreceding, 0)))
    placed = materialise(placed.drop("_shards"), "mix-placed")

    quotas = placed.groupBy("rank", "_shard").agg(F.max("_held").alias("_held")).join(s.select("rank", "quota"), "rank").withColumnRenamed("quota", "_blocks")
    quotas = sainte_lague(quotas.where("_held > 0"), "rank", "_shard", "_held", "_blocks")
    take = F.least(F.when(F.col("_blocks").isNull(), most * F.col("_held")).otherwise(F.col("quota") * block), most * F.col("_held"))
    quotas = quotas.withColumn("_take", take).withColumn("passes", F.floor(F.col("_take") / F.col("_held")))
    first = F.pmod(F.xxhash64(F.lit(seed + 2), "rank", "_shard"), F.ceil(F.col("_held") / block)) * block
    quotas = materialise(quotas.select(F.col("rank").alias("_r"), F.col("_shard").alias("_s"), "passes", first.alias("_first"), (first + F.col("_take") - F.col("passes") * F.col("_held")).alias("_stop")), "mix-quotas")

    rows = placed.join(quotas, (F.col("rank") == F.col("_r")) & (F.col("_shard") == F.col("_s")), "left").withColumn("_start", F.col("_end") - F.col("size"))

    def piece(low: Column, high: Column) -> Column:
        low, high = F.greatest(low, F.col("_start")), F.least(high, F.col("_end"))
        return F.struct((low - F.col("_start")).alias("start"), F.greatest(high - low, F.lit(0)).alias("words"))

    # what goes beyond the stream's end comes from its start
    around = F.array(piece(F.lit(0).cast("long"), F.col("_stop") - F.col("_held")), piece(F.col("_first"), F.least("_stop", "_held")))
    rows = rows.withColumn("pieces", F.when((F.col("size") > 0) & F.col("_r").isNotNull(), F.filter(around, lambda p: p["words"] > 0)).otherwise(F.array().cast(_PIECES)))
    whole = F.exists("pieces", lambda p: p["words"] == F.col("size"))
    passes = F.when((F.col("size") > 0) & F.col("_r").isNotNull(), F.col("passes") + whole.cast("long")).otherwise(0).cast("long")
    rows = rows.withColumn("passes", passes).withColumn("pieces", F.when(whole, F.array().cast(_PIECES)).otherwise(F.col("pieces")))
    return rows.drop("rank", "_shard", "_held", "_end", "_start", "_r", "_s", "_first", "_stop")


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, block: int = BLOCK, share: float = SHARE, most: int = MOST, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """One row for each row of docs: id, size, source_size, target, taken, passes, pieces, source.

    size counts words (null text: 0). taken is how many words of the document the mix takes: `passes` full copies and
    the word ranges `pieces` (start, words; start from 0). Documents without words take none. Null is a source like any
    other and comes last. Rows with the same id are documents of their own. Other columns are ignored. An empty table
    gives no rows. Reruns on the same rows agree, however they are partitioned."""
    sizes = materialise(docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size")), "mix-sizes")
    rows = _plan(sizes, ["_id"], seed, block, share, most, weights)
    taken = F.col("passes") * F.col("size") + F.aggregate("pieces", F.lit(0).cast("long"), lambda a, p: a + p["words"])
    return rows.select(F.col("_id").alias(id_col), "size", "source_size", "target", taken.alias("taken"), "passes", "pieces", "source")


def cut(text: Column, pieces: Column) -> Column:
    """The words of the pieces with the white space between them, pieces joined by line ends."""
    words = F.regexp_extract_all(text, F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"), 1)
    return F.array_join(F.transform(pieces, lambda p: F.regexp_replace(F.array_join(F.slice(words, (p["start"] + 1).cast("int"), p["words"].cast("int")), ""), r"\A[\x20\x09-\x0D]+", "")), "\n")


def draw(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, block: int = BLOCK, share: float = SHARE, most: int = MOST, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """The mix itself, in the columns of docs, which may have any names: a row for each full copy, and one of the words of
    the pieces where there are any, with the white space between them. Documents of which nothing is taken go. A column
    n_chars is brought up to date. Rows alike in id, text and source are one document of as many times the words, with the
    other columns of the first of them by JSON. An empty table gives no rows."""
    hashes = lambda df: [F.xxhash64(F.lit(i), df[id_col], df[text_col], df[source_col]) for i in (0, 1)]
    keys = docs.select(*(h.alias(k) for h, k in zip(hashes(docs), ("k", "l"), strict=True)), docs[source_col].alias("source"), n_words(docs[text_col]).alias("one"))
    keys = materialise(keys.groupBy("k", "l").agg(F.min("source").alias("source"), F.max("one").alias("one"), F.count(F.lit(1)).alias("copies")), "mix-sizes")
    plan = _plan(keys.withColumn("size", F.col("one") * F.col("copies")), ["k", "l"], seed, block, share, most, weights)
    # of n rows alike, each `one` words long, words i * one to (i + 1) * one are row i's
    words = F.col("passes") * F.col("size") + F.aggregate("pieces", F.lit(0).cast("long"), lambda a, p: a + p["words"])
    alone = F.col("copies") == 1
    rest = F.array(F.struct(F.lit(0).cast("long").alias("start"), (words % F.col("one")).alias("words")))
    plan = plan.where(words > 0).select(
        "k", "l", F.when(alone, F.col("passes")).otherwise(F.floor(words / F.col("one"))).alias("passes"), F.when(alone, F.col("pieces")).otherwise(F.filter(rest, lambda p: p["words"] > 0)).alias("pieces")
    )
    plan = materialise(plan, "mix-plan")
    again = materialise(keys.where("copies > 1").select("k", "l"), "mix-repeated")
    rows = docs
    if again.take(1):
        k, l = hashes(docs)
        listed = (k == again["k"]) & (l == again["l"])
        twice = docs.join(again, listed, "left_semi")
        row = F.struct(*(twice[c] for c in docs.columns))
        once = twice.groupBy(*hashes(twice)).agg(F.min_by(row, F.to_json(row)).alias("row")).select("row.*")
        rows = docs.join(again, listed, "left_anti").unionByName(once)
    k, l = hashes(rows)
    joined = rows.join(plan, (k == plan["k"]) & (l == plan["l"]))
    text, pieces = rows[text_col], plan["pieces"]
    texts = F.concat(F.array_repeat(text, plan["passes"].cast("int")), F.when(F.size(pieces) > 0, F.array(cut(text, pieces))).otherwise(F.array().cast("array<string>")))
    out = joined.select(*(F.explode(texts).alias(c) if c == text_col else rows[c] for c in docs.columns))
    if "n_chars" in docs.columns and "n_chars" not in (id_col, text_col, source_col):
        out = out.withColumn("n_chars", F.length(text_col).cast(dict(docs.dtypes)["n_chars"]))
    return out


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
