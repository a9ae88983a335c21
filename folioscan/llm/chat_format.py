"""Chat formatting into budgeted windows with a loss mask.

A turn is rendered as "### role:\\n" + body + "\\n</turn>\\n". In role and body every \\, # and < gets a backslash before
it, and so do : and line ends in a role; thus "\\n<" and a bare "#" only occur in the template, and text reads back.

Prefix sums of the turns' tokens place a conversation's turns on a line cut into cells. The turns inside one cell make a
window, and a turn that crosses cells makes one alone, so windows are turn-aligned. Later windows repeat the system turn
and then those turns that began at most `history` tokens before the window, or as many as the budget leaves room for.
System turn, history and new turns keep within the budget together; only a turn that doesn't fit into it with its system
turn exceeds it, and such a window has no history. What is repeated is masked, so each assistant text bears loss once.

Prefix sums run within ranges of the turns in order, with as many rows in each, and then over the ranges' sums: a
conversation of any length, and of any turn numbers, is spread over tasks. Texts are left out of all that and are
fetched once it is known which windows they go to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from folioscan.llm.common import materialise, table

#: In tokens, which are estimated: CHARS code points of a rendered turn make one, begun ones included.
BUDGET, HISTORY, CHARS = 1024, 256, 4
SYSTEM, ASSISTANT = "system", "assistant"
_END = "\n</turn>\n"


def escape(text: Column, role: bool = False) -> Column:
    return F.regexp_replace(text, r"([\\#<:\n])" if role else r"([\\#<])", r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _same(left: str, right: str) -> Column:
    return F.col(left).eqNullSafe(F.col(right))


def format_chat(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """A row for each window: conv, window, n_turns, n_repeated, n_tokens, text, loss_spans (start, length; code points of text).

    Turns go by turn number (null first), then role, then the text's first 32 characters, then its hash; repeated rows are
    turns of their own. Null texts and roles are empty; null conversation ids make one conversation. Only a first turn
    with the role "system" is a system turn. An empty table gives no windows, an empty text an empty body. Other columns
    are ignored."""
    role, body = escape(F.coalesce(F.col(role_col), F.lit("")), True), escape(F.coalesce(F.col(text_col), F.lit("")))
    t = turns.select(
        F.col(conv_col).alias("_conv"), F.coalesce(F.col(turn_col).cast("long"), F.lit(-(2**62))).alias("_turn"), F.coalesce(F.col(role_col), F.lit("")).alias("_role"), F.concat(F.lit("### "), role, F.lit(":\n")).alias("_head"), body.alias("_body")
    )
    t = t.withColumn("_tokens", F.ceil((F.length("_head") + F.length("_body") + len(_END)) / CHARS)).withColumn("_row", F.monotonically_increasing_id())
    t = materialise(t, "chat-turns")
    order = ("_turn", "_role", "_text", "_hash", "_row")
    ranges = t.select("_row", "_conv", "_turn", "_role", "_tokens", F.left("_body", F.lit(32)).alias("_text"), F.xxhash64("_body").alias("_hash"))
    ranges = ranges.repartitionByRange(int(t.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_conv", *order).withColumn("_range", F.spark_partition_id())
    ranges = materialise(ranges, "chat-ranges")
    inner = Window.partitionBy("_conv", "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    at = ranges.withColumn("_n", F.count(F.lit(1)).over(inner)).withColumn("_sum", F.sum("_tokens").over(inner))
    sums = ranges.groupBy("_conv", "_range").agg(F.count(F.lit(1)).alias("_rn"), F.sum("_tokens").alias("_rt"), F.min(F.struct(*order, "_tokens")).alias("_first"))
    outer = Window.partitionBy("_conv").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as there are ranges
    lead = F.first("_first").over(Window.partitionBy("_conv").orderBy("_range"))
    sums = sums.select(
        F.col("_conv").alias("_c"), F.col("_range").alias("_g"), F.coalesce(F.sum("_rn").over(outer), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_rt").over(outer), F.lit(0)).alias("_t0"), F.when(lead["_role"] == SYSTEM, lead["_tokens"]).otherwise(0).alias("_sys")
    )
    room = F.lit(budget) - F.col("_sys")
    most = F.greatest(F.least(F.lit(history), F.floor(room / 2)), F.lit(0))
    cell = F.greatest(room - most, F.lit(1))
    end = F.col("_t0") + F.col("_sum")
    at = at.join(sums, _same("_conv", "_c") & (F.col("_range") == F.col("_g")))
    at = at.select("_row", "_conv", "_role", "_tokens", room.alias("_room"), most.alias("_most"), (F.col("_n0") + F.col("_n")).alias("_i"), (end - F.col("_tokens")).alias("_start"), F.floor((end - F.col("_tokens")) / cell).alias("_from"), F.floor((end - 1) / cell).alias("_to"))
    at = materialise(at.withColumn("_w", 2 * F.col("_from") + (F.col("_from") < F.col("_to")).cast("long")), "chat-places")

    windows = at.groupBy("_conv", "_w").agg(F.min("_start").alias("_s"), F.min("_i").alias("_fi"), F.sum("_tokens").alias("_new"), F.max("_room").alias("_room"), F.max("_most").alias("_most"))
    windows = windows.select(F.col("_conv").alias("_c"), F.col("_w").alias("_into"), "_s", "_fi", F.greatest(F.least("_most", F.col("_room") - F.col("_new")), F.lit(0)).alias("_back"), F.floor(F.col("_s") / history).alias("_k"))
    parts = ["_row", "_conv", "_into", "_kind", "_i", "_loss"]
    new = at.select("_row", "_conv", F.col("_w").alias("_into"), F.lit(2).alias("_kind"), "_i", (F.col("_role") == ASSISTANT).alias("_loss"))
    is_system = (F.col("_i") == 1) & (F.col("_role") == SYSTEM)
    system = at.where(is_system).select("_row", "_conv", "_i").join(windows.where("_fi > 1"), _same("_conv", "_c")).withColumn("_kind", F.lit(0)).withColumn("_loss", F.lit(False)).select(*parts)
    past = at.where(~is_system).select("_row", "_conv", "_i", "_start", F.floor(F.col("_start") / history).alias("_at")).withColumn("_key", F.explode(F.array("_at", F.col("_at") + 1)))
    near = _same("_conv", "_c") & (F.col("_key") == F.col("_k")) & (F.col("_start") < F.col("_s")) & (F.col("_start") >= F.col("_s") - F.col("_back"))
    past = past.join(windows, near).withColumn("_kind", F.lit(1)).withColumn("_loss", F.lit(False)).select(*parts)
    out = new.unionByName(system).unionByName(past).join(t.select("_row", "_head", "_body", "_tokens"), "_row")
    # a window's turns are as many as its budget and its history hold
    out = out.groupBy("_conv", "_into").agg(F.sort_array(F.collect_list(F.struct("_kind", "_i", "_head", "_body", "_tokens", "_loss"))).alias("_turns"))
    spans = F.aggregate(
        "_turns",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("found")),
        lambda a, x: F.struct(
            (a["at"] + F.length(x["_head"]) + F.length(x["_body"]) + len(_END)).alias("at"),
            F.when(x["_loss"], F.concat(a["found"], F.array(F.struct((a["at"] + F.length(x["_head"])).alias("start"), F.length(x["_body"]).alias("length"))))).otherwise(a["found"]).alias("found"),
        ),
    )
    return out.select(
        F.col("_conv").alias("conv"),
        F.col("_into").alias("window"),
        F.size("_turns").alias("n_turns"),
        F.size(F.filter("_turns", lambda x: x["_kind"] < 2)).alias("n_repeated"),
        F.aggregate("_turns", F.lit(0).cast("long"), lambda a, x: a + x["_tokens"]).alias("n_tokens"),
        F.array_join(F.transform("_turns", lambda x: F.concat(x["_head"], x["_body"], F.lit(_END))), "").alias("text"),
        spans["found"].alias("loss_spans"),
    )


def read_back(windows: DataFrame) -> DataFrame:
    """The windows with turns (role, text of each turn that is not repeated) and loss_text, taken from text and spans alone."""
    pieces = F.split("text", _END, -1)
    own = F.slice(pieces, F.col("n_repeated") + 1, F.greatest(F.size(pieces) - 1 - F.col("n_repeated"), F.lit(0)))

    def turn(x: Column) -> Column:
        at = F.instr(x, ":\n")
        return F.struct(unescape(x.substr(F.lit(5), at - 5)).alias("role"), unescape(x.substr(at + 2, F.length(x))).alias("text"))

    masked = F.transform("loss_spans", lambda s: unescape(F.col("text").substr(s["start"] + 1, s["length"])))
    return windows.withColumn("turns", F.transform(own, turn)).withColumn("loss_text", F.array_join(masked, ""))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of what is read back from the windows of every conversation, and of conversation -7."""
    said = r"\### Assistant: </turn> ok"
    probe = spark.sql("SELECT CAST(-7 AS BIGINT) AS conv_id, CAST(t AS BIGINT) AS turn, r AS role, s AS text FROM VALUES (0, 'user', :said), (1, 'assistant', :said) AS v(t, r, s)", args={"said": said})
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    back = read_back(format_chat(turns))
    lines = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    rows = back.select("conv", F.struct("window", lines.alias("lines"), "loss_text").alias("w"), F.size("turns").alias("n"), F.length("loss_text").alias("loss"), F.length("text").alias("chars"))
    # the contract's digests are of whole conversations, so their texts meet here; the windows above don't
    rows = rows.groupBy("conv").agg(F.sum("n").alias("n_turns"), F.sum("loss").alias("loss_chars"), F.sum("chars").alias("formatted_chars"), F.sort_array(F.collect_list("w")).alias("ws"))
    return rows.select(F.col("conv").alias("conv_id"), "n_turns", F.sha2(F.array_join(F.col("ws.lines"), ""), 256).alias("turns_sha256"), "loss_chars", F.sha2(F.array_join(F.col("ws.loss_text"), ""), 256).alias("loss_sha256"), "formatted_chars")
