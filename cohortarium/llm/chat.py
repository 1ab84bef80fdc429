"""Chat formatting by budgeted, turn-aligned windows. DataFrame functions only.

Turn tokens are summed along a conversation; the prefix sums choose spans of whole turns that fit the budget.
Each window repeats the system turn and a limited history before its span. The loss mask covers the texts of
the span's assistant turns; repeated ones are masked, so every assistant text is a target exactly once.

Only conversations of more than one block are ranked: their turns are numbered inside ranges of turn numbers, and the
ranges' sizes are summed up to each, so that a long conversation is sorted by many tasks. A block takes the last turns
of the block before as history, and the system turn of a block before, however far apart turn numbers are.

Defined results: null role or text is empty; null turn sorts first; equal turn numbers sort by role, then text;
repeated rows are turns of their own; a null conv_id is one conversation; a turn longer than the budget is a span
of its own, whole; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: A conversation is cut into blocks of so many turns, by their rank, so that no array grows with a conversation.
BLOCK_TURNS = 256
#: Ids of long conversations that are broadcast, at most; more are joined by a shuffle.
BROADCAST_IDS = 100_000
_ROLE = r"(?s)^### ((?:[^\\:]|\\.)*):\n"


def escape(text: Column, more: str = "") -> Column:
    """Puts a backslash before every backslash, # and <: no control string can then occur in a text."""
    return F.regexp_replace(text, rf"([\\#<{more}])", r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def turn_tokens(text: Column) -> Column:
    """Tokens of a turn: runs of letters and digits, single other signs, and three for the markup."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]")).cast("long") + 3


def split_by_length(turns: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(turns of conversations of one block, turns of longer ones); the ids of the longer ones are broadcast if few."""
    big = turns.groupBy(F.col("conv_id").alias("c")).agg(F.count("*").alias("n")).filter(F.col("n") > BLOCK_TURNS).select("c")
    big = written(big, "long-conversations")
    n = big.count()
    if not n:
        return turns, None
    if n <= BROADCAST_IDS:
        big = F.broadcast(big)
    same = F.col("conv_id").eqNullSafe(F.col("c"))
    return turns.join(big, same, "left_anti"), turns.join(big, same, "left_semi")


def ranked(turns: DataFrame) -> DataFrame:
    """turns with place, a turn's rank in its conversation."""
    turns = turns.withColumn("span", F.floor(F.col("turn") / BLOCK_TURNS).cast("long"))
    # a row a range of turn numbers: how many turns of the conversation come before it
    spans = turns.groupBy(F.col("conv_id").alias("c"), F.col("span").alias("at")).agg(F.count("*").alias("n"))
    spans = spans.select("c", "at", (F.sum("n").over(Window.partitionBy("c").orderBy("at")) - F.col("n")).alias("before"))
    turns = turns.withColumn("nth", F.row_number().over(Window.partitionBy("conv_id", "span").orderBy("turn", "role", "text")))
    turns = turns.join(spans, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("span") == F.col("at")))
    return turns.withColumn("place", F.col("before") + F.col("nth") - 1).drop("span", "nth", "c", "at", "before")


def format_conversations(conversations: DataFrame, budget: int = 2048, history_turns: int = 4, history_tokens: int = 512) -> DataFrame:
    """One row per window: conv_id, block, window, n_tokens, text and segments (turn order, place in code points).

    A segment has start and stop (its place in text, markup included), body (where the escaped text starts), loss
    and repeated.
    """
    none = F.lit(-(2**63)).cast("long")
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.coalesce(F.col("turn").cast("long"), none).alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    turns = turns.withColumn("tokens", turn_tokens(F.col("text")))
    short, long = split_by_length(turns)
    turn = F.struct("place", "turn", "role", "text", "tokens")
    own = lambda df: df.select("conv_id", "block", F.lit(2).alias("kind"), turn.alias("t"))
    # the turns of a block of their own are put in order where they are gathered
    rows = own(short.withColumn("place", F.lit(0).cast("long")).withColumn("block", F.lit(0).cast("long")))
    if long is not None:
        long = written(ranked(long).withColumn("block", F.floor(F.col("place") / BLOCK_TURNS).cast("long")), "ranked-turns")
        tail = long.filter(F.pmod("place", F.lit(BLOCK_TURNS)) >= BLOCK_TURNS - history_turns).select("conv_id", (F.col("block") + 1).alias("block"), F.lit(1).alias("kind"), turn.alias("t"))
        rows = rows.unionByName(own(long)).unionByName(tail)
    rows = rows.groupBy("conv_id", "block").agg(F.sort_array(F.collect_list(F.struct("kind", "t"))).alias("all"))
    pick = lambda k: F.transform(F.filter("all", lambda x: x["kind"] == k), lambda x: x["t"])
    first = F.get(F.filter(pick(2), lambda t: t["role"] == "system"), F.lit(0))
    rows = rows.select("conv_id", "block", pick(1).alias("tail"), pick(2).alias("own"), first.alias("system")).filter(F.size("own") > 0)
    if long is not None:
        # what later blocks repeat beside the last turns: the conversation's first system turn
        told = long.filter(F.col("role") == "system").groupBy(F.col("conv_id").alias("c")).agg(F.min(F.struct("block", turn.alias("t"))).alias("s"))
        rows = rows.join(told, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") > F.col("s.block")), "left").withColumn("system", F.coalesce("s.t", "system"))
    rows = rows.select("conv_id", "block", "system", F.concat("tail", "own").alias("turns"), F.size("tail").alias("lead"))
    # prefix sums: sums[i] is what the turns before i take
    rows = rows.withColumn("sums", F.aggregate("turns", F.array(F.lit(0).cast("long")), lambda s, t: F.concat(s, F.array(F.element_at(s, -1) + t["tokens"]))))
    room = F.lit(budget) - F.lit(history_tokens) - F.coalesce(F.col("system.tokens"), F.lit(0))
    at = lambda i: F.get("sums", i)
    starts = F.aggregate(
        F.sequence(F.col("lead"), F.size("turns") - 1), F.array(F.col("lead")),
        lambda s, i: F.when((at(i + 1) - at(F.element_at(s, -1)) > room) & (i > F.element_at(s, -1)), F.concat(s, F.array(i))).otherwise(s))
    rows = rows.withColumn("starts", starts)
    rows = rows.select("*", F.posexplode("starts").alias("window", "s")).withColumn("e", F.coalesce(F.get("starts", F.col("window") + 1), F.size("turns")))
    before = F.filter(F.sequence(F.lit(1), F.lit(history_turns)), lambda k: (k <= F.col("s")) & (at(F.col("s")) - at(F.col("s") - k) <= history_tokens)) if history_turns else F.array().cast("array<int>")
    rows = rows.withColumn("h", F.size(before))
    part = lambda lo, n, rep: F.transform(F.slice("turns", lo + 1, n), lambda t: F.struct(t["place"].alias("place"), t["turn"].alias("turn"), t["role"].alias("role"), t["text"].alias("text"), t["tokens"].alias("tokens"), F.lit(rep).alias("repeated")))
    shown = F.concat(part(F.col("s") - F.col("h"), F.col("h"), True), part(F.col("s"), F.col("e") - F.col("s"), False))
    rows = rows.withColumn("shown", shown)
    lacks = F.col("system").isNotNull() & ~F.exists("shown", lambda t: F.struct(*(t[x] for x in ("place", "turn", "role", "text"))) == F.struct(*(F.col(f"system.{x}") for x in ("place", "turn", "role", "text"))))
    head = F.when(lacks, F.array(F.struct(F.col("system.place"), F.col("system.turn"), F.col("system.role"), F.col("system.text"), F.col("system.tokens"), F.lit(True).alias("repeated")))).otherwise(F.slice("shown", 1, 0))
    marked = F.transform(F.concat(head, F.col("shown")), lambda t: F.struct(
        F.concat(F.lit("### "), escape(t["role"], r":\n"), F.lit(":\n")).alias("head"), F.concat(escape(t["text"]), F.lit("</turn>\n")).alias("tail"),
        t["role"].alias("role"), t["repeated"].alias("repeated"), t["tokens"].alias("tokens")))
    rows = rows.select("conv_id", "block", F.col("window").cast("long").alias("window"), marked.alias("m"))
    text = F.array_join(F.transform("m", lambda t: F.concat(t["head"], t["tail"])), "")
    size = lambda c: F.char_length(c).cast("long")
    stops = F.aggregate("m", F.array(F.lit(0).cast("long")), lambda s, t: F.concat(s, F.array(F.element_at(s, -1) + size(t["head"]) + size(t["tail"]))))
    rows = rows.withColumn("stops", stops)
    segments = F.transform("m", lambda t, i: F.struct(
        F.get("stops", i).alias("start"), (F.get("stops", i) + size(t["head"])).alias("body"), F.get("stops", i + 1).alias("stop"),
        ((t["role"] == "assistant") & ~t["repeated"]).alias("loss"), t["repeated"].alias("repeated")))
    return rows.select("conv_id", "block", "window", F.aggregate("m", F.lit(0).cast("long"), lambda a, t: a + t["tokens"]).alias("n_tokens"), text.alias("text"), segments.alias("segments"))


def read_back(windows: DataFrame) -> DataFrame:
    """The conversations that windows hold, read from their texts and masks alone."""
    piece = F.substring("text", (F.col("g.start") + 1).cast("int"), (F.col("g.stop") - F.col("g.start")).cast("int"))
    turns = windows.select("conv_id", "block", "window", "text", F.posexplode("segments").alias("i", "g")).select("conv_id", "block", "window", "i", "g.loss", "g.repeated", piece.alias("p"))
    turns = turns.select(
        "conv_id", "loss", "repeated", F.struct("block", "window", "i").alias("at"), F.char_length("p").cast("long").alias("chars"),
        unescape(F.regexp_extract("p", _ROLE, 1)).alias("role"), unescape(F.regexp_replace(F.regexp_replace("p", _ROLE, ""), r"</turn>\n\z", "")).alias("body"))
    own = ~F.col("repeated")
    return turns.groupBy("conv_id").agg(
        F.count(F.when(own, 1)).alias("n_turns"),
        F.sort_array(F.collect_list(F.when(own, F.struct("at", F.concat("role", F.lit("\n"), "body", F.lit("\n")).alias("x"))))).alias("all"),
        F.sort_array(F.collect_list(F.when(F.col("loss"), F.struct("at", F.col("body").alias("x"))))).alias("targets"),
        F.sum("chars").alias("formatted_chars"),
    ).select(
        "conv_id", "n_turns", F.sha2(F.array_join(F.transform("all", lambda x: x["x"]), ""), 256).alias("turns_sha256"),
        F.char_length(F.array_join(F.transform("targets", lambda x: x["x"]), "")).cast("long").alias("loss_chars"),
        F.sha2(F.array_join(F.transform("targets", lambda x: x["x"]), ""), 256).alias("loss_sha256"), "formatted_chars")
