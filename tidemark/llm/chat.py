"""Preference pairs as prompt and masked completions.

A chosen and a rejected conversation share a longest common prefix of turns.  It is rendered once as the
prompt; the rest of each is its completion, with a mask of the spans that carry loss: the words of assistant
turns and their end marks, never a header and never a user's turn.  All of it is DataFrame functions: a conversation
is an array of turns, the prefix is the place of the first turn that differs, rendering is a transform.

Edge cases: a null role is ``user`` and a null text empty; turns are ordered by number, then role and text, nulls first; rows
without a conversation id belong to none and are left out; rows that repeat a turn are turns; a conversation without
partner is paired with nothing and its rejected side is null; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
TURN = "array<struct<role:string,text:string>>"


def conversations(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id, turns): one row per conversation, its turns in order."""
    rows = turns.filter(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.struct(F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("user")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text")).alias("t")
    )
    listed = rows.groupBy("id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    return listed.select("id", F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def common_prefix(a: str, b: str) -> Column:
    """How many turns two conversations have in common from the start."""
    n = F.least(F.size(a), F.size(b))
    differs = F.transform(F.sequence(F.lit(1), n), lambda k: ~F.element_at(a, k).eqNullSafe(F.element_at(b, k)))
    first = F.array_position(differs, F.lit(True))
    return F.when(n < 1, F.lit(0)).when(first > 0, first.cast("int") - 1).otherwise(n)


def head(role: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit("\n"))


def render(turns: Column) -> Column:
    """Turns as one string."""
    return F.concat_ws("", F.transform(turns, lambda t: F.concat(head(t["role"]), t["text"], F.lit(END))))


def loss_spans(turns: Column) -> Column:
    """(start, length) in code points of what an assistant says in the rendered ``turns``, end marks included."""
    nothing = F.array().cast("array<struct<start:int,length:int>>")
    state = F.struct(F.lit(0).alias("at"), nothing.alias("spans"))

    def step(s: Column, t: Column) -> Column:
        lead = F.char_length(head(t["role"]))
        said = F.char_length(F.concat(t["text"], F.lit(END)))
        span = F.struct((s["at"] + lead).alias("start"), said.alias("length"))
        return F.struct((s["at"] + lead + said).alias("at"), F.when(t["role"] == "assistant", F.concat(s["spans"], F.array(span))).otherwise(s["spans"]).alias("spans"))

    return F.aggregate(turns, state, step, lambda s: s["spans"])


def format_pairs(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """``pairs`` with shared_turns, prompt, and text and loss spans of both completions.

    ``chosen`` and ``rejected`` are arrays of turns; ``rejected`` may be null.  A column with the name of a
    result gives way to it."""
    rows = pairs.withColumn("shared_turns", F.when(F.col(rejected).isNull(), F.lit(0)).otherwise(common_prefix(chosen, rejected)))
    n = F.col("shared_turns")
    rest = lambda c: F.slice(F.col(c), n + 1, F.greatest(F.lit(0), F.size(c) - n))
    rows = rows.withColumn("__c", rest(chosen)).withColumn("__r", rest(rejected))
    new = ("shared_turns", "prompt", "chosen_text", "chosen_loss", "rejected_text", "rejected_loss")
    return rows.select(
        *[c for c in pairs.columns if c not in new],
        "shared_turns",
        render(F.slice(F.col(chosen), F.lit(1), n)).alias("prompt"),
        render(F.col("__c")).alias("chosen_text"),
        loss_spans(F.col("__c")).alias("chosen_loss"),
        F.when(F.col(rejected).isNotNull(), render(F.col("__r"))).alias("rejected_text"),
        F.when(F.col(rejected).isNotNull(), loss_spans(F.col("__r"))).alias("rejected_loss"),
    )


def swapped_replies(turns: DataFrame) -> DataFrame:
    """(id, partner, chosen, rejected): a conversation against itself with its last assistant turn, and what follows
    it, replaced by the last assistant turn of its partner, the other conversation of id div 2."""
    convs = conversations(turns)
    said = F.filter("turns", lambda t: t["role"] == "assistant")
    last = F.when(F.size(said) > 0, F.element_at(said, -1))
    mine = F.size("turns") - F.array_position(F.reverse(F.transform("turns", lambda t: t["role"] == "assistant")), F.lit(True)).cast("int")
    rows = convs.select("id", "turns", last.alias("reply"), F.when(last.isNotNull(), mine).alias("cut"), F.expr("id - pmod(id, 2) + 1 - pmod(id, 2)").alias("want"))
    other = rows.select(F.col("id").alias("partner"), F.col("reply").alias("given"))
    met = rows.join(other, rows["want"] == other["partner"], "left")
    usable = F.col("cut").isNotNull() & F.col("given").isNotNull()
    swapped = F.when(usable, F.concat(F.slice("turns", F.lit(1), F.col("cut")), F.array("given")))
    return met.select("id", F.when(usable, F.col("partner")).alias("partner"), F.col("turns").alias("chosen"), swapped.alias("rejected"))


def preferences(turns: DataFrame) -> DataFrame:
    """One row per conversation: its preference pair, rendered, with sums over the loss spans."""
    rows = format_pairs(swapped_replies(turns))
    total = lambda c: F.aggregate(c, F.lit(0), lambda a, s: a + s["length"])
    return rows.select(
        F.col("id").alias("conv_id"),
        "partner",
        "shared_turns",
        "prompt",
        "chosen_text",
        "rejected_text",
        F.to_json("chosen_loss").alias("chosen_loss"),
        F.to_json("rejected_loss").alias("rejected_loss"),
        total("chosen_loss").alias("chosen_loss_chars"),
        total("rejected_loss").alias("rejected_loss_chars"),
    )
