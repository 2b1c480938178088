"""Preference pairs for training: a shared prompt and two masked completions. DataFrame functions only.

`format_pairs` takes pairs of conversations, each an array of turns. The longest common prefix of turns is rendered once as the
prompt; what follows it in either conversation is its completion, a row of segments of which only the assistant's words are trained on.

Two ways make such pairs from a table of turns; copies of a conversation count once in both.

* `pair_up`: conversations that begin with the same turn answer the same request. They are paired in order of conv_id, in groups that cannot
  grow: within blocks of 1,024 ids first, then the one left over in each block with those of the 1,024 blocks around it, and so on. A first
  turn that a third of all conversations share is thus spread over as many groups as it has blocks. Of a pair the one with more assistant
  text is the chosen one.
* `borrow_answers`: every conversation against itself with its last assistant turn borrowed from the next conversation by conv_id that has
  one: an answer to another request, a negative that needs no judgement.

Defined results: turns are ordered by number, then role, then text, nulls first; repeated turns count once; rows without conv_id belong to no
conversation; a null role or text is rendered empty; a conversation without partner, or without an assistant turn, gives no row; equal lengths choose
the smaller conv_id. Other columns are not read. An empty prompt, and an empty completion where one conversation begins the other, are possible and kept.
"""

from __future__ import annotations

from math import ceil, log

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle
from .order import with_next

BLOCK_BITS = 10
BEGIN, END = "<|im_start|>", "<|im_end|>"


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, turns) with an array of (turn, role, text) in order; a conversation is one row, as it is one record."""
    rows = turns.filter("conv_id IS NOT NULL").select("conv_id", F.struct("turn", "role", "text").alias("t"))
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_set("t")).alias("turns"))


def distinct_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, turns) with copies united under their smallest conv_id."""
    return settle(conversations(turns).groupBy("turns").agg(F.min(F.col("conv_id").cast("bigint")).alias("conv_id")), "conversations")


def borrow_answers(whole: DataFrame) -> DataFrame:
    """(chosen_id, chosen, rejected_id, rejected) from distinct conversations: each with its own last answer and with that of the next."""
    last = F.element_at(F.filter(F.transform("turns", lambda t, i: F.when(t["role"] == "assistant", i)), lambda i: i.isNotNull()), -1)
    answered = whole.withColumn("at", F.when(F.exists("turns", lambda t: t["role"].eqNullSafe("assistant")), last)).filter("at IS NOT NULL")
    lent = with_next(answered.withColumn("text", F.get("turns", F.col("at"))["text"]), "conv_id", {"conv_id": "next_id", "text": "next_text"})
    changed = F.transform("turns", lambda t, i: F.when(i == F.col("at"), t.withField("text", F.col("next_text"))).otherwise(t))
    return lent.select(F.col("conv_id").alias("chosen_id"), F.col("turns").alias("chosen"), F.col("next_id").alias("rejected_id"), changed.alias("rejected"))


def pair_up(whole: DataFrame) -> DataFrame:
    """(chosen_id, chosen, rejected_id, rejected) from distinct conversations: pairs with the same first turn."""
    opening = F.get("turns", F.lit(0))
    left = whole.select("conv_id", F.struct(opening["role"].alias("role"), opening["text"].alias("text")).alias("request"))
    most = whole.agg(F.max(F.abs("conv_id"))).first()[0] or 1
    pairs = None
    for level in range(max(1, ceil(log(most + 1, 2) / BLOCK_BITS)) + 1):
        block = F.shiftright("conv_id", BLOCK_BITS * (level + 1))
        group = Window.partitionBy("request", block).orderBy("conv_id")
        ranked = settle(left.withColumn("n", F.row_number().over(group)).withColumn("partner", F.lead("conv_id").over(group)), "ranked")
        made = ranked.filter("n % 2 = 1 AND partner IS NOT NULL").select(F.col("conv_id").alias("a"), F.col("partner").alias("b"))
        pairs = made if pairs is None else pairs.union(made)
        left = ranked.filter("n % 2 = 1 AND partner IS NULL").select("conv_id", "request")
    said = F.aggregate("turns", F.lit(0).cast("bigint"), lambda s, t: s + F.when(t["role"] == "assistant", F.coalesce(F.char_length(t["text"]), F.lit(0))).otherwise(0))
    one = whole.select(F.col("conv_id").alias("a"), F.col("turns").alias("a_turns"), said.alias("a_said"))
    two = whole.select(F.col("conv_id").alias("b"), F.col("turns").alias("b_turns"), said.alias("b_said"))
    both = pairs.join(one, "a").join(two, "b")
    first = F.col("a_said") >= F.col("b_said")  # a has the smaller conv_id
    return both.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("chosen_id"), F.when(first, F.col("a_turns")).otherwise(F.col("b_turns")).alias("chosen"),
                       F.when(first, F.col("b")).otherwise(F.col("a")).alias("rejected_id"), F.when(first, F.col("b_turns")).otherwise(F.col("a_turns")).alias("rejected"))


def _head(turn):
    return F.concat(F.lit(BEGIN), F.coalesce(turn["role"], F.lit("")), F.lit("\n"))


def _body(turn):
    return F.concat(F.coalesce(turn["text"], F.lit("")), F.lit(END))


def _render(turns):
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _body(t), F.lit("\n"))), "")


def _segments(turns):
    """(text, trained) pieces of a completion: an assistant's words and their end are trained on, the frame and other roles are not."""
    return F.flatten(F.transform(turns, lambda t: F.array(
        F.struct(_head(t).alias("text"), F.lit(False).alias("trained")),
        F.struct(_body(t).alias("text"), F.coalesce(t["role"] == "assistant", F.lit(False)).alias("trained")),
        F.struct(F.lit("\n").alias("text"), F.lit(False).alias("trained")))))


def format_pairs(pairs: DataFrame) -> DataFrame:
    """Per pair: chosen_id, rejected_id, n_common turns, prompt, and chosen and rejected as arrays of (text, trained)."""
    same = F.zip_with("chosen", "rejected", lambda x, y: x["role"].eqNullSafe(y["role"]) & x["text"].eqNullSafe(y["text"]))
    at = F.array_position(same, F.lit(False))
    shorter = F.least(F.size("chosen"), F.size("rejected"))
    common = F.when(at == 0, shorter).otherwise(F.least(at - 1, shorter)).cast("int")
    rest = {c: F.slice(c, F.col("n_common") + 1, F.size(c)) for c in ("chosen", "rejected")}
    return pairs.withColumn("n_common", common).select(
        "chosen_id", "rejected_id", "n_common", _render(F.slice("chosen", F.lit(1), F.col("n_common"))).alias("prompt"),
        *[_segments(r).alias(c) for c, r in rest.items()])
