"""Preference formatting of conversations, in DataFrame functions only.

Two conversations, chosen and rejected, share a longest common prefix of turns (same role and text). That prefix is
rendered once as the prompt; what follows in either is its completion, with a mask of the character ranges of the
assistant's turns, the only ones to train on.

Places come from running sums over a conversation's turns, so a mask costs in proportion to its turns. Defined cases: null
role or text counts as empty; turns that repeat a (conversation, turn) are ordered by role and text; rows without a turn
number come before the others, and rows without a conversation are left out; a conversation without a partner keeps its turns as
completion, beside an empty one; identical conversations have the whole conversation as prompt and empty completions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The turn format.
BEGIN, MIDDLE, END = "<|im_start|>", "\n", "<|im_end|>\n"


def turns(conversations: DataFrame, by: str = "conv_id") -> DataFrame:
    """(by, turns array<struct<role, text, at>>) with turns in order, each with its place in the rendered conversation."""
    said = conversations.select(by, "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    before = Window.partitionBy(by).orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    placed = said.withColumn("at", F.coalesce(F.sum(size(F.col("role"), F.col("text"))).over(before), F.lit(0)).cast("long"))
    ordered = F.array_sort(F.collect_list(F.struct("turn", "at", "role", "text")))
    return placed.groupBy(by).agg(ordered.alias("turns")).select(by, F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"), t["at"].alias("at"))).alias("turns"))


def size(role: Column, text: Column) -> Column:
    """Characters of a rendered turn."""
    return F.length(role) + F.length(text) + len(BEGIN) + len(MIDDLE) + len(END)


def _rendered(turn: Column) -> Column:
    return F.concat(F.lit(BEGIN), turn["role"], F.lit(MIDDLE), turn["text"], F.lit(END))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _rendered), "")


def mask(turns: Column) -> Column:
    """[start, end) character ranges in render(turns) that the assistant speaks, its closing mark included."""
    base = F.coalesce(F.get(turns, F.lit(0))["at"], F.lit(0).cast("long"))
    head = lambda t: F.length(t["role"]) + len(BEGIN) + len(MIDDLE)
    own = F.filter(turns, lambda t: t["role"] == "assistant")
    return F.transform(own, lambda t: F.struct((t["at"] - base + head(t)).cast("long").alias("start"), (t["at"] - base + size(t["role"], t["text"])).cast("long").alias("end")))


def preferences(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """pairs with arrays of turns, as turns() makes them -> the other columns, prompt_turns, prompt and both completions with their masks."""
    a, b = F.col(chosen), F.col(rejected)
    both = F.arrays_zip(a.alias("a"), b.alias("b"))
    differs = F.transform(both, lambda z: F.coalesce(z["a"] != z["b"], F.lit(True)))
    shared = F.array_position(differs, True)
    n = F.when(shared > 0, shared - 1).otherwise(F.size(differs)).cast("int")
    rest = lambda c: F.slice(c, F.col("prompt_turns") + 1, F.greatest(F.size(c), F.lit(1)))
    found = pairs.withColumn("prompt_turns", n)
    others = [c for c in pairs.columns if c not in (chosen, rejected)]
    return found.select(
        *others,
        "prompt_turns",
        render(F.slice(a, F.lit(1), F.col("prompt_turns"))).alias("prompt"),
        render(rest(a)).alias("chosen_completion"),
        mask(rest(a)).alias("chosen_mask"),
        render(rest(b)).alias("rejected_completion"),
        mask(rest(b)).alias("rejected_mask"),
    )


def neighbours(conversations: DataFrame) -> DataFrame:
    """(pair_id, chosen, rejected): conversations 2k and 2k + 1 as a pair, an empty one for a missing partner."""
    all_turns = turns(conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text").where("conv_id is not null"))
    side = lambda k: F.first(F.when(F.pmod("conv_id", F.lit(2)) == k, F.col("turns")), ignorenulls=True)
    empty = F.array().cast("array<struct<role:string,text:string,at:bigint>>")
    pair = F.floor(F.col("conv_id") / 2).cast("long")
    return all_turns.groupBy(pair.alias("pair_id")).agg(F.coalesce(side(0), empty).alias("chosen"), F.coalesce(side(1), empty).alias("rejected"))
