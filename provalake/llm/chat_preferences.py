"""Preference formatting of chat pairs, with DataFrame functions only.

The longest common turn prefix of the chosen and the rejected conversation is rendered once, as the prompt. What follows in
either is its completion, with a mask that says which characters to learn from: what assistants say, and the end sign.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END = "<|end|>\n"
LEARNT_ROLE = "assistant"


def turns_by_conversation(conversations: DataFrame) -> DataFrame:
    """conv_id and `turns`, an array of (role, text) in turn order.

    Repeated rows count once; turns with one number are ordered by role and text; null roles and texts are empty; rows without
    a conv_id belong to no conversation. A conversation is one row, as a text is in a table of documents.
    """
    said = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = conversations.where(F.col("conv_id").isNotNull()).groupBy("conv_id").agg(F.sort_array(F.collect_set(said)).alias("said"))
    return grouped.select(F.col("conv_id").cast("long").alias("conv_id"), F.transform("said", lambda t: F.struct(t["role"], t["text"])).alias("turns"))


def _header(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_header(t), t["text"], F.lit(END))), "")


def mask(turns: Column) -> Column:
    """Runs of characters of the rendered turns as `learn:length`, joined by blanks: a header isn't learnt, what follows is if
    an assistant says it."""
    learnt = lambda t: F.when(t["role"] == LEARNT_ROLE, "1").otherwise("0")
    runs = F.transform(turns, lambda t: F.concat(F.lit("0:"), F.length(_header(t)).cast("string"), F.lit(" "), learnt(t), F.lit(":"),
                                                 (F.length(t["text"]) + len(END)).cast("string")))
    return F.array_join(runs, " ")


def learnt_characters(turns: Column) -> Column:
    sizes = F.transform(turns, lambda t: F.when(t["role"] == LEARNT_ROLE, F.length(t["text"]) + len(END)).otherwise(0))
    return F.aggregate(sizes, F.lit(0), lambda a, b: a + b).cast("long")


def format_pairs(pairs: DataFrame) -> DataFrame:
    """`pairs` (pair_id, chosen, rejected: arrays of (role, text)) as prompt, paired completions and masks.

    Equal conversations give two empty completions; conversations that differ from the first turn on an empty prompt; a null
    conversation counts as one without turns.
    """
    none = F.array().cast("array<struct<role:string,text:string>>")
    rows = pairs.select("pair_id", F.coalesce("chosen", none).alias("c"), F.coalesce("rejected", none).alias("r"))
    differs = F.array_position(F.zip_with("c", "r", lambda a, b: a.eqNullSafe(b)), False)
    rows = rows.withColumn("common", F.when(differs == 0, F.size("c")).otherwise(differs - 1).cast("int"))
    rest = lambda turns: F.slice(turns, F.col("common") + 1, F.size(turns))
    rows = rows.select("pair_id", "common", F.slice("c", 1, F.col("common")).alias("p"), rest("c").alias("c"), rest("r").alias("r"))
    return rows.select("pair_id", F.col("common").cast("long").alias("prompt_turns"), render(F.col("p")).alias("prompt"),
                       render(F.col("c")).alias("chosen"), render(F.col("r")).alias("rejected"), mask(F.col("c")).alias("chosen_mask"),
                       mask(F.col("r")).alias("rejected_mask"), learnt_characters(F.col("c")).alias("chosen_learnt"),
                       learnt_characters(F.col("r")).alias("rejected_learnt"))


def replaced_answers(conversations: DataFrame) -> DataFrame:
    """Preference pairs out of plain conversations: rejected is the conversation up to its last assistant turn, which is
    replaced by the last assistant turn of its neighbour (conv_id 2k and 2k+1 are neighbours).

    A conversation forms no pair if it, or its neighbour, is missing or has no assistant turn.
    """
    back = F.array_position(F.reverse(F.transform("turns", lambda t: t["role"] == LEARNT_ROLE)), True)
    rows = turns_by_conversation(conversations).withColumn("last", (F.size("turns") - back + 1).cast("int")).where(back > 0)
    answers = rows.select(F.col("conv_id").bitwiseXOR(F.lit(1)).alias("conv_id"), F.element_at("turns", F.col("last")).alias("answer"))
    paired = rows.join(answers, "conv_id")
    return paired.select(F.col("conv_id").alias("pair_id"), F.col("turns").alias("chosen"),
                         F.concat(F.slice("turns", 1, F.col("last") - 1), F.array("answer")).alias("rejected"))
