"""Preference formatting: pairs of conversations become a prompt and two masked completions, in DataFrame functions alone.

The longest common prefix of turns (equal role and text) of the chosen and the rejected conversation is rendered once, as
the prompt; what follows in each is its completion. A completion's mask lists the spans of it that
are trained on, start:end in code points, comma-joined: the texts of the assistant's turns.

A null role or text counts as empty; of a repeated row one counts; turns with equal numbers stand in order of role,
then text. Rows without a conversation id are left out. A conversation is one row of the result, so its
turns come together; a prompt that very many conversations share is joined, never gathered. Input columns other
than those named are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqfold.llm.storage import kept

MARKS = 6  # characters that rendering adds to a turn's role and text: "<|", "|>" and two line ends


def threads(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turns): each conversation's turns (role, text, end) in order; end: where a turn's rendered form ends, counted over all
    turns up to it. Repeated rows fall together in a set before the one shuffle; what follows keeps its partitions."""
    rows = turns.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).alias("conv_id"), F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).alias("t"))
    each = rows.groupBy("conv_id").agg(F.array_sort(F.collect_set("t")).alias("t")).select("conv_id", F.posexplode("t").alias("nth", "t"))
    order = Window.partitionBy("conv_id").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    placed = each.select("conv_id", "nth", "t.role", "t.text").withColumn("end", F.sum(F.length("role") + F.length("text") + MARKS).over(order))
    whole = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("nth", "role", "text", "end"))).alias("t"))
    return whole.select("conv_id", F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"), t["end"].alias("end"))).alias("turns"))


def by_first_turn(conversations: DataFrame) -> DataFrame:
    """(chosen_id, rejected_id): in each group of conversations with the same first turn, the least id is chosen over
    each other one; a conversation with no other one has a null rejected_id."""
    first = conversations.select("conv_id", F.sha2(F.concat_ws("\u0001", F.get("turns", F.lit(0))["role"], F.get("turns", F.lit(0))["text"]), 256).alias("first"))
    least = kept(first.groupBy("first").agg(F.min("conv_id").alias("chosen_id"), F.count("*").alias("n")))  # written, so that the join below can split a very common turn
    both = first.join(least, "first")
    return both.where("n = 1 or conv_id <> chosen_id").select("chosen_id", F.when(F.col("n") > 1, F.col("conv_id")).alias("rejected_id"))


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _turn), "")


def _turn(t: Column) -> Column:
    return F.concat(F.lit("<|"), t["role"], F.lit("|>\n"), t["text"], F.lit("\n"))


def _mask(turns: Column, before: Column) -> Column:
    """Spans of the assistant's texts in the rendered turns, which begin behind before characters of their conversation."""
    spans = F.transform(F.filter(turns, lambda t: t["role"] == "assistant"), lambda t: F.concat((t["end"] - 1 - F.length(t["text"]) - before).cast("string"), F.lit(":"), (t["end"] - 1 - before).cast("string")))
    return F.array_join(spans, ",")


def format_pairs(conversations: DataFrame, pairs: DataFrame) -> DataFrame:
    """(chosen_id, rejected_id, prefix_turns, prompt, chosen, chosen_mask, rejected, rejected_mask) for each pair.

    Without a rejected conversation all turns but the last are the prompt, and rejected is empty; such pairs are taken apart before
    the join, so that their null keys do not meet in one task. Pairs and conversations are written once, so that the joins can split
    a conversation that is chosen over very many others."""
    conversations, pairs = kept(conversations), kept(pairs)
    chosen = conversations.select(F.col("conv_id").alias("chosen_id"), F.col("turns").alias("c"))
    rejected = conversations.select(F.col("conv_id").alias("rejected_id"), F.col("turns").alias("r"))
    two = pairs.where("rejected_id is not null").join(rejected, "rejected_id").join(chosen, "chosen_id")
    short = F.least(F.size("c"), F.size("r"))
    same = F.zip_with(F.slice("c", F.lit(1), short), F.slice("r", F.lit(1), short), lambda x, y: (x["role"] == y["role"]) & (x["text"] == y["text"]))
    miss = F.array_position(same, F.lit(False)).cast("int")
    alone = pairs.where("rejected_id is null").join(chosen, "chosen_id").withColumn("r", F.array().cast("array<struct<role:string,text:string,end:bigint>>"))
    columns = ["chosen_id", "rejected_id", "c", "r", "n"]
    both = two.withColumn("n", F.when(miss > 0, miss - 1).otherwise(short)).select(columns).unionByName(alone.withColumn("n", F.size("c") - 1).select(columns))
    begin = F.coalesce(F.get(F.col("c"), F.col("n") - 1)["end"], F.lit(0))  # the prefix is the same in both
    cut = both.select("chosen_id", "rejected_id", "n", begin.alias("begin"), F.slice("c", F.lit(1), F.col("n")).alias("p"), F.slice("c", F.col("n") + 1, F.size("c")).alias("c"), F.slice("r", F.col("n") + 1, F.size("r")).alias("r"))
    return cut.select("chosen_id", "rejected_id", F.col("n").cast("long").alias("prefix_turns"), _render(F.col("p")).alias("prompt"), _render(F.col("c")).alias("chosen"), _mask(F.col("c"), F.col("begin")).alias("chosen_mask"), _render(F.col("r")).alias("rejected"), _mask(F.col("r"), F.col("begin")).alias("rejected_mask"))
