"""Operator 8, chat formatting with cumulative-snapshot collapse (DataFrame operations only).

A logged conversation is often a snapshot of one that went on. Turns get rolling prefix hashes: running sums of two
position-salted 64-bit hashes of role and text (together 128 bits, summed as decimals so nothing overflows). A
conversation goes if its whole hash at its length is the prefix hash of a longer one; of equal conversations the
one with the least conv_id stays. Prefix hashes are made distinct before the anti-join, so an opening that a third
of all conversations share is one row. Rendering reads only what stays.

Turns are ordered by turn (null first), then role and text; repeated turn rows count as turns. Null role renders
as "unknown", null text as empty. Marks of the template inside a text are broken up so they can't end a turn.
Rows with null conv_id are left out. Columns besides the four are ignored. No rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The template's marks.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _turns(conversations: DataFrame) -> DataFrame:
    role, text = F.coalesce("role", F.lit("unknown")), F.coalesce("text", F.lit(""))
    rows = conversations.where("conv_id is not null").select("conv_id", "turn", role.alias("role"), text.alias("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return rows.withColumn("k", F.row_number().over(order))


def prefixes(conversations: DataFrame) -> DataFrame:
    """conv_id, k (turns so far), n (turns in all) and p, q (the rolling hashes) for each turn."""
    each = [F.xxhash64(F.lit(salt), "k", "role", "text").cast("decimal(38,0)") for salt in ("p", "q")]
    hashed = _turns(conversations).select("conv_id", "k", each[0].alias("p"), each[1].alias("q"))
    so_far = Window.partitionBy("conv_id").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    in_all = Window.partitionBy("conv_id")
    return hashed.select("conv_id", "k", F.count("*").over(in_all).alias("n"), F.sum("p").over(so_far).alias("p"), F.sum("q").over(so_far).alias("q"))


def maximal(conversations: DataFrame) -> DataFrame:
    """conv_id and copies (equal conversations, itself included) of the conversations that no longer one begins with."""
    rows = prefixes(conversations)
    whole = rows.where("k = n").groupBy("k", "p", "q").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies"))
    begun = rows.where("k < n").select("k", "p", "q").distinct()
    return whole.join(begun, ["k", "p", "q"], "left_anti").select("conv_id", "copies")


def turn_text(role: Column, text: Column) -> Column:
    safe = F.regexp_replace(text, r"<\|(im_start|im_end)\|>", "<| $1 |>")
    return F.concat(F.lit(OPEN), role, F.lit("\n"), safe, F.lit(CLOSE + "\n"))


def render(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, copies and rendered for each maximal conversation."""
    kept = maximal(conversations)
    turns = _turns(conversations.join(kept.select("conv_id"), "conv_id", "left_semi"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("k", turn_text(F.col("role"), F.col("text")).alias("line")))), lambda x: x["line"])
    whole = turns.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.array_join(lines, "").alias("rendered"))
    return whole.join(kept, "conv_id").select("conv_id", "n_turns", "copies", "rendered")
