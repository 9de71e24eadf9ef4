"""Chat formatting: cumulative-snapshot collapse and rendering, in DataFrame operations only.

A logged conversation that is a prefix of a longer one, or equal to another, adds nothing. Every turn gets
a digest with its place, and the exclusive-or of the digests up to a turn identifies the prefix that ends
there (two 64-bit hashes, kept up turn by turn by a running window). Conversations whose whole hash is
among the proper prefixes go by an anti-join of distinct hashes on both sides, so common first turns and
common conversations cost one row each; of equal conversations the one with the smallest conv_id stays.
What stays is rendered, markers inside texts being broken up.

Turns stand in the order of turn (nulls last), then role and text; rows that repeat in all four columns
count once. Null roles and texts are empty texts. Rows without a conv_id belong to no conversation and are
left out. An empty table gives no rows; other columns are ignored. A conversation is one row of output,
so its turns meet in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def prefixes(turns: DataFrame) -> DataFrame:
    """The turns in order: conv_id, place (from 1), role, text, p0 and p1 (the prefix up to here), is_last."""
    plain = turns.where(F.col("conv_id").isNotNull()).select("conv_id", "turn", *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    same = F.lag(F.struct("turn", "role", "text")).over(order).eqNullSafe(F.struct("turn", "role", "text"))
    placed = plain.withColumn("repeated", same).where(~F.col("repeated")).drop("repeated").withColumn("place", F.row_number().over(order))
    up_to = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    digests = {f"p{i}": F.bit_xor(F.xxhash64(F.lit(i), "place", "role", "text")).over(up_to) for i in range(2)}
    return placed.withColumns(digests | {"is_last": F.lead("place").over(order).isNull()})


def maximal(placed: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies) of the conversations that no other contains; p0 and p1 identify them."""
    whole = placed.where("is_last").groupBy("p0", "p1").agg(F.min("conv_id").alias("conv_id"), F.max("place").cast("long").alias("n_turns"), F.count("*").alias("n_copies"))
    proper = placed.where(~F.col("is_last")).select("p0", "p1").distinct()
    return whole.join(proper, ["p0", "p1"], "left_anti")


def formatted(turns: DataFrame, start: str = "<|im_start|>", end: str = "<|im_end|>") -> DataFrame:
    """One row a maximal conversation: conv_id, n_turns, n_copies, text as a chat transcript."""
    placed = prefixes(turns)
    kept = maximal(placed).select("conv_id", "n_turns", "n_copies")
    inner = F.replace(F.col("text"), F.lit("<|"), F.lit("< |"))
    line = F.concat(F.lit(start), F.replace(F.col("role"), F.lit("<|"), F.lit("< |")), F.lit("\n"), inner, F.lit(f"{end}\n"))
    lines = placed.select("conv_id", "place", line.alias("line")).join(kept, "conv_id")
    told = lines.groupBy("conv_id", "n_turns", "n_copies").agg(F.array_sort(F.collect_list(F.struct("place", "line"))).alias("lines"))
    return told.select("conv_id", "n_turns", "n_copies", F.concat_ws("", F.transform("lines", lambda x: x["line"])).alias("text"))
