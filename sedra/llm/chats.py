"""Chat formatting after collapse of cumulative snapshots.

A conversation logged again and again as it grows leaves records that are prefixes
of longer ones. Turn prefixes are hashed as rolling sums of position-keyed turn
hashes; conversations whose whole hash is a proper prefix hash of another are
anti-joined away, equal ones leave that of the least id, and the rest is rendered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

START, STOP = "<|im_start|>", "<|im_end|>"


def maximal_chats(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, n_turns, rendered for each conversation that no other one extends.

    Turns go by number, ties by role and text; null numbers come last. Turns with
    null id are one conversation. Null roles and texts are distinct from empty
    ones in hashes and render as empty. Two 64-bit sums stand for a prefix. Common
    first turns and equal conversations are summed partially before the joins; a
    single conversation is one output row, and so is gathered in one task.
    """
    key = F.when(F.col(conv_id).isNull(), F.lit("n")).otherwise(F.concat(F.lit("c"), F.col(conv_id).cast("string")))
    rows = turns.select(key.alias("key"), F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    ordered = Window.partitionBy("key").orderBy(F.col("turn").asc_nulls_last(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    rows = rows.withColumn("k", F.row_number().over(ordered))
    told = [F.xxhash64(F.lit(seed), "k", F.col("role").isNull(), F.col("role"), F.col("text").isNull(), F.col("text")).cast("decimal(20,0)") for seed in (1, 2)]
    by_turn = Window.partitionBy("key").orderBy("k")
    so_far = by_turn.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hashed = rows.select("key", "conv_id", "k", told[0].alias("a"), told[1].alias("b"))
    hashed = hashed.select("key", "conv_id", "k", F.sum("a").over(so_far).alias("a"), F.sum("b").over(so_far).alias("b"), F.lead("k").over(by_turn).isNull().alias("whole"))
    prefixes = hashed.where(~F.col("whole")).select("k", "a", "b").distinct()
    least = F.min(F.struct(F.col("conv_id").isNull().alias("no_id"), "conv_id", "key")).alias("first")
    whole = hashed.where("whole").groupBy("k", "a", "b").agg(least)
    kept = whole.join(prefixes, ["k", "a", "b"], "left_anti").select("first.key")
    line = F.concat(F.lit(START), F.coalesce(F.col("role"), F.lit("")), F.lit("\n"), F.coalesce(F.col("text"), F.lit("")), F.lit(STOP + "\n"))
    gathered = rows.join(kept, "key", "left_semi").groupBy("key", "conv_id").agg(F.sort_array(F.collect_list(F.struct("k", line.alias("line")))).alias("lines"))
    return gathered.select("conv_id", F.size("lines").cast("long").alias("n_turns"), F.array_join(F.transform("lines", lambda x: x["line"]), "").alias("rendered"))
