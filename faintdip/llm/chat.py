"""Chat formatting of logged conversations, in DataFrame functions only.

Loggers that store a conversation after every turn leave snapshots that are prefixes of
longer ones. Hashes of every turn prefix find them; an anti-join keeps the maximal
conversations, which are then rendered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

START, END = "<|im_start|>", "<|im_end|>"


def turn_prefixes(turns: DataFrame) -> DataFrame:
    """turns with rank (1, 2, ...) and a, b: hashes of the conversation up to that turn.

    A prefix hash is the exclusive or of its turns' hashes, each taken with its rank; two
    hashes of 64 bits make a chance match out of reach.
    """
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    ranked = turns.withColumn("rank", F.row_number().over(order))
    upto = W.partitionBy("conv_id").orderBy("rank").rowsBetween(W.unboundedPreceding, 0)
    body = F.to_json(F.struct("role", "text"))  # tells null from empty
    return ranked.withColumn("a", F.bit_xor(F.xxhash64(F.lit("a"), "rank", body)).over(upto)).withColumn("b", F.bit_xor(F.xxhash64(body, F.lit("b"), "rank")).over(upto))


def maximal(prefixes: DataFrame) -> DataFrame:
    """(conv_id, turns): conversations that are no proper prefix of another, one of each set of equals."""
    last = prefixes.groupBy("conv_id").agg(F.max_by(F.struct(F.col("rank").alias("turns"), "a", "b"), "rank").alias("x"))
    whole = last.select("x.*", "conv_id").groupBy("turns", "a", "b").agg(F.min("conv_id").alias("conv_id"))  # the copies meet before any join
    size = last.select("conv_id", F.col("x.turns").alias("turns"))
    proper = prefixes.join(size, "conv_id").filter(F.col("rank") < F.col("turns")).select(F.col("rank").alias("turns"), "a", "b").distinct()
    return whole.join(proper, ["turns", "a", "b"], "left_anti").select("conv_id", "turns")


def chat_format(turns: DataFrame) -> DataFrame:
    """One row for each maximal conversation of (conv_id, turn, role, text): conv_id, n_turns, chat.

    Turns are taken in the order of turn, then role and text; rows that repeat a turn of the same
    conversation exactly count once. Of equal conversations the smallest conv_id stays.
    Rows with a null conv_id belong to no conversation and are left out; a null turn comes
    first; a null role is "unknown", a null text empty in the rendering, though both differ from
    the literal values when conversations are compared. Other columns are ignored.
    """
    turns = turns.select("conv_id", "turn", "role", "text").filter(F.col("conv_id").isNotNull()).distinct()
    prefixes = turn_prefixes(turns)
    line = F.concat(F.lit(START), F.coalesce("role", F.lit("unknown")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit(END), F.lit("\n"))
    kept = prefixes.join(maximal(prefixes.select("conv_id", "rank", "a", "b")), "conv_id", "left_semi").select("conv_id", "rank", line.alias("line"))
    out = kept.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.array_sort(F.collect_list(F.struct("rank", "line"))).alias("lines"))
    return out.select("conv_id", "n_turns", F.array_join("lines.line", "").alias("chat"))
