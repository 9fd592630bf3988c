"""Chat formatting with cumulative-snapshot collapse.

Logged conversations often repeat an earlier snapshot and add turns. A rolling hash over the turns
gives each prefix a digest; a conversation whose whole digest is a proper prefix of another is
dropped by anti-join, equal conversations keep the least conv_id, and only the rest is rendered.

Defined cases: turns go by turn number, then role, then text, null first, so ties and repeated rows
are all rendered, in that order; null role and text count as empty; rows with a null conv_id form one
conversation; an empty table gives no rows; other columns, whatever their names, are ignored. A
conversation is rendered as one text, so very long texts and very many turns need the memory of one
row that holds them all (2 GB is Spark's bound on it).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep, let

START, END = "<|im_start|>", "<|im_end|>"


def assembled(turns: DataFrame) -> DataFrame:
    """(conv_id, turns, prefixes): the turns in order and the rolling digest after each."""
    turn = F.struct(F.col("turn").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    convs = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))  # rendered as one text each, so gathered by conversation

    return convs.withColumn("prefixes", rolling(F.col("turns")))


def rolling(turns: Column) -> Column:
    """The digest after each turn, each made of the one before and the turn.

    An array grows by being copied, so turns are taken in runs of about the root of their number: each
    run's digests grow by themselves and are put together at the end.
    """
    def step(acc: Column, t: Column) -> Column:
        return F.concat(acc, F.array(F.md5(F.concat_ws("|", F.element_at(acc, -1), F.length(t["role"]).cast("string"), t["role"], t["text"]))))

    def run(acc: Column, part: Column) -> Column:
        # begins with the last digest of the run before, which is the last of that run already
        grown = F.aggregate(part, F.array(F.element_at(F.element_at(acc, -1), -1)), step)
        return let(grown, lambda g: F.concat(acc, F.array(F.slice(g, F.lit(2), F.size(g) - 1))))

    size = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(turns))).cast("int"))
    parts = F.transform(F.sequence(F.lit(1), F.greatest(F.size(turns), F.lit(1)), size), lambda i: F.slice(turns, i, size))
    seed = F.array(F.array(F.lit(""))).cast("array<array<string>>")
    return let(F.flatten(F.aggregate(parts, seed, run)), lambda every: F.slice(every, F.lit(2), F.size(every) - 1))


def maximal(convs: DataFrame) -> DataFrame:
    """(conv_id, n_copies, digest): of assembled conversations those that no longer one continues, one of equals."""
    whole = convs.select("conv_id", F.element_at("prefixes", -1).alias("digest")).groupBy("digest").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_copies"))
    proper = convs.select(F.explode(F.slice("prefixes", F.lit(1), F.size("prefixes") - 1)).alias("digest")).distinct()
    return whole.join(proper, "digest", "left_anti")


def rendered() -> Column:
    """The turns between markers, one line for the role and one mark at the end of each text."""
    return F.array_join(F.transform("turns", lambda t: F.concat(F.lit(START), t["role"], F.lit("\n"), t["text"], F.lit(END + "\n"))), "")


def format_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies, digest, rendered) of each maximal conversation."""
    convs = keep(assembled(turns), "chats")  # gathered once; the digests are then read without the texts
    best = maximal(convs).withColumnRenamed("conv_id", "id")
    return convs.select("conv_id", "turns").join(best, F.col("conv_id").eqNullSafe(F.col("id"))).select("conv_id", F.size("turns").cast("long").alias("n_turns"), "n_copies", "digest", rendered().alias("rendered"))
