"""Planners: shards by lineage, blocks of reads, parts by budget."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .reference import dense_numbers, running


def even_shards(rows: DataFrame, order: list[str], shards: int) -> DataFrame:
    """``rows`` with shard 0 … min(rows, shards) − 1: contiguous in ``order`` (which must be unique together) and of even size."""
    total = rows.count()
    if total == 0:
        return rows.withColumn("shard", F.lit(None).cast("long"))
    used = min(total, shards)
    key = F.struct(*order)
    numbered = dense_numbers(rows.withColumn("__key", key), "__key", "__n").drop("__key")
    return numbered.withColumn("shard", F.expr(f"(__n * {used} - 1) div {total}").cast("long")).drop("__n")


def shard_members(rows: DataFrame, member: str) -> DataFrame:
    """shard and its members as a sorted list."""
    return rows.groupBy("shard").agg(F.array_sort(F.collect_list(member)).alias("members"))


def blocks(samples: DataFrame, sample: str, count: str, size: int) -> DataFrame:
    """sample, block, first, last: reads 1 … count of the samples in order, laid end to end and cut every ``size``; a sample may be split."""
    rows = samples.where(F.col(count) > 0).select(sample, F.col(count).cast("long").alias("n"))
    laid = running(rows, sample, F.col("n"), "upto").withColumn("before", F.col("upto") - F.col("n"))
    cut = laid.withColumn("block", F.explode(F.sequence(F.expr(f"before div {size}"), F.expr(f"(before + n - 1) div {size}"))))
    return cut.select(sample, "block", (F.greatest(F.col("block") * size, F.col("before")) - F.col("before") + 1).alias("first"), (F.least((F.col("block") + 1) * size, F.col("before") + F.col("n")) - F.col("before")).alias("last"))


def parts_by_budget(rows: DataFrame, key: str, cost: str, budget: int) -> DataFrame:
    """key, part (from 0): keys in order, each part closed before it would pass ``budget``; a dearer key is a part of its own.

    Greedy packing looks sequential, but where a part that begins at a key ends depends on that key
    alone: the next part begins at the key that covers the running cost ``budget`` further on. These
    jumps are found by a join on budget-wide cells and doubled, so the beginnings of all parts are
    reached in rounds that grow with the logarithm of their number; no task sees all keys.
    """
    summed = rows.groupBy(key).agg(F.coalesce(F.sum(cost), F.lit(0)).cast("long").alias("__c"))
    laid = dense_numbers(running(summed, key, F.col("__c"), "__end"), key, "__n")
    laid = written(laid.select(key, F.col("__n").alias("n"), (F.col("__end") - F.col("__c")).alias("begin"), F.col("__end").alias("end")), "laid")
    cover = laid.where("end > begin").select(F.col("n").alias("m"), F.col("begin").alias("b"), F.col("end").alias("e"))
    # keys that come before begin no later, so none asks beyond b + budget: a dear key is three cells at most
    cover = cover.withColumn("cell", F.explode(F.sequence(F.expr(f"b div {budget}"), F.expr(f"least(e - 1, b + {budget}) div {budget}"))))
    ask = laid.select("n", (F.col("begin") + budget).alias("at")).withColumn("cell", F.expr(f"at div {budget}"))
    jump = written(ask.join(cover, "cell").where("b <= at and at < e").select("n", F.greatest("m", F.col("n") + 1).alias("m")), "jumps")
    jump = jump.join(laid.select(F.col("n").alias("m")), "m", "left_semi").select("n", "m")  # a dear last key has no next one
    begins = laid.where("n = 1").select("n")
    while True:
        more = begins.join(jump, "n").select(F.col("m").alias("n")).join(begins, "n", "left_anti")
        grown = written(begins.unionByName(more), "begins")
        jump = written(jump.withColumnRenamed("m", "via").join(jump.select(F.col("n").alias("via"), "m"), "via").select("n", "m"), "jumps")
        begins = grown
        if jump.isEmpty():
            break
    marked = laid.join(begins.withColumn("__first", F.lit(1).cast("long")), "n", "left").select(key, F.coalesce("__first", F.lit(0)).alias("__first"))
    return running(marked, key, F.col("__first"), "part").select(key, (F.col("part") - 1).alias("part"))
