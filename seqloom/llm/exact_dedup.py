"""Exact dedup by two-pass Bloom filtering.

Pass 1 hashes each text to a signature (a 64-bit word of the filter and four bits in it), counts
signatures with map-side combining and sets the bits of those met at least twice. The filter is
broadcast; its size is bounded by common.MAX_WORDS, whatever the input, and past that only the share of
false positives grows. Pass 2 tests each row against it: rows whose bits aren't all set can't have
an equal, so they pass straight through; the others shuffle on SHA-256 and are judged exactly.

Defined cases: null text counts as empty; null doc_id sorts below all others; rows that share
doc_id and text are copies of each other and one of them stays; an empty table gives no rows;
other columns, whatever their names, are left alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bloom_of, bloom_words, in_bloom, keep, salted, text_of


def repeats(df: DataFrame) -> tuple[DataFrame, int]:
    """Pass 1: the filter of the texts (column txt) met at least twice, and its words."""
    words = bloom_words(df.count())
    return bloom_of(df.select("txt"), F.xxhash64("txt"), words, least=2), words


def mark(df: DataFrame, bloom: DataFrame, words: int) -> DataFrame:
    """Pass 2: ``df`` with a column maybe, false only where no other row has an equal txt."""
    return in_bloom(df, F.xxhash64("txt"), bloom, words)


def label(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row of ``docs``."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("txt"))
    rows = mark(narrow, *repeats(narrow)).withColumn("text_sha256", F.sha2(F.col("txt").cast("binary"), 256)).drop("txt")
    alone = rows.where("not maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    ids = rows.where("maybe").groupBy("text_sha256", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    groups = ids.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.sum("n").alias("group_size"))
    copies = salted(ids, groups, ["text_sha256"], "inner", F.col("doc_id")).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)
    return alone.unionByName(copies.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256"))


def dedup(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns: of equal texts the one with the largest doc_id."""
    packed = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), text_of().alias("txt"))
    bloom = repeats(packed)
    rows = mark(packed, *bloom)
    alone = rows.where("not maybe").select("row.*")
    some = rows.where("maybe").select("row", "id", F.sha2(F.col("txt").cast("binary"), 256).alias("sha"))
    ids = mark(packed.select("id", "txt"), *bloom).where("maybe").select("id", F.sha2(F.col("txt").cast("binary"), 256).alias("sha"))
    best = keep(ids.groupBy("sha", "id").agg(F.count(F.lit(1)).alias("n")).groupBy("sha").agg(F.max("id").alias("best"), F.coalesce(F.max_by("n", "id"), F.max("n")).alias("n")), "best")
    won = some.join(best.withColumnRenamed("sha", "s"), (F.col("sha") == F.col("s")) & F.col("id").eqNullSafe(F.col("best")))
    out = alone.unionByName(won.where("n = 1").select("row.*"))
    if best.where("n > 1").limit(1).count():  # rows that share text and doc_id: the least of them as JSON stays
        tied = won.where("n > 1").groupBy("sha").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row.*")
        out = out.unionByName(tied)
    return out
