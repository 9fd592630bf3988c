"""What several operators share: reading, the shared folder, salted joins, connected components."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import bound_batches, shared_dir, ship  # noqa: F401 - the operators take them from here

#: Code points that part words: blank and 0x09 to 0x0D.
BLANKS = " \t\n\x0b\x0c\r"
BLANKS_RE = "[ \\t\\n\\x0B\\f\\r]+"
#: Copies of the smaller side in a salted join; a hot key is dealt to so many tasks.
SALTS = 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows in a file of a small table.
FILE_ROWS = 250_000


def keep(df: DataFrame, what: str = "t", most: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again: cuts lineage and outlives executors.

    ``most``: how many rows it has at most, if that is known; a small table is then few files.
    """
    spark = df.sparkSession
    if most is not None:
        df = df.coalesce(max(8, most // FILE_ROWS))
    at = f"{shared_dir(spark)}/seqloom-{what}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    out = spark.read.schema(df.schema).parquet(at)
    out._seqloom_path = at
    return out


def drop_kept(df: DataFrame) -> None:
    """Delete what ``keep`` wrote; only for tables that nothing will read again."""
    spark, at = df.sparkSession, getattr(df, "_seqloom_path", None)
    if at:
        path = spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def let(value: Column, body) -> Column:
    """``body(v)`` with ``v`` bound to ``value`` once; lambdas that use ``v`` don't evaluate it again for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """The runs of other code points than BLANKS, in order."""
    bare = F.btrim(text, F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, BLANKS_RE))


def salted(big: DataFrame, small: DataFrame, on: list[str], how: str = "left", salt_from: Column | None = None, salts: int = SALTS) -> DataFrame:
    """Join ``big`` to ``small`` (one row per key) with each key dealt to ``salts`` tasks.

    ``salt_from``: what deals the rows of a key out; a column that differs among them.
    """
    salt = F.pmod(F.xxhash64(salt_from) if salt_from is not None else F.xxhash64(*[F.col(c) for c in big.columns if c not in on]), F.lit(salts))
    left = big.withColumn("__salt", salt.cast("int"))
    right = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*on, "__salt"], how).drop("__salt")


#: Bloom filter: bits for each row, and the bound on 64-bit words that are broadcast (a row of two longs each).
BITS_PER_ROW = 16
MAX_WORDS = 1 << 20


def bloom_words(rows: int) -> int:
    return min(MAX_WORDS, 1 << max(10, (rows * BITS_PER_ROW // 64).bit_length()))


def signed(df: DataFrame, hashed: Column, words: int) -> DataFrame:
    """Adds word and mask: 40 bits of the hash choose a word of the filter, four times six others the bits in it."""
    bit = lambda k: F.expr(f"shiftleft(1L, cast(shiftrightunsigned(__h, {k}) & 63 as int))")
    return df.withColumn("__h", hashed).withColumn("word", F.expr(f"shiftrightunsigned(__h, 24) % {words}L")).withColumn("mask", bit(0).bitwiseOR(bit(6)).bitwiseOR(bit(12)).bitwiseOR(bit(18))).drop("__h")


def bloom_of(df: DataFrame, hashed: Column, words: int, least: int = 1) -> DataFrame:
    """(word, bits) of the hashes met at least ``least`` times: at most MAX_WORDS rows."""
    seen = signed(df, hashed, words).groupBy("word", "mask").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return keep(seen.groupBy("word").agg(F.expr("bit_or(mask)").alias("bits")), "bloom", words)


def in_bloom(df: DataFrame, hashed: Column, bloom: DataFrame, words: int) -> DataFrame:
    """``df`` with a column maybe, false only where the hash isn't in the filter; no shuffle."""
    hit = F.coalesce(F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask"), F.lit(False))
    return signed(df, hashed, words).join(F.broadcast(bloom), "word", "left").withColumn("maybe", hit).drop("word", "mask", "bits")


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, comp) for the ends of ``edges`` (a, b): comp is the least node that can be reached.

    Minimum labels spread over the edges and jump along the labels' own labels, so the rounds
    grow with the logarithm of the longest chain. Each round is written to the shared folder;
    minima are combined before each shuffle and a node with many edges is dealt out by salt.
    """
    both = keep(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    most = both.count()  # from the files' footers; no more nodes than that
    labels = keep(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("comp")), "labels", most)
    for _ in range(rounds):
        near = salted(both.withColumnRenamed("b", "node"), labels, ["node"], "inner", F.col("a")).groupBy("a").agg(F.min("comp").alias("low"))
        # the least label among the neighbours, handed to the node itself and to its present label
        told = near.join(labels.withColumnRenamed("node", "a"), "a").select("a", "comp", F.least("low", "comp").alias("low"))
        hooked = told.select(F.col("a").alias("node"), "low").union(told.select(F.col("comp").alias("node"), "low")).groupBy("node").agg(F.min("low").alias("low"))
        jump = salted(hooked.withColumnRenamed("node", "own").withColumnRenamed("low", "node"), hooked.withColumnRenamed("low", "far"), ["node"], "left", F.col("own"))
        fresh = keep(jump.select(F.col("own").alias("node"), F.least("node", F.coalesce("far", "node")).alias("comp")), "labels", most)
        changed = fresh.join(labels.withColumnRenamed("comp", "old"), "node").where("comp <> old").limit(1).count()
        drop_kept(labels)
        labels = fresh
        if not changed:
            break
    else:
        raise RuntimeError("components: no end within the rounds")
    drop_kept(both)
    return labels
