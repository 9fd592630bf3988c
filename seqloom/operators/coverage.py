"""Interval union over half-open [position, stop_position)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Positions are cut into bins so wide, so that a genome with most of the rows is many tasks.
BIN = 1 << 20


def _merged(rows: DataFrame, by: list[str]) -> DataFrame:
    """The union of the intervals of each group: one task per group."""
    clean = rows.groupBy(*by, "position").agg(F.max("stop_position").alias("stop_position"))  # of equal starts the longest; a bin has at most a row per position
    w = Window.partitionBy(*by).orderBy("position", "stop_position")
    opened = clean.withColumn("__top", F.max("stop_position").over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("__new", F.when(F.col("__top").isNull() | (F.col("position") > F.col("__top")), 1).otherwise(0))
    numbered = opened.withColumn("__i", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*by, "__i").agg(F.min("position").alias("position"), F.max("stop_position").alias("stop_position")).drop("__i")


def islands(rows: DataFrame, by: list[str], width: int = BIN) -> DataFrame:
    """The merged intervals: by, position, stop_position. Touching intervals merge; null ends are dropped.

    Bins are merged apart; after that only pieces that touch a border, at most two a bin, meet again.
    """
    pieces = _merged(binned(rows, width), [*by, "__bin"])
    border = (F.col("position") % width == 0) | (F.col("stop_position") % width == 0)
    zoned = pieces.withColumn("__zone", F.when(~border, F.col("__bin"))).drop("__bin")
    return _merged(zoned, [*by, "__zone"]).drop("__zone")


def binned(rows: DataFrame, width: int = BIN) -> DataFrame:
    """Each interval cut at the bins' borders; lengths add up over bins, so each bin is merged by itself."""
    clean = rows.where("position is not null and stop_position is not null and position < stop_position")
    first, last = F.floor(F.col("position") / width), F.floor((F.col("stop_position") - 1) / width)
    out = clean.withColumn("__bin", F.explode(F.sequence(first, last)))
    return out.withColumn("position", F.greatest("position", F.col("__bin") * width)).withColumn("stop_position", F.least("stop_position", (F.col("__bin") + 1) * width))


def covered(rows: DataFrame, by: list[str], width: int = BIN) -> DataFrame:
    """by, covered: positions in at least one interval."""
    merged = _merged(binned(rows, width), [*by, "__bin"])
    return merged.groupBy(*by).agg(F.sum(F.col("stop_position") - F.col("position")).alias("covered"))


def depth(rows: DataFrame, by: list[str], width: int = BIN) -> DataFrame:
    """by, position, stop_position, depth: runs between the places where an interval begins or ends, zero depth left out.

    Bins are counted apart; runs that a bin's border cut, at most two a bin, are joined after that.
    """
    cut = binned(rows.select(*by, "position", "stop_position", F.col("position").alias("__a"), F.col("stop_position").alias("__b")), width)
    begins = cut.select(*by, "__bin", F.col("position").alias("at"), F.lit(1).alias("d"), (F.col("position") == F.col("__a")).alias("real"))
    ends = cut.select(*by, "__bin", F.col("stop_position").alias("at"), F.lit(-1).alias("d"), (F.col("stop_position") == F.col("__b")).alias("real"))
    steps = begins.unionAll(ends).groupBy(*by, "__bin", "at").agg(F.sum("d").alias("d"), F.max("real").alias("real"))
    w = Window.partitionBy(*by, "__bin").orderBy("at")
    runs = steps.withColumn("depth", F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("stop", F.lead("at").over(w)).withColumn("shut", F.lead("real").over(w)).where("depth > 0")
    zoned = runs.withColumn("__zone", F.when(F.col("real") & F.col("shut"), F.col("__bin")))
    w = Window.partitionBy(*by, "__zone").orderBy("at")
    goes_on = (F.lag("stop").over(w) == F.col("at")) & ~F.lag("shut").over(w) & ~F.col("real")
    numbered = zoned.withColumn("__new", F.when(goes_on, 0).otherwise(1)).withColumn("__i", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = numbered.groupBy(*by, "__zone", "__i").agg(F.min("at").alias("position"), F.max("stop").alias("stop_position"), F.min("depth").alias("depth"))
    return out.select(*by, "position", "stop_position", "depth")
