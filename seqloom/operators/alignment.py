"""Gates on alignments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.alignment import cigar_sum, query_coverage, sequence_identity


def gate_single(rows: DataFrame, identity: float, coverage: float) -> DataFrame:
    """Row-wise: both scores at least the thresholds."""
    return rows.where((sequence_identity(F.col("cigar")) >= identity) & (query_coverage(F.col("cigar")) >= coverage))


def gate_paired(rows: DataFrame, identity: float, coverage: float) -> DataFrame:
    """The two mates of a pair are scored together: operation sums over the pair, not its joined text, so their order doesn't matter."""
    pair = Window.partitionBy("sequence_idx", "feature_idx", F.least("position", "mate_position"), F.greatest("position", "mate_position"))
    total = lambda ops: F.sum(cigar_sum(F.col("cigar"), ops)).over(pair).cast("double")
    scored = rows.withColumn("__i", F.try_divide(total("="), total("=XID"))).withColumn("__c", F.try_divide(total("=XM"), total("=XMISH")))
    return scored.where((F.col("__i") >= identity) & (F.col("__c") >= coverage)).drop("__i", "__c")
