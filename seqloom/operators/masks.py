"""Read masks: trimmed views, metrics, reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import trimmed, trimmed_array

KEYS = ["prep_sample_idx", "sequence_idx"]
#: Reasons by bucket: fixed values. A reason in neither list counts as raw only.
BIOLOGICAL, SPIKEIN = ("host_minimap2", "host_rype", "pass"), ("spikein_syndna",)


def masked(reads: DataFrame, mask: DataFrame) -> DataFrame:
    """Reads that pass, trimmed; a mate that is null stays null."""
    m = mask.where("reason = 'pass'")
    joined = reads.join(m, KEYS)
    one, two = (F.col("left_trim1"), F.col("right_trim1")), (F.col("left_trim2"), F.col("right_trim2"))
    return joined.select("mask_idx", *KEYS, "read_id", trimmed(F.col("sequence1"), *one).alias("sequence1"), trimmed_array(F.col("qual1"), *one).alias("qual1"), trimmed(F.col("sequence2"), *two).alias("sequence2"), trimmed_array(F.col("qual2"), *two).alias("qual2"))


def metrics(mask: DataFrame, by: list[str] = ()) -> DataFrame:
    """Mates by bucket: each row counts once, and once more if it has a second mate."""
    both = lambda p: (F.count_if(p) + F.count(F.when(p, F.col("right_trim2")))).cast("long")
    ok = F.col("reason") == "pass"
    return mask.groupBy(*by).agg(
        both(F.lit(True)).alias("raw"), both(F.col("reason").isin(*BIOLOGICAL)).alias("biological"), both(ok).alias("quality_filtered"),
        both(F.col("reason").isin(*SPIKEIN)).alias("spikein"), F.count(F.lit(1)).alias("row_count"))


def pass_count(mask: DataFrame, mask_idx: int, prep_sample_idx: int) -> DataFrame:
    """One row, n: the rows of a sample that pass one mask; both bounds reach the scan."""
    return mask.where((F.col("mask_idx") == mask_idx) & (F.col("prep_sample_idx") == prep_sample_idx) & (F.col("reason") == "pass")).agg(F.count(F.lit(1)).alias("n"))


def with_precedence(reads: DataFrame, ordered: list[tuple[DataFrame, str]], key: str, reason: str = "reason") -> DataFrame:
    """The reason of the first hit set that has the key, else the row's own; hits are made distinct first, so rows don't multiply."""
    out, chosen = reads, None
    for i, (hits, name) in enumerate(ordered):
        out = out.join(hits.select(F.col(key).alias(f"__k{i}")).distinct(), F.col(key) == F.col(f"__k{i}"), "left")
        term = F.col(f"__k{i}").isNotNull()
        chosen = F.when(term, name) if chosen is None else chosen.when(term, name)
    return out.withColumn(reason, chosen.otherwise(F.col(reason)) if chosen is not None else F.col(reason)).drop(*[f"__k{i}" for i in range(len(ordered))])


def inferred_trim(original: Column, cut: Column) -> Column:
    """(left, right): where the trimmed string lies in the original; both null where it is missing, an error where it doesn't occur."""
    at = F.instr(original, cut)
    wrong = F.raise_error(F.lit("the trimmed sequence is not part of the original"))
    left = F.when(cut.isNull(), F.lit(None).cast("int")).when(at > 0, at - 1).otherwise(wrong.cast("int"))
    return F.struct(left.alias("left_trim"), (F.length(original) - left - F.length(cut)).alias("right_trim"))
