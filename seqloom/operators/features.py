"""The per-sample feature table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .coverage import covered
from .slices import excluded


def genome_lengths(contigs: DataFrame) -> DataFrame:
    """Sum over all contigs of a genome, aligned or not."""
    return contigs.groupBy("genome_idx").agg(F.sum("sequence_length_bp").alias("total_length"))


def breadth(aligned: DataFrame, contigs: DataFrame) -> DataFrame:
    """genome_idx, covered, total_length, proportion_covered of genomes with alignments."""
    return covered(aligned, ["genome_idx"]).join(genome_lengths(contigs), "genome_idx").withColumn("proportion_covered", F.col("covered") / F.col("total_length"))


#: Alignments whose reads one task counts.
TASK_ROWS = 1 << 20


def fractional(hits: DataFrame, n_rows: int = 0) -> DataFrame:
    """prep_sample_idx, genome_idx, value: a read gives 1/k to each of its k different genomes. ``n_rows``: about how many hits there are, if many; tasks grow in number with them."""
    read = ["prep_sample_idx", "sequence_idx"]
    tasks = n_rows // TASK_ROWS + 1
    more = [tasks] if tasks > int(hits.sparkSession.conf.get("spark.sql.shuffle.partitions")) else []
    # one shuffle by read serves the distinct, the count and the partial sums
    each = hits.select(*read, "genome_idx").repartition(*more, *read).dropDuplicates()
    counted = each.withColumn("k", F.count(F.lit(1)).over(Window.partitionBy(*read)))
    return counted.groupBy("prep_sample_idx", "genome_idx").agg(F.sum(1 / F.col("k")).alias("value"))


def feature_table(alignment: DataFrame, exclusion: DataFrame, contigs: DataFrame, threshold: float) -> DataFrame:
    """Excluded features go first; then genomes covered below ``threshold``; then reads are counted. 0 skips coverage."""
    visible = excluded(alignment, exclusion).join(contigs.select("feature_idx", "genome_idx"), "feature_idx")
    if threshold > 0:
        alive = breadth(visible, contigs).where(F.col("proportion_covered") >= threshold).select("genome_idx")
        visible = visible.join(alive, "genome_idx", "left_semi")
    return fractional(visible, alignment.count())
