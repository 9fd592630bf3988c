"""The corpus pipeline: each stage takes what the one before kept.

1. Documents that a quality rule rejects go. 2. Of equal texts one stays. 3. Of near-equal texts one
stays. 4. Sources are drawn to their target weights: a document may come several times, or not at
all. 5. Each drawn document is encoded; the result has one row per draw.

Defined cases, of every stage: null and empty texts have too few words and go with the first stage
(given to a later stage alone, they are equal to each other, similar to nothing else, without tokens,
and encoded as no ids); null doc_ids stay as they are; repeated rows are copies, of which the second
stage leaves one; ties go to the largest doc_id among equal texts and to the least among near ones;
very long texts are judged, compared and encoded whole; an empty table gives no rows; columns that
a table has beyond those of documents pass through all stages but the last, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seqloom.llm import bpe, exact_dedup, mixing, ngram_jaccard, quality_rules
from seqloom.llm.common import drop_kept, keep


def _rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.apply(docs)


def _exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(docs)


def _near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_jaccard.dedup(docs)


def _mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.apply(docs)


def _encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs, bpe.vocabulary())


STAGES = [("quality rules", _rules), ("exact dedup", _exact), ("near dedup", _near), ("mixing", _mix), ("encoding", _encode)]

#: The near-duplicate stage and the encoder have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what a stage kept is deleted once the next has been written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        kept = keep(stage(spark, docs, sf_dir), "stage")
        drop_kept(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
