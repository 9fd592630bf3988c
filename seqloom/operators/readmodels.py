"""Read models: ladders, tallies, visibility, pages, metadata."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .reference import first_by


def ladder(rows: DataFrame, by: str, steps: list[tuple[str, Column]], otherwise: str) -> DataFrame:
    """by, status: the first step of which any row of the group holds."""
    flags = rows.groupBy(by).agg(*[F.bool_or(F.coalesce(test, F.lit(False))).alias(f"__{i}") for i, (_, test) in enumerate(steps)])
    status = reduce(lambda c, i: c.when(F.col(f"__{i}"), steps[i][0]), range(1, len(steps)), F.when(F.col("__0"), steps[0][0])).otherwise(otherwise)
    return flags.select(by, status.alias("status"))


def tally(rows: DataFrame, states: list[str], column: str = "status") -> DataFrame:
    """One row: the count of each state."""
    return rows.agg(*[F.count_if(F.col(column) == s).alias(s) for s in states])


def without_violation(entities: DataFrame, violations: DataFrame, key: str) -> DataFrame:
    """Universal quantifier: entities of which no row is a violation."""
    return entities.join(violations.select(key).distinct(), key, "left_anti")


def with_latest(entities: DataFrame, events: DataFrame, key: str, order: list, columns: list[str]) -> DataFrame:
    """Each entity with the first of its events in ``order``, or nulls."""
    return entities.join(first_by(events, [key], order).select(key, *columns), key, "left")


def page(rows: DataFrame, order: list, size: int) -> DataFrame:
    """The first ``size`` + 1 rows: one too many tells that there are more."""
    return rows.orderBy(*order).limit(size + 1)


def pivot(rows: DataFrame, by: str, field: str, value: str, fields: list[str]) -> DataFrame:
    """Long to wide; the fields are given, so no pass is needed to find them."""
    return rows.groupBy(by).pivot(field, fields).agg(F.max(value))


def value_counts(rows: DataFrame, value: Column, by: list[str] = ()) -> DataFrame:
    """by, histogram: values and their counts as a list in value order. Values are counted first, so a list has one entry per value."""
    counted = rows.groupBy(*by, value.alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("value", "n"))).alias("histogram"))


def with_state(entities: DataFrame, gates: DataFrame, key: str, scope: Column, state: str = "state") -> DataFrame:
    """Each entity with its gate's ``state`` within ``scope`` (a test on ``gates``, of whose rows it leaves at most one per key). Null says that there is no gate there, which isn't a passed one."""
    return entities.join(gates.where(scope).select(key, state), key, "left")


def read_report(reads: DataFrame, seq: str, qual: str, by: list[str]) -> DataFrame:
    """One mate's figures for each group: by, reads, total_bases, mean_quality, gc_content, n_content, min_length, max_length, mean_length, and maps of value to count: quality_histogram, gc_histogram, length_histogram.

    Rows without a sequence aren't reads of that mate; a group without any has no row. Means are of sums,
    not of reads: null without bases, mean_quality also without qualities. Histograms hold the rounded mean
    quality and the rounded percentage of G and C of each read that has one, and its length.

    Values are counted before they are gathered, so a group of any size shuffles a row for each value
    and task, and a map has an entry for each value.
    """
    s, q = F.col(seq), F.col(qual)
    without = lambda letters: F.length(s) - F.length(F.translate(s, letters, ""))
    read = reads.where(s.isNotNull()).select(
        *by, F.length(s).cast("long").alias("size"), without("GCgc").cast("long").alias("gc"), without("Nn").cast("long").alias("unknown"),
        F.when(F.size(q) > 0, F.aggregate(q, F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x.cast("long"), F.lit(0)))).alias("total"), F.size(q).alias("scored"))
    whole = lambda x: F.round(x).cast("long")
    # a read's sums go with its length only, so that they count once
    each = lambda kind, value, *sums: F.struct(F.lit(kind).alias("kind"), value.alias("value"), *[(x if kind == "length" else F.lit(None).cast("long")).alias(n) for n, x in zip(("gc", "unknown", "total"), sums, strict=True)])
    sums = (F.col("gc"), F.col("unknown"), F.col("total"))
    kinds = F.array(each("length", F.col("size"), *sums), each("gc", whole(F.try_divide(100.0 * F.col("gc"), F.col("size").cast("double"))), *sums), each("quality", whole(F.try_divide(F.col("total").cast("double"), F.col("scored").cast("double"))), *sums))
    counted = read.select(*by, F.inline(kinds)).groupBy(*by, "kind", "value").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in ("gc", "unknown", "total")])
    lengths = F.col("kind") == "length"
    histogram = lambda kind: F.map_from_entries(F.array_sort(F.collect_list(F.when((F.col("kind") == kind) & F.col("value").isNotNull(), F.struct("value", "n")))))
    folded = counted.groupBy(*by).agg(
        F.sum(F.when(lengths, F.col("n"))).alias("reads"), F.sum(F.when(lengths, F.col("n") * F.col("value"))).alias("total_bases"), F.sum("gc").alias("gc"), F.sum("unknown").alias("unknown"), F.sum("total").alias("total"),
        F.min(F.when(lengths, F.col("value"))).alias("min_length"), F.max(F.when(lengths, F.col("value"))).alias("max_length"),
        *[histogram(k).alias(f"{k}_histogram") for k in ("quality", "gc", "length")])
    share = lambda c, of="total_bases": F.try_divide(F.col(c).cast("double"), F.col(of).cast("double"))
    return folded.select(*by, "reads", "total_bases", share("total").alias("mean_quality"), share("gc").alias("gc_content"), share("unknown").alias("n_content"), "min_length", "max_length", share("total_bases", "reads").alias("mean_length"), "quality_histogram", "gc_histogram", "length_histogram")
