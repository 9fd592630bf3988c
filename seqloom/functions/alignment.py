"""CIGAR scores, SAM flags, mate columns."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship

#: SAM flag bits, fixed values of the format.
FLAGS = {
    "paired": 1, "proper_pair": 2, "unmapped": 4, "mate_unmapped": 8, "reverse": 16, "mate_reverse": 32,
    "read1": 64, "read2": 128, "secondary": 256, "qc_failed": 512, "duplicate": 1024, "supplementary": 2048,
}


def has_flag(flags: Column, name: str) -> Column:
    return flags.bitwiseAND(FLAGS[name]) != 0


def is_primary(flags: Column) -> Column:
    """A primary line; an unmapped read has one too."""
    return flags.bitwiseAND(FLAGS["secondary"] | FLAGS["supplementary"]) == 0


def is_mapped_primary(flags: Column) -> Column:
    return flags.bitwiseAND(FLAGS["unmapped"] | FLAGS["secondary"] | FLAGS["supplementary"]) == 0


def cigar_sum(cigar: Column, ops: str) -> Column:
    """Bases under the operations ``ops``."""
    runs = F.regexp_extract_all(cigar, F.lit(f"([0-9]+)[{ops}]"), F.lit(1))
    return F.aggregate(runs, F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))


def sequence_identity(cigar: Column) -> Column:
    """= over = X I D; null where there is none of them. Additive: mates are scored on their joined CIGARs."""
    return F.try_divide(cigar_sum(cigar, "=").cast("double"), cigar_sum(cigar, "=XID").cast("double"))


def query_coverage(cigar: Column) -> Column:
    """Aligned query bases (= X M) over the query's length (and I S H)."""
    return F.try_divide(cigar_sum(cigar, "=XM").cast("double"), cigar_sum(cigar, "=XMISH").cast("double"))


def mate_feature(rnext: Column, own: Column) -> Column:
    """``=`` is the own feature; null, ``*`` and empty are none."""
    return F.when(rnext == "=", own).when(rnext.isNull() | rnext.isin("*", ""), F.lit(None).cast("long")).otherwise(rnext.cast("long"))


def clipped(cigar: str, position: int, start: int, stop: int) -> tuple[str, int, int] | None:
    """CIGAR, position and stop of a line at ``position`` cut to the reference window [start, stop): query bases outside become hard clips; None if nothing is left inside.

    Insertions at the window's border belong to the side before them.
    """
    at, before, after, inside = position, 0, 0, []
    for size, op in re.findall(r"(\d+)([MIDNSHP=X])", cigar):
        n = int(size)
        on_reference, on_query = op in "MDN=X", op in "MIS=XH"
        if op in "SH":
            before, after = (before, after + n) if inside or at > position else (before + n, after)
        elif on_reference:
            lead, tail = max(0, min(n, start - at)), max(0, min(n, at + n - stop))
            kept = n - lead - tail if at < stop and at + n > start else 0
            if kept <= 0:
                before, after = (before + n * on_query, after) if at + n <= start else (before, after + n * on_query)
            else:
                before, after = before + lead * on_query, after + tail * on_query
                inside.append((kept, op))
            at += n
        elif on_query:
            if inside and at < stop:
                inside.append((n, op))
            else:
                before, after = (before, after + n) if inside else (before + n, after)
    first, last = max(position, start), min(at, stop)
    while inside and inside[-1][1] in "DN":
        last -= inside.pop()[0]
    while inside and inside[0][1] in "DN":
        first += inside.pop(0)[0]
    if not inside:
        return None
    text = (f"{before}H" if before else "") + "".join(f"{n}{op}" for n, op in inside) + (f"{after}H" if after else "")
    return text, first, last


def sliced(rows: DataFrame, start: int, stop: int, tags: list[str]) -> DataFrame:
    """Alignment lines cut to [start, stop) of their reference; tags of lines that were cut no longer hold and become null. Only lines that reach over a border go through Python."""
    ship(rows.sparkSession)
    over = rows.where((F.col("position") < stop) & (F.col("stop_position") > start))
    whole = (F.col("position") >= start) & (F.col("stop_position") <= stop)

    @F.pandas_udf("cigar string, position long, stop_position long")
    def cut(cigar: pd.Series, position: pd.Series) -> pd.DataFrame:
        parts = [None if c is None else clipped(c, int(p), start, stop) for c, p in zip(cigar, position, strict=True)]
        return pd.DataFrame([p or (None, 0, 0) for p in parts], columns=["cigar", "position", "stop_position"])

    part = over.where(~whole).withColumn("__cut", cut("cigar", "position")).where("__cut.cigar is not null")
    part = part.withColumns({c: F.col(f"__cut.{c}") for c in ("cigar", "position", "stop_position")}).drop("__cut")
    for t in tags:
        part = part.withColumn(t, F.lit(None).cast(rows.schema[t].dataType))
    return over.where(whole).unionByName(part)
