"""Nucleotide strings: reverse complement, canonical hash, fixed-width chunks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: IUPAC codes and their complements, fixed values.
CODES, COMPLEMENTS = "ACGTRYSWKMBDHVN", "TGCAYRSWMKVHDBN"
CHUNK = 65536


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, CODES, COMPLEMENTS))


def canonical_hash(seq: Column) -> Column:
    """The same for a sequence and its reverse complement, whatever the case: 32 hex digits."""
    up = F.upper(seq)
    return F.least(F.md5(up), F.md5(reverse_complement(up)))


def split(seq: Column, width: int = CHUNK) -> Column:
    """Array of (chunk_index from 0, chunk_data); an empty string is one empty chunk."""
    last = F.floor((F.greatest(F.length(seq), F.lit(1)) - 1) / width).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(i.alias("chunk_index"), F.substring(seq, i * width + 1, F.lit(width)).alias("chunk_data")))


def trimmed(seq: Column, left: Column, right: Column) -> Column:
    """Without ``left`` first and ``right`` last characters; trims that meet leave nothing."""
    return F.substring(seq, (left + 1).cast("int"), F.greatest(F.length(seq) - left - right, F.lit(0)).cast("int"))


def trimmed_array(values: Column, left: Column, right: Column) -> Column:
    return F.slice(values, (left + 1).cast("int"), F.greatest(F.size(values) - left - right, F.lit(0)).cast("int"))
