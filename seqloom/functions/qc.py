"""Read filters and trims.

``filter_read`` is a column expression. The adapter and poly-G trims need a search with mismatches,
so they run on Arrow batches; they follow the published description of the common FASTQ
preprocessors and are approximate where that leaves choices open.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship


def filter_read(seq: Column, qual: Column, min_len: int = 15, max_len: int = 0, qual_q: int = 15, max_unq_pct: int = 40, max_n: int = 5, min_avg_q: int = 0) -> Column:
    """(passed, fail_reason, length, n_bases, low_qual_bases, mean_quality); reasons in the order length, n_base, quality, too_long. 0 switches a bound off."""
    length = F.length(seq)
    n = F.length(seq) - F.length(F.translate(seq, "Nn", ""))  # upper() lengthens a sharp s
    low = F.coalesce(F.size(F.filter(qual, lambda q: q < qual_q)), F.lit(0))
    mean = F.try_divide(F.aggregate(qual, F.lit(0).cast("long"), lambda a, q: a + q).cast("double"), F.size(qual).cast("double"))
    bad_quality = (low * 100 > max_unq_pct * length) | (F.lit(min_avg_q > 0) & (F.coalesce(mean, F.lit(0.0)) < min_avg_q))
    reason = F.when(length < min_len, "length").when(n > max_n, "n_base").when(bad_quality, "quality").when(F.lit(max_len > 0) & (length > max_len), "too_long")
    return F.struct(reason.isNull().alias("passed"), reason.alias("fail_reason"), length.alias("length"), n.alias("n_bases"), low.alias("low_qual_bases"), mean.alias("mean_quality"))


def _mismatches(a: np.ndarray, b: np.ndarray) -> int:
    return int((a != b).sum())


#: Bases that are searched at once; a longer read is searched by itself.
PART_BASES = 1 << 20


def adapter_starts(bases: np.ndarray, begin: np.ndarray, end: np.ndarray, adapter: bytes, least: int = 4) -> np.ndarray:
    """Where ``adapter`` begins in the 3' part of each read ``bases[begin:end]``: one mismatch for each 8 bases is allowed; the end if nowhere.

    Reads follow each other in ``bases``, and an adapter may hang over a read's end.
    """
    a = np.frombuffer(adapter, np.uint8)
    left = np.repeat(end, end - begin) - np.arange(len(bases))  # bases from here to the read's end
    off = np.zeros(len(bases), np.int16)
    for k, base in enumerate(a[: len(bases)]):
        on = len(bases) - k
        off[:on] += (bases[k:] != base) & (left[:on] > k)
    hits = np.flatnonzero((left >= least) & (off <= np.minimum(len(a), left) // 8))
    return _first(hits, begin, end)


def _first(hits: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The first of the rising ``hits`` in each [begin, end), the end if there is none."""
    first = np.append(hits, np.iinfo(np.int64).max)[np.searchsorted(hits, begin)]
    return np.where(first < end, first, end)


def poly_g_starts(bases: np.ndarray, begin: np.ndarray, end: np.ndarray, quals: np.ndarray | None = None, least: int = 10, mismatch_per: int = 8, most: int = 5, max_mean_q: int = 5) -> np.ndarray:
    """Where a 3' run of G begins in each read ``bases[begin:end]`` that has at most one other base per 8, and 5 in all; the end if the run is shorter than ``least``.

    With qualities the run also has a mean of at most ``max_mean_q``: good runs of G stay. What lies between two reads belongs to none.
    """
    size = end - begin
    at = np.repeat(begin - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())  # the reads' places
    ends = np.repeat(end, size)
    is_g = bases == 0x47
    others = np.concatenate(([0], np.cumsum(~is_g)))
    n, other = ends - at, others[ends] - others[at]
    stop = at[(other > most) | ((other > np.maximum(1, n // mismatch_per)) & (n >= least))]
    run = is_g[at]
    if quals is not None:
        sums = np.concatenate(([0], np.cumsum(quals, dtype=np.int64)))
        run &= sums[ends] - sums[at] <= max_mean_q * n
    # the last place that ends the search, seen from the 3' end, then the first G behind it
    last = np.append(stop, -1)[np.searchsorted(stop, end) - 1]
    start = _first(at[run], np.maximum(begin, last + 1), end)
    return np.where(end - start >= least, start, end)


def adapter_start(seq: bytes, adapter: bytes, least: int = 4) -> int:
    """``adapter_starts`` of one read."""
    return int(adapter_starts(np.frombuffer(seq, np.uint8), np.array([0]), np.array([len(seq)]), adapter, least)[0])


def poly_g_start(seq: bytes, least: int = 10, mismatch_per: int = 8, most: int = 5, qual=None, max_mean_q: int = 5) -> int:
    """``poly_g_starts`` of one read."""
    quals = None if qual is None else np.asarray(qual, np.int64)
    return int(poly_g_starts(np.frombuffer(seq, np.uint8), np.array([0]), np.array([len(seq)]), quals, least, mismatch_per, most, max_mean_q)[0])


def overlap(seq1: bytes, seq2: bytes, least: int = 30, most: int = 5, percent: int = 20) -> int | None:
    """Insert length of a pair whose mates read past each other, by the overlap of mate 1 and the reverse complement of mate 2."""
    turn = bytes.maketrans(b"ACGTacgt", b"TGCAtgca")
    a, b = np.frombuffer(seq1, np.uint8), np.frombuffer(seq2.translate(turn)[::-1], np.uint8)
    longest = min(len(a), len(b))
    if longest < least:
        return None
    # mismatches of the first bases rule most inserts out at once
    head = np.zeros(longest - least + 1, np.int32)
    for k in range(least):
        head += a[k] != b[len(b) - longest + k : len(b) - least + k + 1]
    for insert in longest - np.flatnonzero(head <= most):
        x, y = a[:insert], b[len(b) - insert :]
        d = _mismatches(x, y)
        if d <= most and d * 100 <= percent * insert:
            return int(insert)
    return None


def _parts(size: np.ndarray):
    """Ranges of rows that hold about PART_BASES together, at least one row each."""
    total, at = np.cumsum(size), 0
    while at < len(size):
        until = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PART_BASES, "right")))
        yield at, until
        at = until


def _ends(reads: list[bytes | None], quals: list, inserts: list[int | None], raw: list[bytes], poly_g: bool) -> tuple[np.ndarray, np.ndarray]:
    """How many bases stay of each read, and whether insert or adapter cut it."""
    size = np.array([len(r or b"") for r in reads], np.int64)
    kept, cut = size.copy(), np.zeros(len(reads), bool)
    for a, b in _parts(size):
        bases = np.frombuffer(b"".join(r or b"" for r in reads[a:b]), np.uint8)
        end = np.cumsum(size[a:b])
        begin = end - size[a:b]
        stay = np.minimum(end, [e if i is None else s + i for s, e, i in zip(begin, end, inserts[a:b], strict=True)])
        for adapter in raw:
            stay = np.minimum(stay, adapter_starts(bases, begin, end, adapter))
        cut[a:b] = stay < end
        if poly_g:
            none = all(q is None for q in quals[a:b])
            if not none and any(q is not None and len(q) != n for q, n in zip(quals[a:b], size[a:b], strict=True)):
                raise ValueError("a read's bases and qualities differ in number")
            flat = None if none else np.concatenate([np.zeros(n, np.int64) if q is None else np.asarray(q, np.int64) for q, n in zip(quals[a:b], size[a:b], strict=True)])
            stay = poly_g_starts(bases, begin, stay, flat)
        kept[a:b] = stay - begin
    return kept, cut


def _cuts(raw: list[bytes], poly_g: bool):
    """A UDF: both mates and their qualities to the bases that stay of each, and the insert that their overlap tells. Reads are searched together, not one by one; only the overlap is found pair by pair."""
    @F.pandas_udf("kept1 int, kept2 int, insert int, adapter boolean")
    def cut(one: pd.Series, two: pd.Series, q1: pd.Series, q2: pd.Series) -> pd.DataFrame:
        a = [(x or "").encode() for x in one]
        b = [x.encode() if x else None for x in two]
        inserts = [overlap(x, y) if y else None for x, y in zip(a, b, strict=True)]
        kept1, cut1 = _ends(a, list(q1), inserts, raw, poly_g)
        kept2, cut2 = _ends(b, [q if y else None for q, y in zip(q2, b, strict=True)], inserts, raw, poly_g)
        alone = np.array([y is None for y in b], bool)
        return pd.DataFrame({"kept1": kept1, "kept2": pd.array(kept2, "Int32"), "insert": pd.array(inserts, "Int32"), "adapter": cut1 | cut2}).assign(kept2=lambda d: d["kept2"].mask(alone))

    return cut


def _adapters(adapters: list[str], revcomp: bool) -> list[bytes]:
    turn = str.maketrans("ACGTacgt", "TGCAtgca")
    return [a.encode() for a in [*adapters, *([x.translate(turn)[::-1] for x in adapters] if revcomp else [])]]


def trim_lengths(reads: DataFrame, adapters: list[str], poly_g: bool = False) -> DataFrame:
    """``reads`` (sequence1, sequence2 or null) with kept1 and kept2, the bases that stay at the 5' end; qualities aren't looked at."""
    ship(reads.sparkSession)
    none = F.lit(None).cast("array<short>")
    return reads.withColumn("kept", _cuts(_adapters(adapters, False), poly_g)("sequence1", "sequence2", none, none)).select("*", "kept.kept1", "kept.kept2").drop("kept")


def trimmed_reads(reads: DataFrame, adapters: list[str] = (), poly_g: bool = False, revcomp: bool = False) -> DataFrame:
    """``reads`` (sequence1, qual1, and a mate or nulls) with what is left of sequences and qualities, trimmed1_3p and trimmed2_3p, overlap_len and adapter_trimmed.

    A pair whose mates read past each other is cut to its insert, then adapters are looked for (also
    turned round, with ``revcomp``), then runs of G of low quality go. No adapters and no overlap: nothing is cut.
    """
    ship(reads.sparkSession)
    told = reads.withColumn("__cut", _cuts(_adapters(list(adapters), revcomp), poly_g)("sequence1", "sequence2", "qual1", "qual2"))
    out = told
    for n in (1, 2):
        kept = F.col(f"__cut.kept{n}")
        out = out.withColumn(f"trimmed{n}_3p", F.length(f"sequence{n}") - kept)
        out = out.withColumn(f"sequence{n}", F.substring(f"sequence{n}", F.lit(1), kept)).withColumn(f"qual{n}", F.slice(f"qual{n}", F.lit(1), kept))
    return out.withColumn("overlap_len", F.col("__cut.insert")).withColumn("adapter_trimmed", F.col("__cut.adapter")).drop("__cut")
