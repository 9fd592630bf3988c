import datetime
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from seqloom import schemas
from seqloom.functions import alignment as aln
from seqloom.functions import metadata, qc, sequence
from seqloom.operators import alignment, coverage, features, masks, mutations, planning, readmodels, reference, slices
from seqloom.plans import catalogue


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


def test_schemas_are_typed_when_empty(spark):
    for name in schemas.DDL:
        assert schemas.empty(spark, name).count() == 0
    assert len(schemas.DDL) == 15


def test_slice_validation(spark):
    table = spark.createDataFrame([(1, 10), (2, 20), (2, 21)], "a long, b long")
    s = slices.Surface(("a",), needs_filter=True)
    assert rows(slices.build(table, s, {"a": [2]})) == [(2, 20), (2, 21)]
    for bad in ({}, {"a": []}, {"a": ["2"]}, {"a": [True]}, {"b": [1]}):
        with pytest.raises(slices.SliceError):
            slices.build(table, s, bad)
    one = slices.Surface(("a",), single=("a",))
    for bad in ({}, {"a": [1, 2]}):
        with pytest.raises(slices.SliceError):
            slices.build(table, one, bad)
    assert rows(slices.build(table, slices.Surface(("a",)), {})) == [(1, 10), (2, 20), (2, 21)]


def test_scope_keeps_duplicates(spark):
    t = spark.createDataFrame([(1, "x")], "f long, v string")
    m = spark.createDataFrame([(7, 1), (8, 1)], "r long, f long")
    assert rows(slices.scoped(t, m, "f", "r", [7, 8])) == [(1, "x"), (1, "x")]


def test_block_predicate_and_join_agree(spark):
    t = spark.createDataFrame([(p, s) for p in range(5) for s in range(40)], "p long, s long")
    few = [(0, 3, 5), (1, 0, 0), (4, 39, 60)]
    many = [(p, 4 * k, 4 * k + 1) for p in range(5) for k in range(60)]
    want = lambda ms: sorted((p, s) for p, s in rows(t) if any(o == p and a <= s <= b for o, a, b in ms))
    assert rows(slices.block(t, few, "p", "s"), "p", "s") == want(few)
    assert rows(slices.block(t, many, "p", "s"), "p", "s") == want(many)
    with pytest.raises(slices.SliceError):
        slices.block(t, [], "p", "s")


def test_overlapping_members_give_a_row_once(spark):
    t = spark.createDataFrame([(p, s) for p in range(3) for s in range(500)], "p long, s long")
    for n in (20, 300):
        members = [(p, 2 * k, 2 * k + 30) for p in range(2) for k in range(n)] + [(2, 5, 4)]
        want = sorted((p, s) for p, s in rows(t) if any(o == p and a <= s <= b for o, a, b in members))
        assert rows(slices.block(t, members, "p", "s"), "p", "s") == want
    assert slices.merged_members([(1, 5, 9), (1, 10, 12), (1, 1, 2), (2, 3, 1)]) == [(1, 1, 2), (1, 5, 12)]


def test_surfaces(spark):
    data = {
        "reference_membership": [(1, 10), (2, 10), (2, 11)], "reference_sequences": [(10, "h", 4), (11, "g", 5)], "reference_exclusion": [(11,)],
        "alignment": [(1, 5, 7, 10, *[None] * 19), (1, 5, 8, 11, *[None] * 19), (2, 5, 7, 10, *[None] * 19)],
        "read": [(5, 7, "a", "ACGT", None, None, None), (5, 9, "b", "ACGT", None, None, None), (6, 1, "c", "ACGT", None, None, None)],
        "read_mask": [(3, 5, 7, "pass", 1, 1, None, None), (3, 5, 9, "host_rype", 0, 0, None, None), (4, 5, 7, "pass", 0, 0, None, None)],
    }
    tables = lambda n: spark.createDataFrame(data.get(n, []), schemas.schema(n))
    fetch = lambda *a: slices.fetch(tables, *a)
    assert rows(fetch("reference_sequences", {"reference_idx": [1, 2]}), "feature_idx") == [(10,), (10,), (11,)]
    assert rows(fetch("reference_sequences", {"reference_idx": [2], "feature_idx": [11]}), "feature_idx") == [(11,)]
    assert fetch("reference_sequences").count() == 2
    a = fetch("alignment_visible", {"alignment_idx": [1]})
    assert tuple(a.columns) == slices.ALIGNMENT_COLUMNS and rows(a, "feature_idx") == [(10,)]
    assert rows(fetch("read_masked", {"mask_idx": [3]}), "read_id", "sequence1") == [("a", "CG")]
    b = fetch("read_block", {}, [(5, 1, 8), (6, 1, 1)])
    assert tuple(b.columns) == slices.READ_COLUMNS and rows(b, "read_id") == [("a",), ("c",)]
    assert rows(fetch("read_masked_block", {"mask_idx": [4]}, [(5, 1, 100)]), "sequence1") == [("ACGT",)]
    refused = [("read", {"mask_idx": [1]}), ("reference_taxonomy", {}), ("read_masked", {}), ("alignment_visible", {}), ("alignment_visible", {"alignment_idx": [1, 2]}), ("alignment_visible", {"prep_sample_idx": [5]}),
               ("read_block", {}, []), ("read_block", {"mask_idx": [1]}, [(5, 1, 2)]), ("read_masked_block", {}, [(5, 1, 2)]), ("read_masked_block", {"mask_idx": [1, 2]}, [(5, 1, 2)]),
               ("read_masked_block", {"mask_idx": [1], "prep_sample_idx": [5]}, [(5, 1, 2)]), ("read_masked", {"mask_idx": [3]}, [(5, 1, 2)]), ("read_masked", {"reason": [1]}), ("reference_phylogeny", {"mask_idx": [1]})]
    for bad in refused:
        with pytest.raises(slices.SliceError):
            fetch(*bad)


def test_mask_reasons(spark):
    mask = spark.createDataFrame([(r, m) for r in ("pass", "host_minimap2", "host_rype", "spikein_syndna", "host_other", "qc_length", "twist_no_adaptor") for m in (None, 1)], "reason string, right_trim2 long")
    assert tuple(masks.metrics(mask).first()) == (21, 9, 3, 3, 14)


def test_block_bounds_reach_the_scan(spark, sf):
    plan = slices.block(spark.read.parquet(f"{sf}/lineitem.parquet"), [(1, 5, 9), (2, 7, 30)], "l_suppkey", "l_orderkey")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(l_orderkey,5)" in plan and "LessThanOrEqual(l_orderkey,30)" in plan and "In(l_suppkey" in plan


def test_masked_trims(spark):
    reads = spark.createDataFrame([(1, 1, "a", "ACGTAC", [1, 2, 3, 4, 5, 6], None, None), (1, 2, "b", "AAAA", None, "TTTT", None), (1, 3, "c", "GGGG", None, None, None), (1, 4, "d", "CCCC", None, None, None)], schemas.schema("read"))
    mask = spark.createDataFrame([(9, 1, 1, "pass", 4, 2, None, None), (9, 1, 2, "pass", 1, 3, 2, 2), (9, 1, 3, "pass", 0, 0, None, None), (9, 1, 4, "qc_length", 0, 0, None, None)], schemas.schema("read_mask"))
    got = {r["sequence_idx"]: (r["sequence1"], r["qual1"], r["sequence2"]) for r in masks.masked(reads, mask).collect()}
    assert got == {1: ("", [], None), 2: ("", None, ""), 3: ("GGGG", None, None)}


def test_infer_trim(spark):
    df = spark.createDataFrame([("ACGTACGT", "GTA"), ("ACGT", None), ("ACGT", "")], "o string, c string")
    assert [tuple(r[0]) for r in df.select(masks.inferred_trim(F.col("o"), F.col("c"))).collect()] == [(2, 3), (None, None), (0, 4)]
    with pytest.raises(Exception, match="not part of"):
        spark.createDataFrame([("ACGT", "GG")], "o string, c string").select(masks.inferred_trim(F.col("o"), F.col("c"))).collect()


def test_canonical_hash_and_chunks(spark):
    df = spark.createDataFrame([("ACGTTN",), ("naacgt",), ("",)], "s string")
    h = [r[0] for r in df.select(sequence.canonical_hash(F.col("s"))).collect()]
    assert h[0] == h[1] != h[2]
    assert [[tuple(c) for c in r[0]] for r in df.select(sequence.split(F.col("s"), 4)).collect()] == [[(0, "ACGT"), (1, "TN")], [(0, "naac"), (1, "gt")], [(0, "")]]


def test_cigar_scores(spark):
    def by_hand(text):
        n = dict.fromkeys("=XIDMSH", 0)
        for size, op in re.findall(r"(\d+)(.)", text):
            n[op] += int(size)
        scored, query = n["="] + n["X"] + n["I"] + n["D"], sum(n[o] for o in "=XMISH")
        return n["="] / scored if scored else None, (n["="] + n["X"] + n["M"]) / query if query else None

    rng = random.Random(11)
    texts = ["".join(f"{rng.randint(1, 90)}{rng.choice('=XIDMSH')}" for _ in range(rng.randint(1, 9))) for _ in range(60)] + ["7S", "3D", "12=", "4H5X"]
    df = spark.createDataFrame([(x,) for x in texts], "c string")
    for x, i, c in df.select("c", aln.sequence_identity(F.col("c")), aln.query_coverage(F.col("c"))).collect():
        assert (i, c) == pytest.approx(by_hand(x))


def test_flags_and_mates(spark):
    df = spark.createDataFrame([(4,), (256,), (0,), (2048,)], "f int")
    assert [tuple(r) for r in df.select(aln.is_primary(F.col("f")), aln.is_mapped_primary(F.col("f"))).collect()] == [(True, False), (False, False), (True, True), (False, False)]
    m = spark.createDataFrame([("=",), ("*",), ("",), (None,), ("12",)], "r string")
    assert [r[0] for r in m.select(aln.mate_feature(F.col("r"), F.lit(5).cast("long"))).collect()] == [5, None, None, None, 12]


def test_paired_gate_scores_mates_together(spark):
    df = spark.createDataFrame([(1, 1, 10, 50, "10="), (1, 1, 50, 10, "6=4X"), (2, 1, 10, 50, "6=4X"), (2, 1, 50, 10, "6=4X")], "sequence_idx long, feature_idx long, position long, mate_position long, cigar string")
    assert rows(alignment.gate_paired(df, 0.8, 1.0), "sequence_idx", "position") == [(1, 10), (1, 50)]


@pytest.mark.parametrize("width", [3, 10, 1 << 20])
def test_coverage_against_positions(spark, width):
    import random

    rng = random.Random(width)
    data = [(rng.randint(0, 3), a, a + rng.randint(0, 15)) for a in (rng.randint(0, 90) for _ in range(120))] + [(0, None, 5), (1, 3, None)]
    df = spark.createDataFrame(data, "g long, position long, stop_position long")
    want = {g: len({p for h, a, b in data if h == g and a is not None and b is not None for p in range(a, b)}) for g in range(4)}
    assert dict(rows(coverage.covered(df, ["g"], width))) == want
    deep = {}
    # bins never show: runs and islands are those of one bin
    assert rows(coverage.depth(df, ["g"], width)) == rows(coverage.depth(df, ["g"], 1 << 30))
    assert rows(coverage.islands(df, ["g"], width)) == rows(coverage.islands(df, ["g"], 1 << 30))
    for g, a, b, d in rows(coverage.depth(df, ["g"], width)):
        deep.update({(g, p): d for p in range(a, b)})
    assert len(deep) == sum(want.values())
    assert sum(deep.values()) == sum(b - a for _, a, b in data if a is not None and b is not None)


def test_feature_table(spark):
    contigs = spark.createDataFrame([(1, 10, 100), (2, 10, 100), (3, 20, 100), (4, 30, 1000)], "feature_idx long, genome_idx long, sequence_length_bp long")
    a = spark.createDataFrame([(1, 1, 1, 0, 50), (1, 1, 2, 0, 50), (1, 1, 3, 0, 60), (1, 2, 3, 10, 80), (2, 3, 4, 0, 5), (2, 4, 1, 0, 50)], "prep_sample_idx long, sequence_idx long, feature_idx long, position long, stop_position long")
    none = spark.createDataFrame([], "feature_idx long")
    assert rows(features.feature_table(a, none, contigs, 0.0)) == [(1, 10, 0.5), (1, 20, 1.5), (2, 10, 1.0), (2, 30, 1.0)]
    assert rows(features.feature_table(a, none, contigs, 0.2)) == [(1, 10, 0.5), (1, 20, 1.5), (2, 10, 1.0)]
    blocked = spark.createDataFrame([(3,)], "feature_idx long")
    assert rows(features.feature_table(a, blocked, contigs, 0.2)) == [(1, 10, 1.0), (2, 10, 1.0)]
    assert features.feature_table(a.where("false"), none, contigs, 0.2).columns == ["prep_sample_idx", "genome_idx", "value"]


def test_filter_read(spark):
    data = [("ACGT" * 10, [30] * 40), ("ACG", [30] * 3), ("N" * 6 + "ACGT" * 10, [30] * 46), ("ACGT" * 10, [2] * 40), ("ACGT" * 40, [30] * 160)]
    df = spark.createDataFrame(data, "s string, q array<short>")
    got = [r[0]["fail_reason"] for r in df.select(qc.filter_read(F.col("s"), F.col("q"), max_len=100)).collect()]
    assert got == [None, "length", "n_base", "quality", "too_long"]


def test_filter_read_counts_n_beside_sharp_s(spark):
    df = spark.createDataFrame([("Nn" * 3 + "ß" * 3 + "ACGT" * 10,), ("Nn" * 2 + "n" + "ß" * 3 + "ACGT" * 10,)], "s string")
    got = [tuple(r[0])[1:4] for r in df.select(qc.filter_read(F.col("s"), F.lit(None).cast("array<short>"))).collect()]
    assert got == [("n_base", 49, 6), (None, 48, 5)]


def test_trims(spark):
    adapter = "AGATCGGAAGAGC"
    insert = "ACGTTGCAAGGTCCATTGACCATGGCATTAGCAGT"
    turn = insert.translate(str.maketrans("ACGT", "TGCA"))[::-1]
    df = spark.createDataFrame([(insert + adapter, None), (insert, None), ("ACTC" * 5 + "G" * 16, None), (insert + "CCCCCC", turn + "AAAAAA")], "sequence1 string, sequence2 string")
    got = [(r["kept1"], r["kept2"]) for r in qc.trim_lengths(df, [adapter], poly_g=True).collect()]
    assert got == [(35, None), (35, None), (20, None), (35, 35)]


def test_trimmed_reads(spark):
    """Sequences, qualities and counts; a good run of G stays, a bad one goes, and without adapters nothing is cut."""
    adapter, insert = "AGATCGGAAGAGC", "ACGTTGCAAGGTCCATTGACCATGGCATTAGCAGT"
    turned = lambda x: x.translate(str.maketrans("ACGT", "TGCA"))[::-1]
    g = "ACTC" * 5 + "G" * 16
    data = [(insert + adapter, [35] * 48, None, None), (g, [35] * 36, None, None), (g, [35] * 20 + [2] * 16, None, None), (insert + "C" * 9, [35] * 44, turned(insert) + "A" * 9, [30] * 44), (insert + turned(adapter), [35] * 48, None, None), (insert, None, None, None)]
    df = spark.createDataFrame([(i, *d) for i, d in enumerate(data)], "k int, sequence1 string, qual1 array<short>, sequence2 string, qual2 array<short>")
    got = {r["k"]: r for r in qc.trimmed_reads(df, [adapter], poly_g=True).collect()}
    assert (got[0]["sequence1"], got[0]["trimmed1_3p"], len(got[0]["qual1"]), got[0]["adapter_trimmed"]) == (insert, 13, 35, True)
    assert got[1]["sequence1"] == g and got[1]["trimmed1_3p"] == 0 and not got[1]["adapter_trimmed"]
    assert got[2]["sequence1"] == "ACTC" * 5 and got[2]["trimmed1_3p"] == 16 and not got[2]["adapter_trimmed"]
    assert (got[3]["sequence1"], got[3]["sequence2"], got[3]["overlap_len"], got[3]["trimmed2_3p"]) == (insert, turned(insert), 35, 9)
    assert got[4]["trimmed1_3p"] == 0 and got[5]["qual1"] is None and got[5]["sequence1"] == insert
    none = {r["k"]: r for r in qc.trimmed_reads(df).collect()}
    assert [none[k]["sequence1"] == data[k][0] for k in (0, 1, 2, 4)] == [True] * 4
    both = {r["k"]: r for r in qc.trimmed_reads(df, [adapter], revcomp=True).collect()}
    assert both[4]["sequence1"] == insert


def brute_adapter(s, a):
    for at in range(len(s) - 3):
        n = min(len(a), len(s) - at)
        if sum(x != y for x, y in zip(s[at : at + n], a)) <= n // 8:
            return at
    return len(s)


def brute_overlap(a, b):
    b = b.translate(str.maketrans("ACGT", "TGCA"))[::-1]
    for insert in range(min(len(a), len(b)), 29, -1):
        d = sum(x != y for x, y in zip(a[:insert], b[len(b) - insert :]))
        if d <= 5 and d * 100 <= 20 * insert:
            return insert
    return None


def brute_poly_g(s, qual):
    other, total, start = 0, 0, len(s)
    for n in range(1, len(s) + 1):
        at = len(s) - n
        other += s[at] != "G"
        if other > 5 or (n >= 10 and other > max(1, n // 8)):
            break
        total += 0 if qual is None else qual[at]
        if s[at] == "G" and total <= 5 * n:
            start = at
    return start if len(s) - start >= 10 else len(s)


def test_reads_searched_together_are_cut_as_each_alone(monkeypatch):
    """Random reads with and without qualities, in one part, in many, and with the mates' ends cut before the runs of G are looked for."""
    rng = random.Random(4)
    tails = ["", "AGATCGGAAGAGC", "AGATC", "AGAT", "G" * 30, "GGGGGGGGTGGGGGGG", "GGTGGGGGGGGGAGGGGGGGGGCGGGGGGGG", "AGATCGGTAGAGCGGGGGGGGGGGGGG"]
    reads = ["".join(rng.choice("ACGTN") for _ in range(rng.choice([0, 1, 3, 9, 40, 300]))) + rng.choice(tails) for _ in range(400)]
    quals = [None if rng.random() < 0.3 else [rng.choice([1, 2, 4, 6, 9, 30]) for _ in r] for r in reads]
    inserts = [None if rng.random() < 0.5 else rng.randint(0, len(r) + 5) for r in reads]
    for adapters in ([], ["AGATCGGAAGAGC"], ["AGATCGGAAGAGC", "TTT"]):
        cut = [min([len(r) if i is None else min(i, len(r)), *(brute_adapter(r, x) for x in adapters)]) for r, i in zip(reads, inserts, strict=True)]
        want = [brute_poly_g(r[:e], None if q is None else q[:e]) for r, e, q in zip(reads, cut, quals, strict=True)]
        for size in (1, 500, 1 << 20):
            monkeypatch.setattr(qc, "PART_BASES", size)
            for poly_g, kept in ((False, cut), (True, want)):
                got, short = qc._ends([r.encode() for r in reads], quals, inserts, [x.encode() for x in adapters], poly_g)
                assert got.tolist() == kept
                assert short.tolist() == [e < len(r) for e, r in zip(cut, reads, strict=True)]
    with pytest.raises(ValueError, match="differ in number"):
        qc._ends([b"ACGT"], [[1, 2]], [None], [], True)


def test_trim_filter_reads_whole_texts(spark, tmp_path):
    rng = random.Random(1)
    adapter = "AGATCGGAAGAGC"
    texts = ["".join(rng.choice("acgt") for _ in range(rng.choice([0, 3, 20, 70, 400]))) + rng.choice(["", adapter.lower() + "tc" * 9, adapter.lower()[:5], "g" * 30]) for _ in range(90)] + [None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    table = str.maketrans("bdefhijklmnopqrsuvwxyz ", "acgtacgtacgtacgtacgtacg")
    want = []
    for i, x in enumerate(texts):
        one = "".join(c for c in (x or "").translate(table) if c in "acgt").upper()
        half = one[: len(one) // 2]
        two = (half.translate(str.maketrans("ACGT", "TGCA"))[::-1] + half, one[::-1], None)[i % 3]
        insert = brute_overlap(one, two) if two else None
        kept = []
        for s in (one, two):
            if s:
                end = min(brute_adapter(s, adapter), len(s) if insert is None else insert)
                kept.append(min(end, qc.poly_g_start(s[:end].encode())))
            else:
                kept.append(None if kept else 0)  # an empty mate is none
        want.append((i, *kept, all(k is None or k >= 15 for k in kept)))
    got = rows(catalogue.QUERIES["qc_trim_filter"](spark, str(tmp_path)), "doc_id", "kept1", "kept2", "passed")
    assert got == want
    assert max(k for _, k, *_ in want) > 150


def test_read_report(spark):
    """By hand: empty reads, reads without qualities, a group without a mate, and ten thousand equal reads in one group."""
    data = [("a", "GGCC", [10, 20, 30, 41]), ("a", "acgN", [3, 3, 3, 3]), ("a", "", []), ("a", None, None), ("b", "AT", None), ("c", None, None), *[("d", "ACG", [7, 8, 8])] * 10_000]
    df = spark.createDataFrame(data, "s string, seq string, qual array<short>")
    got = {r["s"]: r.asDict() for r in readmodels.read_report(df, "seq", "qual", ["s"]).collect()}
    assert set(got) == {"a", "b", "d"}
    a = got["a"]
    assert (a["reads"], a["total_bases"], a["min_length"], a["max_length"], a["mean_length"]) == (3, 8, 0, 4, 8 / 3)
    assert (a["mean_quality"], a["gc_content"], a["n_content"]) == (113 / 8, 6 / 8, 1 / 8)
    assert (a["quality_histogram"], a["gc_histogram"], a["length_histogram"]) == ({25: 1, 3: 1}, {100: 1, 50: 1}, {0: 1, 4: 2})
    assert (got["b"]["mean_quality"], got["b"]["quality_histogram"], got["b"]["length_histogram"]) == (None, {}, {2: 1})
    assert (got["d"]["reads"], got["d"]["quality_histogram"], got["d"]["gc_histogram"]) == (10_000, {8: 10_000}, {67: 10_000})
    assert readmodels.read_report(df.where("false"), "seq", "qual", ["s"]).count() == 0


def test_ranks_and_lineages(spark):
    df = spark.createDataFrame([("d__B; p__P; c__",), ("d__B; c__C",), ("",)], "taxonomy string")
    assert [tuple(r) for r in reference.ranks(df).select("domain", "phylum", "class").collect()] == [("B", "P", None), ("B", None, "C"), (None, None, None)]
    assert rows(reference.bad_lineages(df)) == [("",), ("d__B; c__C",)]


def test_minting_is_idempotent(spark):
    have = spark.createDataFrame([("a", 1), ("c", 2)], "k string, i long")
    want = spark.createDataFrame([("b",), ("a",), ("d",), ("b",), (None,)], "k string")
    first = reference.minted(have, want, "k", "i")
    assert rows(first) == [("a", 1), ("b", 3), ("d", 4)]
    assert rows(reference.minted(first, want, "k", "i")) == rows(first)


def test_dense_numbers(spark):
    df = spark.range(1000).withColumn("k", (F.col("id") * 7919 % 1000)).select("k")
    assert rows(reference.dense_numbers(df, "k", "n"), "k", "n") == [(i, i + 1) for i in range(1000)]


@pytest.mark.parametrize("n", [1, 3, 16])
def test_dense_numbers_with_payload(spark, n):
    """Ranges are cut once: rows with other columns get 1 … n in key order, whatever the number of ranges."""
    df = spark.range(100_000, numPartitions=5).select((F.col("id") * 7919 % 100_000).alias("k"), F.md5(F.col("id").cast("string")).alias("text"), F.rand(3).alias("x"))
    got = reference.dense_numbers(df, "k", "n", n)
    assert got.where("n <> k + 1").count() == 0 and got.count() == 100_000
    sums = reference.running(df.where("k < 1000"), "k", F.col("k"), "s", n)
    assert sums.where("s <> k * (k + 1) / 2").count() == 0


def test_minting_many(spark):
    want = spark.range(20_000).select(F.md5(F.col("id").cast("string")).alias("k"), F.col("id").alias("payload"))
    have = reference.dense_numbers(want.where("payload % 3 = 0"), "k", "i").select("k", "i")
    got = reference.minted(have, want, "k", "i").collect()
    ids = {r["k"]: r["i"] for r in got}
    assert sorted(ids.values()) == list(range(1, 20_001)) and all(ids[k] == i for k, i in rows(have))


def test_deep_clade(spark):
    chain = spark.range(1, 400).select(F.col("id").alias("n"), (F.col("id") - 1).alias("p"))
    assert rows(reference.descendants(chain, 100, "n", "p")) == [(i,) for i in range(100, 400)]
    circle = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (9, 9)], "n long, p long")
    assert rows(reference.descendants(circle, 2, "n", "p")) == [(1,), (2,), (3,)] and rows(reference.descendants(circle, 9, "n", "p")) == [(9,)]


def test_padding_keeps_one_row_per_feature(spark):
    tax = spark.createDataFrame([(1, "b", None), (1, "a", "z"), (2, "c", "d")], "f long, domain string, phylum string")
    got = rows(reference.padded(spark.createDataFrame([(1,), (2,), (3,)], "f long"), tax, "f").fillna("-"))
    assert got == [(1, "a", "z"), (2, "c", "d"), (3, "-", "-")]


def test_tree(spark):
    e = spark.createDataFrame([(2, 1), (3, 1), (4, 2), (5, 4)], "n long, p long")
    assert rows(reference.descendants(e, 2, "n", "p")) == [(2,), (4,), (5,)]
    assert (1, 5, 3) in rows(reference.closure(e, "n", "p", 3), "ancestor", "descendant", "distance")


def test_whole_closure(spark, tmp_path):
    orders = [*range(1, 80), 3000, 1500, 750, 375, 187, 93, 46, 2**40, 2**39]
    spark.createDataFrame([(i,) for i in orders], "o_orderkey long").write.parquet(str(tmp_path / "orders.parquet"))
    up = {i: i // 2 for i in orders}
    want = set()
    for i in up.keys() | set(up.values()):
        a, k = i, 0
        want.add((a, i, k))
        while up.get(a, a) != a:
            a, k = up[a], k + 1
            want.add((a, i, k))
    got = rows(catalogue.QUERIES["closure_distance"](spark, str(tmp_path)), "ancestor", "descendant", "distance")
    assert got == sorted(want) and max(k for *_, k in want) > 10
    circle = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 4), (5, 1), (5, 3)], "n long, p long")
    pairs = {(a, d): k for a, d, k in rows(reference.closure(circle, "n", "p"), "ancestor", "descendant", "distance")}
    assert pairs == {(a, d): (a - d) % 3 for a in (1, 2, 3) for d in (1, 2, 3)} | {(5, 5): 0, (1, 5): 1, (3, 5): 1, (2, 5): 2}
    assert reference.closure(circle.where("false"), "n", "p").count() == 0


def test_closure_of_one_parent_doubles(spark, monkeypatch):
    """A chain, a side branch and circles: rounds grow with the logarithm of the depth, and no pair is written."""
    names = []
    kept = reference.written
    monkeypatch.setattr(reference, "written", lambda df, what="t": names.append(what) or kept(df, what))
    up = {i: i - 1 for i in range(1, 101)} | {200: 40, 300: 301, 301: 302, 302: 300, 303: 302, 400: 400, 401: 402, 402: 401}
    want = set()
    for i in (up.keys() | set(up.values())) - {400}:
        seen = [i]
        while (a := up.get(seen[-1], seen[0])) not in seen:
            seen.append(a)
        want |= {(a, i, k) for k, a in enumerate(seen)}
    got = rows(reference.closure(spark.createDataFrame(list(up.items()), "n long, p long"), "n", "p"), "ancestor", "descendant", "distance")
    assert got == sorted(want)
    assert names.count("ways") == 7 and set(names) == {"edges", "last", "further", "ways"}


def test_planners(spark):
    for n, shards in ((7, 3), (2, 5), (50, 7), (0, 4)):
        got = [r["shard"] for r in planning.even_shards(spark.range(n), ["id"], shards).orderBy("id").collect()]
        assert got == sorted(got) and len(set(got)) == min(n, shards)
        sizes = [got.count(s) for s in set(got)]
        assert not sizes or max(sizes) - min(sizes) <= 1
    s = spark.createDataFrame([(1, 5), (2, 0), (3, 12)], "s long, n long")
    assert rows(planning.blocks(s, "s", "n", 8)) == [(1, 0, 1, 5), (3, 0, 1, 3), (3, 1, 4, 11), (3, 2, 12, 12)]
    for costs, budget in (([3, 9, 1, 0, 0, 25, 25, 0, 4, 4, 4], 10), ([0, 0, 0], 5), ([50], 5), ([], 5), ([1] * 40, 7)):
        df = spark.createDataFrame([(i, c) for i, c in enumerate(costs)], "k long, c long")
        want, part, full = [], -1, None
        for i, c in enumerate(costs):
            if full is None or full + c > budget:
                part, full = part + 1, 0
            full += c
            want.append((i, part))
        assert rows(planning.parts_by_budget(df, "k", "c", budget)) == want
    dear = spark.createDataFrame([(1, 4), (2, 5), (3, 10**12), (4, 3), (5, 3 * 10**8), (6, 10**12), (7, 6), (8, 5)], "k long, c long")
    assert rows(planning.parts_by_budget(dear, "k", "c", 10)) == [(1, 0), (2, 0), (3, 1), (4, 2), (5, 3), (6, 4), (7, 5), (8, 6)]
    packed = planning.parts_by_budget(spark.range(100).withColumn("c", F.col("id") % 10), "id", "c", 20)
    full = {}
    for k, p in rows(packed):
        full.setdefault(p, []).append(k)
    assert sorted(k for v in full.values() for k in v) == list(range(100))
    assert all(sum(k % 10 for k in v) <= 20 and v == list(range(v[0], v[0] + len(v))) for v in full.values())


def test_read_models(spark):
    df = spark.createDataFrame([(1, "x"), (1, "done"), (2, "x"), (3, None)], "k long, s string")
    got = readmodels.ladder(df, "k", [("completed", F.col("s") == "done"), ("in_flight", F.col("s") == "x")], "none")
    assert rows(got) == [(1, "completed"), (2, "in_flight"), (3, "none")]
    assert rows(readmodels.tally(got, ["completed", "none", "failed"])) == [(1, 1, 0)]
    assert len(rows(readmodels.page(spark.range(10), [F.desc("id")], 3))) == 4


def test_metadata(spark):
    df = spark.createDataFrame([(" 1.5 ", "numeric"), ("x", "numeric"), ("2024-02-30", "date"), ("2024-02-29", "date"), ("TRUE", "boolean"), ("1", "boolean"), (" t ", "text")], "v string, k string")
    got = [r[0] for r in df.select(metadata.decoded(F.col("v"), F.col("k"))).collect()]
    assert float(got[0]["number"]) == 1.5 and got[3]["date"] == datetime.date(2024, 2, 29) and got[4]["flag"] is True and got[6]["text"] == "t"
    assert [g["error"] is not None for g in got] == [False, True, True, False, False, True, False]


def test_metadata_keeps_every_number(spark):
    long = "1" * 40 + "." + "2" * 30
    cases = {"\u00a0\t12 \n": ("12", 12.0), long: (long, None), "0.1234567890123456789": ("0.1234567890123456789", None), "1.50000000000000000000": ("1.50000000000000000000", 1.5), "2e-3": ("2e-3", 0.002), "NaN": (None, None), "1,5": (None, None), "": (None, None)}
    df = spark.createDataFrame([(k,) for k in cases], "v string")
    for r in df.select("v", metadata.decoded(F.col("v"), F.lit("numeric")).alias("m")).collect():
        exact, number = cases[r["v"]]
        assert r["m"]["exact"] == exact and (r["m"]["number"] is None) == (number is None) and (r["m"]["error"] is None) == (exact is not None), r
        assert number is None or float(r["m"]["number"]) == number


def test_insert_takes_the_least_of_equal_keys(spark):
    t = spark.createDataFrame([(1, "a")], "k long, v string")
    fresh = spark.createDataFrame([(3, "z"), (3, "c"), (1, "b")], t.schema)
    assert rows(mutations.insert_missing(t, fresh, ["k"])) == [(1, "a"), (3, "c")]


def test_mutations(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    assert rows(mutations.insert_missing(t, spark.createDataFrame([(2, "z"), (3, "c")], t.schema), ["k"])) == [(1, "a"), (2, "b"), (3, "c")]
    assert rows(mutations.upsert(t, spark.createDataFrame([(2, "z")], t.schema), ["k"])) == [(1, "a"), (2, "z")]
    assert rows(mutations.update_from(t, spark.createDataFrame([(2, None)], t.schema), "k", "v")) == [(1, "a"), (2, None)]
    after, n = mutations.compare_and_set(t, F.col("k") == 1, "v", ["a"], "done")
    assert n == 1 and rows(after) == [(1, "done"), (2, "b")]
    assert mutations.compare_and_set(after, F.col("k") == 1, "v", ["a"], "done")[1] == 0
    m = spark.createDataFrame([({"a": "1", "b": "2"}, {"b": "3"}), (None, {"c": "4"})], "o map<string,string>, n map<string,string>")
    assert [r[0] for r in m.select(mutations.merged_map(F.col("o"), F.col("n"))).collect()] == [{"a": "1", "b": "3"}, {"c": "4"}]
    left = mutations.cascade(t.where("k = 1"), "k", {"child": (spark.createDataFrame([(1, 7), (2, 8)], "fk long, x long"), "fk")})
    assert rows(left["child"]) == [(2, 8)]


def test_alignment_slice(spark):
    data = [(1, 10, 20, "10=", "t"), (2, 10, 20, "2S10=", "t"), (3, 95, 105, "5=2I5=3S", "t"), (4, 200, 210, "10=", "t"), (5, 10, 22, "4=2D6=", "t"), (6, 14, 18, "4=", "t")]
    df = spark.createDataFrame(data, "k long, position long, stop_position long, cigar string, tag_md string")
    got = {r["k"]: tuple(r)[1:] for r in aln.sliced(df, 14, 100, ["tag_md"]).collect()}
    assert got == {1: (14, 20, "4H6=", None), 2: (14, 20, "6H6=", None), 3: (95, 100, "5=10H", None), 5: (16, 22, "4H6=", None), 6: (14, 18, "4=", "t")}


def test_array_slice_trim_rounds_single_floats(spark, tmp_path):
    """A thousandth of single precision that doubles would round the other way."""
    import duckdb

    from seqloom.plans import catalogue

    rows = [(8, [0.7674999833106995, 1.0, 2.0]), (12, [0.6065000295639038, 0.3894999921321869, 1.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = sorted(con.sql(catalogue.SQL["array_slice_trim"]).fetchall())
    assert sorted(map(tuple, catalogue.QUERIES["array_slice_trim"](spark, str(tmp_path)).collect())) == want == [(8, 768, 1), (12, 996 + 1000, 3)]


def test_feature_table_tasks_grow_with_alignments(spark, monkeypatch, capsys):
    from seqloom.operators import features

    monkeypatch.setattr(features, "TASK_ROWS", 10)
    hits = spark.createDataFrame([("s", i // 2, i % 2) for i in range(200)] + [("s", 0, 0)], "prep_sample_idx string, sequence_idx long, genome_idx int")
    got = features.fractional(hits, 201)
    assert rows(got) == [("s", 0, 50.0), ("s", 1, 50.0)]
    got.explain()
    assert "21), REPARTITION_BY_NUM" in capsys.readouterr().out
