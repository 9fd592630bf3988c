import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from seqloom.schemas import schema
from seqloom.sources import readers, sinks
from seqloom.sources.lake import Conflict, Lake
from seqloom.streaming import ingest

FASTQ = "".join(f"@r{i} c{i}\n{'ACGT' * 5}\n+\n{'I' * 20}\n" for i in range(4))


def test_fastq_round_trip(spark, tmp_path):
    (tmp_path / "a.fastq").write_text(FASTQ)
    (tmp_path / "b.fastq.gz").write_bytes(gzip.compress(FASTQ.encode()))
    df = readers.fastx_pair(spark, str(tmp_path / "a.fastq"), str(tmp_path / "b.fastq.gz"))
    got = df.orderBy("sequence_index").collect()
    assert [r["read_id"] for r in got] == ["r0", "r1", "r2", "r3"] and got[0]["qual1"] == [40] * 20 == got[0]["qual2"] and got[1]["comment"] == "c1"
    sinks.fastq(df.coalesce(1), str(tmp_path / "out"), mate=2)
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("part-*"))
    assert text.splitlines()[:2] == ["@r0", "ACGT" * 5] and len(text.splitlines()) == 16


def test_fasta(spark, tmp_path):
    (tmp_path / "x.fa").write_text(">a one two\nAC\nGT\n\n>b\nTTTT\n")
    got = readers.fastx(spark, str(tmp_path / "x.fa")).orderBy("sequence_index").collect()
    assert [(r["read_id"], r["comment"], r["sequence"], r["qual"]) for r in got] == [("a", "one two", "ACGT", None), ("b", None, "TTTT", None)]
    with pytest.raises(ValueError):
        list(readers.parse_fastx(["@a", "ACGT", "+", "II"]))
    (tmp_path / "y.fa").write_text(">b\nAC\n")
    with pytest.raises(ValueError, match="repeated"):
        readers.manifest(spark, [str(tmp_path / "x.fa"), str(tmp_path / "y.fa")])
    (tmp_path / "z.fa").write_text(">q\n>r\nAC\n")
    with pytest.raises(ValueError, match="empty"):
        readers.manifest(spark, [str(tmp_path / "z.fa")])


def test_gff(spark, tmp_path):
    (tmp_path / "x.gff").write_text("##gff-version 3\nc1\tp\tCDS\t5\t10\t.\t+\t0\tID=a;Dbxref=X:1,Y:2\n##FASTA\n>c1\nACGT\n")
    r = readers.gff(spark, str(tmp_path / "x.gff")).collect()
    assert len(r) == 1 and (r[0]["position"], r[0]["stop_position"], r[0]["score"], r[0]["attributes"]) == (5, 11, None, {"ID": "a", "Dbxref": "X:1,Y:2"})


def test_newick(spark, tmp_path):
    (tmp_path / "t.nwk").write_text("((a:1,'b c':2{7})x:0.5,d);")
    r = readers.newick(spark, str(tmp_path / "t.nwk")).orderBy("node_index").collect()
    assert [(x["name"], x["branch_length"], x["parent_index"], x["is_tip"], x["edge_id"]) for x in r] == [(None, None, None, False, None), ("x", 0.5, 0, False, None), ("a", 1.0, 1, True, None), ("b c", 2.0, 1, True, 7), ("d", None, 0, True, None)]


def test_jplace(spark, tmp_path):
    (tmp_path / "p.jplace").write_text('{"tree": "(a);", "fields": ["edge_num", "likelihood", "like_weight_ratio", "distal_length", "pendant_length"],\n "placements": [{"p": [[3, -1.5, 0.9, 0.1, 0.2]], "n": ["f1", "f2"]}, {"p": [[4, -2, 1, 0, 0]], "nm": [["g", 2]]}]}')
    r = readers.jplace(spark, str(tmp_path / "p.jplace")).orderBy("fragment").collect()
    assert [(x["fragment"], x["edge_num"], x["likelihood"]) for x in r] == [("f1", 3, -1.5), ("f2", 3, -1.5), ("g", 4, -2.0)]


def test_sam_tags_are_whole(spark, tmp_path):
    (tmp_path / "x.sam").write_text("r1\t0\tc\t10\t60\t2=\t*\t0\t0\tAC\tII\tMD:Z:" + "A" * ((1 << 20) + 9) + "\tNM:i:1\tCO:Z:\n")
    tags = readers.sam(spark, str(tmp_path / "x.sam")).first()["tags"]
    assert len(tags["MD"]) == (1 << 20) + 9 and tags["NM"] == "1" and tags["CO"] == ""


def test_sam(spark, tmp_path):
    (tmp_path / "x.sam").write_text("@HD\tVN:1.6\nr1\t0\tc\t10\t60\t3=1I2=\t*\t0\t0\tACGTAC\tIIIIII\tNM:i:1\tAS:i:-3\n")
    r = readers.sam(spark, str(tmp_path / "x.sam")).first()
    assert (r["position"], r["stop_position"], r["tags"]["NM"], r["mate_reference"]) == (10, 15, "1", "*")
    assert readers.sam_reads(spark, str(tmp_path / "x.sam")).first()["qual1"] == [40] * 6


def test_sam_reads(spark, tmp_path):
    """Mates meet, reverse strands are turned back, tags keep their case, repeats and aligned reads can be refused."""

    def written(*lines):
        (tmp_path / "m.sam").write_text("".join(f"{n}\t{f}\tc\t5\t60\t4=\t*\t0\t0\t{s}\t{q}\tXS:i:1\txs:i:2\n" for n, f, s, q in lines))
        return str(tmp_path / "m.sam")

    at = written(("a", 65, "AACG", "IIII"), ("a", 145, "AACC", "I???"), ("b", 16, "AACC", "I???"), ("b", 256, "GG", "II"), ("c", 4, "ACGT", "IIII"))
    got = {r["read_id"]: tuple(r)[1:] for r in readers.sam_reads(spark, at).collect()}
    assert got == {"a": ("AACG", [40] * 4, "GGTT", [30, 30, 30, 40]), "b": ("GGTT", [30, 30, 30, 40], None, None), "c": ("ACGT", [40] * 4, None, None)}
    assert readers.sam(spark, at).first()["tags"] == {"XS": "1", "xs": "2"}
    with pytest.raises(Exception, match="aligned"):
        readers.sam_reads(spark, at, unaligned=True).collect()
    assert [tuple(r)[::2] for r in readers.sam_reads(spark, written(("a", 77, "AC", "II"), ("a", 141, "GT", "II")), unaligned=True).collect()] == [("a", [40, 40], [40, 40])]
    for bad in ([("a", 4, "A", "I")] * 2, [("a", 77, "A", "I")], [("a", 77, "A", "I")] * 2):
        with pytest.raises(Exception, match="mates"):
            readers.sam_reads(spark, written(*bad), unaligned=True).collect()


def test_gff_attributes(spark, tmp_path):
    (tmp_path / "x.gff").write_text("c\tp\tCDS\t5\t10\t.\t+\t0\tID=a;Note=x%3By+z;Note=q;empty=;junk\nc\tp\tCDS\t5\t10\t.\t+\t0\n")
    at = str(tmp_path / "x.gff")
    assert [r["attributes"] for r in readers.gff(spark, at).collect()] == [{"ID": "a", "Note": "x%3By+z,q", "empty": ""}, {}]
    assert readers.gff(spark, at, decode=True).first()["attributes"]["Note"] == "x;y+z,q"
    (tmp_path / "y.gff").write_text("c\tp\tCDS\t5\n")
    with pytest.raises(Exception, match="not a whole feature"):
        readers.gff(spark, str(tmp_path / "y.gff")).collect()


def test_sinks_refuse_what_readers_would(spark, tmp_path):
    reads = spark.createDataFrame([("a", "ACG", [30, 30, 30]), ("b", "ACG", None)], "read_id string, sequence1 string, qual1 array<short>")
    with pytest.raises(Exception, match="qualities"):
        sinks.fastq(reads, str(tmp_path / "q1"))
    with pytest.raises(Exception, match="qualities"):
        sinks.fastq(reads.withColumn("qual1", F.array(F.lit(3).cast("short"))), str(tmp_path / "q2"))
    with pytest.raises(Exception, match="no sequence"):
        sinks.fasta(spark.createDataFrame([(1, None, None)], "feature_idx long, accession string, sequence string"), str(tmp_path / "f"))


def test_blob(spark):
    df = spark.createDataFrame([(1, "b"), (0, "a"), (2, "c")], "chunk_index int, chunk_data string")
    assert readers.blob(df).first()["data"] == "abc"
    with pytest.raises(ValueError):
        readers.blob(spark.range(1))


def test_sorted_parts_are_disjoint(spark, tmp_path):
    import pyarrow.parquet as pq

    sinks.parquet(spark.range(1000).withColumn("k", F.col("id") * 7 % 1000), str(tmp_path / "p"), sort=["k"], parts=4)
    spans = sorted((min(c), max(c)) for f in (tmp_path / "p").glob("*.parquet") if (c := pq.read_table(f)["k"].to_pylist()))
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))


def test_export_and_upload(spark, tmp_path):
    assert not sinks.export(spark.range(0), str(tmp_path / "none")) and not (tmp_path / "none").exists()
    assert sinks.export(spark.range(3), str(tmp_path / "some"))
    a = sinks.upload(spark.range(100).repartition(3), str(tmp_path / "u1"), ["id"]).first()
    b = sinks.upload(spark.range(100).repartition(7), str(tmp_path / "u2"), ["id"]).first()
    assert a == b and a["row_count"] == 100


def test_lake(spark, tmp_path):
    lake = Lake(spark, "file://" + str(tmp_path / "lake"))
    member = lambda *r: spark.createDataFrame(list(r), "reference_idx long, feature_idx long")
    assert lake.read("reference_membership").count() == 0
    lake.replace({"reference_membership": member((1, 10), (1, 11), (2, 11))})
    began = lake.versions()
    lake.append({"reference_sequences": spark.createDataFrame([(10, "h", 1), (11, "g", 2)], "feature_idx long, sequence_hash string, sequence_length_bp long")})
    with pytest.raises(Conflict):
        lake.replace({"reference_membership": member((3, 3))}, began)
    for t in ("reference_sequence_chunks", "reference_taxonomy", "reference_phylogeny", "reference_placements", "reference_annotation"):
        lake.replace({t: lake.read(t)})
    counts = lake.delete_reference(1)
    assert counts["reference_sequences"] == 1 and counts["reference_membership"] == 2
    assert [r[0] for r in lake.read("reference_sequences").select("feature_idx").collect()] == [11]
    assert lake.delete_reference(1)["reference_membership"] == 0
    assert lake.delete_where("reference_membership", F.col("feature_idx") == 11) == 1
    assert lake.delete_where("reference_membership", F.col("feature_idx") == 11) == 0
    with pytest.raises(ValueError):
        lake.register({"reference_membership": str(tmp_path / "a" / ".." / "b")})


def test_lake_changes_are_whole(spark, tmp_path):
    """Readers between the steps of a commit see the old version, one of two writers wins, null keys stay, files without doomed rows aren't touched."""
    lake = Lake(spark, "file://" + str(tmp_path / "lake"))
    member = lambda *r: spark.createDataFrame(list(r), "reference_idx long, feature_idx long")
    lake.replace({"reference_membership": member((1, 10), (None, 12), (2, 11))})
    seen, publish = [], lake._publish

    def watched(*a):
        seen.append(sorted(map(tuple, Lake(spark, lake.root).read("reference_membership").collect()), key=str))
        publish(*a)
        seen.append(Lake(spark, lake.root).read("reference_membership").count())

    lake._publish = watched
    lake.append({"reference_membership": member((5, 50), (6, 60))})
    assert [len(seen[0]), seen[1]] == [3, 5]
    before = lake.contents()["reference_membership"]
    # a second writer that began from the same version loses and leaves nothing in the lake
    other = Lake(spark, lake.root)
    v, contents = other.version(), other.contents()
    lake.append({"reference_exclusion": spark.createDataFrame([(1,)], "feature_idx long")})
    with pytest.raises(Conflict):
        other._publish(v, contents)
    assert lake.version() == v + 1
    assert lake.delete_reference(1)["reference_membership"] == 1
    left = sorted((tuple(r) for r in lake.read("reference_membership").collect()), key=str)
    assert left == [(2, 11), (5, 50), (6, 60), (None, 12)]
    after = lake.contents()["reference_membership"]
    assert set(before[-2:]) <= set(after)  # what was appended is still where it was
    assert lake.delete_where("reference_membership", F.col("feature_idx") == 60) == 1 and lake.read("reference_membership").count() == 3
    assert lake.read("reference_membership", v).count() == 5
    assert lake.vacuum() > 0 and lake.read("reference_membership").count() == 3 and lake.vacuum() == 0


def test_lake_named_deletes(spark, tmp_path):
    lake = Lake(spark, "file://" + str(tmp_path / "lake"))
    mask = [(m, p, s, "pass", 0, 0, None, None) for m in (1, 2) for p in (1, 2, 3) for s in range(10)]
    reads = [(p, s, "r", "A", None, None, None) for p in (1, 2, 3) for s in range(10)]
    lake.replace({"read_mask": spark.createDataFrame(mask, schema("read_mask")), "read": spark.createDataFrame(reads, schema("read"))})
    assert lake.delete_block("read_mask", "mask_idx", 1, [(1, 2, 4), (1, 3, 5), (3, 9, 20)]) == 5 and lake.delete_block("read_mask", "mask_idx", 1, []) == 0
    assert lake.delete_mask(2) == 30 and lake.delete_mask(2) == 0 and lake.read("read_mask").count() == 25
    assert lake.delete_pool_reads([]) == {"read": 0, "read_mask": 0}
    v = lake.version()
    assert lake.delete_pool_reads([1, 9]) == {"read": 10, "read_mask": 6} and lake.version() == v + 1
    assert sinks.export_sample(lake.read, 2, str(tmp_path / "x")) == 10 and sinks.export_sample(lake.read, 2, str(tmp_path / "x")) == 10
    assert spark.read.parquet(str(tmp_path / "x")).columns == ["prep_sample_idx", "sequence_idx", "read_id", "sequence1", "qual1", "sequence2", "qual2"]
    assert sinks.export_sample(lake.read, 1, str(tmp_path / "y")) == 0 and not (tmp_path / "y").exists() and not (tmp_path / "y.partial").exists()


def test_parts_receipt_and_mates(spark, tmp_path):
    df = spark.range(60).select("id", (F.col("id") % 7).alias("c"))
    sinks.multi_part(df, str(tmp_path / "m"), "id", "c", 20)
    back = spark.read.parquet(str(tmp_path / "m"))
    assert back.count() == 60 and back.groupBy("part").agg(F.sum("c").alias("c")).where("c > 20").count() == 0
    df.coalesce(1).write.parquet(str(tmp_path / "u"))
    (file,) = (tmp_path / "u").glob("*.parquet")
    got = sinks.receipt(spark, str(tmp_path / "u")).first()
    want = hashlib.sha256(hashlib.sha256(file.read_bytes()).hexdigest().encode()).hexdigest()
    assert (got["row_count"], got["bytes"], got["sha256"]) == (60, file.stat().st_size, want)
    mates = spark.createDataFrame([("a", "AC", [40, 40], "GG", [30, 31])], "read_id string, sequence1 string, qual1 array<short>, sequence2 string, qual2 array<short>")
    sinks.fastq_pair(mates, str(tmp_path / "s_{ORIENTATION}"))
    text = lambda d: "".join(p.read_text() for p in (tmp_path / d).glob("part-*"))
    assert text("s_R1") == "@a\nAC\n+\nII\n" and text("s_R2") == "@a\nGG\n+\n?@\n"
    assert [r[0] for r in sinks.sam_header(spark.createDataFrame([("b", 5), ("a", 9)], "reference string, length long")).collect()] == ["@HD\tVN:1.6\tSO:coordinate", "@SQ\tSN:a\tLN:9", "@SQ\tSN:b\tLN:5"]


def test_stream_drops_keys_of_earlier_batches(spark, tmp_path):
    src, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    for part in ([(1, "a"), (2, "b")], [(2, "b"), (3, "c")], [(1, "a")]):
        spark.createDataFrame(part, "k long, v string").coalesce(1).write.mode("append").parquet(src)
        ingest.ingest(ingest.read_files(spark, src, "k long, v string", 1), out, check, ["k"]).awaitTermination()
    assert sorted(r["k"] for r in spark.read.parquet(out).collect()) == [1, 2, 3]


def test_stream(spark, tmp_path):
    src, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "k long, v string").write.parquet(src)
    for _ in range(2):
        ingest.ingest(ingest.read_files(spark, src, "k long, v string"), out, check, ["k"]).awaitTermination()
    assert spark.read.parquet(out).count() == 2


def test_parquet_sizes(spark, tmp_path):
    spark.range(1000).repartition(3).write.parquet(str(tmp_path / "p"))
    sizes = readers.parquet_sizes(spark, str(tmp_path / "p"))
    assert len(sizes) == 3 and sum(r for _, r, _ in sizes) == 1000 and all(b > 0 for _, _, b in sizes)


def test_ranges_grow_with_the_table(spark, tmp_path, monkeypatch):
    """A sorted write takes more parts for more rows; parts are read again as one text with one numbering."""
    from pyspark.sql import functions as F

    from seqloom.sources import readers

    monkeypatch.setattr(sinks, "PART_BYTES", 2000)
    df = spark.range(1000).select(F.col("id"), F.format_string("r%d", "id").alias("read_id"), F.lit("ACGT").alias("sequence1"), F.array(*[F.lit(31).cast("short")] * 4).alias("qual1"))
    dealt = sinks.ranged(df.orderBy(F.desc("id")), "id", least=3)
    assert dealt.rdd.getNumPartitions() > 20
    sinks.parquet(df, str(tmp_path / "p"), sort=["id"], parts=4)
    assert len(list((tmp_path / "p").glob("*.parquet"))) > 20
    sinks.fastq(dealt, str(tmp_path / "reads"))
    back = readers.fastx(spark, str(tmp_path / "reads"), chained=True)
    assert sorted((r["sequence_index"], r["read_id"]) for r in back.collect()) == [(k + 1, f"r{k}") for k in range(1000)]
    assert back.select("file").distinct().count() == 1


def test_chained_newick_with_a_wide_node(spark, tmp_path, monkeypatch):
    from seqloom.plans import catalogue, files

    monkeypatch.setattr(sinks, "PART_BYTES", 500)
    monkeypatch.setattr(files, "WIDE", 10)
    lines = [(o, n) for o in range(60) for n in range(1, 1 + o % 4 + (o == 7) * 30)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = sorted(((r["name"], r["parent"]) for r in catalogue.QUERIES["newick_ranges"](spark, str(tmp_path)).collect()), key=repr)
    tips = [(f"{o}.{n}", f"o{o}") for o, n in lines]
    assert got == sorted([*tips, *((f"o{o}", "root") for o in {o for o, _ in lines}), ("end", "root"), ("root", None)], key=repr)
