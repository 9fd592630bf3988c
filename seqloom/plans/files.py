"""Registered queries that go through files: each writes with a sink, reads with a reader, and must give the table's rows again."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.sequence import reverse_complement
from ..session import shared_dir, written
from ..sources import arrow_io, readers, sinks
from ..sources.lake import Lake
from ..streaming import ingest
from .catalogue import query, t


def _at(spark, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def _bases(text):
    """32 letters of a text's MD5."""
    return F.translate(F.md5(text), "0123456789abcdef", "ACGTACGTACGTACGT")


_BASES = "translate(md5({}), '0123456789abcdef', 'ACGTACGTACGTACGT')"


@query("SELECT p_partkey, p_name, p_size FROM part")
def tsv_read(spark, sf):
    at = _at(spark, "tsv")
    t(spark, sf, "part").select("p_partkey", "p_name", "p_size").write.csv(at, sep="\t", header=True)
    return readers.tsv(spark, at, "p_partkey long, p_name string, p_size int")


@query("SELECT count(*) AS row_count, 'o_orderkey,o_custkey' AS column_names FROM orders")
def parquet_footers(spark, sf):
    """Rows by the files' footers, and the columns; no row is read."""
    at = _at(spark, "footers")
    sinks.parquet(t(spark, sf, "orders").select("o_orderkey", "o_custkey"), at)
    names = ",".join(readers.column_names(readers.parquet(spark, at)))
    sizes = spark.createDataFrame(readers.parquet_sizes(spark, at), "file string, n long, bytes long")
    return sizes.agg(F.sum("n").alias("row_count")).withColumn("column_names", F.lit(names))


@query(f"""SELECT 'p' || p_partkey AS read_id, {_BASES.format('p_name')} AS sequence1, reverse({_BASES.format('p_name')}) AS sequence2,
                  CAST(20 + p_partkey % 10 AS SMALLINT) AS quality, 32 AS qualities FROM part""")
def fastq_pair_read(spark, sf):
    """Parts as read pairs; the two files of a pair are one file each, since mates meet by their place."""
    at = _at(spark, "fastq") + "-{ORIENTATION}"
    one = _bases(F.col("p_name"))
    qual = F.array_repeat((F.col("p_partkey") % 10 + 20).cast("short"), 32)
    rows = t(spark, sf, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("read_id"), one.alias("sequence1"), qual.alias("qual1"), F.reverse(one).alias("sequence2"), qual.alias("qual2"))
    sinks.fastq_pair(rows.coalesce(1), at)
    back = readers.fastx_pair(spark, at.replace("{ORIENTATION}", "R1"), at.replace("{ORIENTATION}", "R2"))
    return back.select("read_id", "sequence1", "sequence2", F.array_max("qual1").alias("quality"), F.size("qual2").alias("qualities"))


@query(f"SELECT 'feature_' || p_partkey AS read_id, {_BASES.format('p_name')} AS sequence FROM part")
def manifest_read(spark, sf):
    """Parts as FASTA records without names of their own; empty and repeated records would be refused."""
    at = _at(spark, "manifest")
    rows = t(spark, sf, "part").select(F.col("p_partkey").alias("feature_idx"), F.lit(None).cast("string").alias("accession"), _bases(F.col("p_name")).alias("sequence"))
    sinks.fasta(rows, at, gzip=True)
    return readers.manifest(spark, [at]).select("read_id", "sequence")


_SAM = f"""SELECT l_orderkey || '.' || l_linenumber AS read_id, CAST(CASE WHEN l_linenumber % 2 = 0 THEN 256 ELSE 0 END AS INT) AS flags, 'f' || l_partkey AS reference,
                  l_suppkey AS position, l_partkey % 90 + 10 AS e, l_orderkey % 4 AS d, {_BASES.format("CAST(l_orderkey AS VARCHAR)")} AS sequence FROM lineitem"""


def _sam_written(spark, sf) -> str:
    at = _at(spark, "sam")
    text = lambda c: F.col(c).cast("string")
    rows = t(spark, sf, "lineitem").select(
        F.concat_ws(".", text("l_orderkey"), text("l_linenumber")).alias("read_id"), F.when(F.col("l_linenumber") % 2 == 0, 256).otherwise(0).alias("flags"), F.concat(F.lit("f"), text("l_partkey")).alias("reference"),
        F.col("l_suppkey").alias("position"), F.lit(60).alias("mapq"), F.concat((F.col("l_partkey") % 90 + 10).cast("string"), F.lit("="), (F.col("l_orderkey") % 4).cast("string"), F.lit("D3S")).alias("cigar"),
        F.lit("*").alias("mate_reference"), F.lit(0).alias("mate_position"), F.lit(0).alias("template_length"), _bases(text("l_orderkey")).alias("sequence"), F.repeat(F.lit("I"), 32).alias("quality"))
    sinks.sam(rows, at)
    return at


@query(f"SELECT read_id, flags, reference, position, position + e + d AS stop_position, e || '=' || d || 'D3S' AS cigar, sequence FROM ({_SAM})")
def sam_alignments(spark, sf):
    return readers.sam(spark, _sam_written(spark, sf)).select("read_id", "flags", "reference", "position", "stop_position", "cigar", "sequence")


@query(f"SELECT read_id, sequence AS sequence1, CAST(40 AS SMALLINT) AS quality, 32 AS qualities FROM ({_SAM}) WHERE flags = 0")
def sam_primary_reads(spark, sf):
    return readers.sam_reads(spark, _sam_written(spark, sf)).select("read_id", "sequence1", F.array_min("qual1").alias("quality"), F.size("qual1").alias("qualities"))


@query("""SELECT 'c' || p_partkey % 9 AS seqid, CASE WHEN p_size % 2 = 0 THEN 'CDS' ELSE 'gene' END AS type, p_partkey AS position, p_partkey + p_size + 1 AS stop_position,
                 CASE WHEN p_size % 3 = 0 THEN NULL ELSE '+' END AS strand, 'part' || p_partkey AS id, p_name AS name FROM part""")
def gff3_features(spark, sf):
    at = _at(spark, "gff")
    text = lambda c: F.col(c).cast("string")
    line = F.concat_ws(
        "\t", F.concat(F.lit("c"), (F.col("p_partkey") % 9).cast("string")), F.lit("own"), F.when(F.col("p_size") % 2 == 0, "CDS").otherwise("gene"), text("p_partkey"), (F.col("p_partkey") + F.col("p_size")).cast("string"),
        F.lit("."), F.when(F.col("p_size") % 3 == 0, ".").otherwise("+"), F.lit("."), F.concat(F.lit("ID=part"), text("p_partkey"), F.lit(";Name="), F.col("p_name")))
    t(spark, sf, "part").select(line.alias("value")).write.text(at)
    return readers.gff(spark, at).select("seqid", "type", "position", "stop_position", "strand", F.col("attributes")["ID"].alias("id"), F.col("attributes")["Name"].alias("name"))


@query("""SELECT 'n' || n_nationkey AS name, 'r' || n_regionkey AS parent, n_nationkey + 0.5::DOUBLE AS branch_length, true AS is_tip FROM nation
          UNION ALL SELECT DISTINCT 'r' || n_regionkey, 'root', n_regionkey + 0.25::DOUBLE, false FROM nation UNION ALL SELECT 'root', NULL, NULL, false""")
def newick_tree(spark, sf):
    """Nations under their regions as one tree."""
    at = _at(spark, "newick")
    tip = F.format_string("n%d:%.1f", "n_nationkey", F.col("n_nationkey") + 0.5)
    clades = t(spark, sf, "nation").groupBy("n_regionkey").agg(F.array_join(F.collect_list(tip), ",").alias("tips"))
    inner = F.format_string("(%s)r%d:%.2f", "tips", "n_regionkey", F.col("n_regionkey") + 0.25)
    clades.agg(F.concat(F.lit("("), F.array_join(F.collect_list(inner), ","), F.lit(")root;")).alias("value")).write.text(at)
    tree = readers.newick(spark, at)
    above = tree.select(F.col("node_index").alias("parent_index"), F.col("name").alias("parent"))
    return tree.join(above, "parent_index", "left").select("name", "parent", "branch_length", "is_tip")


@query("SELECT 'f' || n_nationkey AS fragment, n_nationkey AS edge_num, -1.5::DOUBLE * n_nationkey AS likelihood, 0.5::DOUBLE AS like_weight_ratio, 0.25::DOUBLE AS distal_length, 0.125::DOUBLE AS pendant_length FROM nation")
def jplace_placements(spark, sf):
    """A placement for each nation; the file lists its fields in an order of its own."""
    at = _at(spark, "jplace")
    place = F.format_string('{"p": [[0.25, %d, 0.5, %s, 0.125]], "n": ["f%d"]}', "n_nationkey", (F.col("n_nationkey") * -1.5).cast("string"), "n_nationkey")
    head = '{"fields": ["distal_length", "edge_num", "like_weight_ratio", "likelihood", "pendant_length"], "placements": ['
    t(spark, sf, "nation").agg(F.concat(F.lit(head), F.array_join(F.collect_list(place), ", "), F.lit("]}")).alias("value")).write.text(at)
    return readers.jplace(spark, at)


@query("""SELECT '{"o_orderstatus":"' || o_orderstatus || '","n":' || count(*) || '}' AS report FROM orders GROUP BY o_orderstatus""")
def json_reports(spark, sf):
    return sinks.json_report(t(spark, sf, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n")))


@query("SELECT count(*) AS row_count, true AS same_count, true AS has_bytes, 64 AS digest_length FROM orders")
def upload_receipt(spark, sf):
    """An upload and its receipt: rows as counted by both, bytes and a digest of the files."""
    at = _at(spark, "upload")
    own = sinks.upload(t(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), at, ["o_orderkey"]).select(F.col("row_count").alias("own"))
    got = sinks.receipt(spark, at).crossJoin(own)  # one row by one row
    return got.select("row_count", (F.col("row_count") == F.col("own")).alias("same_count"), (F.col("bytes") > 0).alias("has_bytes"), F.length("sha256").alias("digest_length"))


@query("SELECT count(*) AS row_count, CAST(0 AS BIGINT) AS overlapping FROM lineitem")
def sorted_sink(spark, sf):
    """Files of a sorted write hold disjoint ranges, so that statistics prune."""
    at = _at(spark, "sorted")
    keys = ["l_suppkey", "l_orderkey", "l_linenumber"]
    sinks.parquet(t(spark, sf, "lineitem").select(*keys), at, sort=keys, parts=4)
    rows = readers.parquet(spark, at).select("*", F.col("_metadata.file_path").alias("file"))
    files = rows.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    low = high = F.lit(True)
    for k in keys:  # the least and the greatest key one column after the other: no row is sorted, and a task keeps a row per file
        files = written(files, "files")
        ends = rows.join(F.broadcast(files), "file").groupBy("file").agg(F.min(F.when(low, F.col(k))).alias(f"low_{k}"), F.max(F.when(high, F.col(k))).alias(f"high_{k}"))
        files = files.join(ends, "file")
        low, high = low & (F.col(k) == F.col(f"low_{k}")), high & (F.col(k) == F.col(f"high_{k}"))
    files = written(files.select("file", "n", F.struct(*[f"low_{k}" for k in keys]).alias("low"), F.struct(*[f"high_{k}" for k in keys]).alias("high")), "files")
    a, b = files.select("file", "low", "high"), files.select(F.col("file").alias("other"), F.col("low").alias("low2"), F.col("high").alias("high2"))
    clashes = a.join(b, (F.col("file") < F.col("other")) & (F.col("low") <= F.col("high2")) & (F.col("low2") <= F.col("high"))).agg(F.count(F.lit(1)).alias("overlapping"))  # a row per file
    return files.agg(F.sum("n").alias("row_count")).crossJoin(clashes)  # one row by one row


@query("SELECT count(*) AS row_count, CAST(0 AS BIGINT) AS over_budget FROM part")
def multi_part_sink(spark, sf):
    """Parts in folders that hold at most 2,000 letters of names each."""
    at = _at(spark, "parts")
    sinks.multi_part(t(spark, sf, "part").select("p_partkey", "p_name", F.length("p_name").cast("long").alias("cost")), at, "p_partkey", "cost", 2000)
    each = readers.parquet(spark, at).groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("cost").alias("cost"))
    return each.agg(F.sum("n").alias("row_count"), F.count_if(F.col("cost") > 2000).alias("over_budget"))


#: Children from which on a node's row is broadcast, a row for each so many nodes at most.
WIDE = 100_000

_LINE = "l_orderkey || '.' || l_linenumber"


def _line_name():
    return F.concat_ws(".", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))


@query(f"""SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber) AS sequence_index, {_LINE} AS read_id, {_BASES.format(_LINE)} AS sequence, CAST(31 + l_linenumber % 2 * 9 AS SMALLINT) AS quality
           FROM lineitem""")
def fastq_ranges(spark, sf):
    """Lines of orders as reads, written in ranges and read as one text in byte ranges; all qualities of a read are @ or all are I, so many lines begin like headers."""
    at = _at(spark, "reads")
    qual = F.array_repeat((F.col("l_linenumber") % 2 * 9 + 31).cast("short"), 32)
    rows = t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", _line_name().alias("read_id"), _bases(_line_name()).alias("sequence1"), qual.alias("qual1"))
    sinks.fastq(sinks.ranged(rows, "l_orderkey", "l_linenumber", least=2), at)
    return readers.fastx(spark, at, chained=True).select("sequence_index", "read_id", "sequence", F.array_max("qual").alias("quality"))


@query(f"""SELECT {_LINE} AS name, 'o' || l_orderkey AS parent, l_linenumber + 0.5::DOUBLE AS branch_length, true AS is_tip FROM lineitem
           UNION ALL SELECT 'o' || l_orderkey, 'root', count(*) + 0.25::DOUBLE, false FROM lineitem GROUP BY l_orderkey UNION ALL SELECT 'end', 'root', 1::DOUBLE, true UNION ALL SELECT 'root', NULL, NULL, false""")
def newick_ranges(spark, sf):
    """A tree of orders and their lines, written in ranges of orders and read as one text that is cut at commas."""
    at = _at(spark, "tree")
    tip = F.concat(_line_name(), F.format_string(":%.1f", F.col("l_linenumber") + 0.5))
    clades = t(spark, sf, "lineitem").select("l_orderkey", tip.alias("tip")).groupBy("l_orderkey").agg(F.concat(F.lit("("), F.array_join(F.collect_list("tip"), ","), F.format_string(")o%d:%.2f", "l_orderkey", F.count(F.lit(1)) + 0.25)).alias("value"))
    head = clades.agg(F.min("l_orderkey").alias("least"))  # one row
    opened = clades.join(F.broadcast(head), F.col("l_orderkey") == F.col("least"), "left").select("l_orderkey", F.when(F.col("least").isNotNull(), F.concat(F.lit("("), "value")).otherwise(F.col("value")).alias("value"))
    last = spark.range(1).select(F.lit(2**62).alias("l_orderkey"), F.lit("end:1)root;").alias("value"))
    sinks.ranged(opened.union(last), "l_orderkey", least=2).select("value").write.option("lineSep", ",").text(at)
    tree = written(readers.newick(spark, at, chained=True), "tree")
    above = tree.where("not is_tip").select(F.col("node_index").alias("parent_index"), F.col("name").alias("parent"))
    # the root has all orders under it: a node with that many is broadcast, so that its children needn't meet in one task
    wide = written(tree.groupBy("parent_index").count().where(F.col("count") > WIDE).join(above, "parent_index").select("parent_index", "parent"), "wide")
    rest = tree.join(F.broadcast(wide), "parent_index", "left_anti").join(above, "parent_index", "left")
    return tree.join(F.broadcast(wide), "parent_index").unionByName(rest).select("name", "parent", "branch_length", "is_tip")


@query(f"""SELECT 'p' || p_partkey AS read_id, {_BASES.format("p_name")} AS sequence1, CASE WHEN p_partkey % 3 > 0 THEN {_BASES.format("p_brand")} END AS sequence2,
                  CAST(40 AS SMALLINT) AS first_quality, CAST(CASE WHEN p_partkey % 3 > 0 THEN 30 END AS SMALLINT) AS last_quality, 3 AS both_tags FROM part""")
def sam_mates(spark, sf):
    """Parts as single reads and pairs, the second mates aligned to the reverse strand and so turned in the file; tags differ in case only."""
    at = _at(spark, "mates")
    name = F.concat(F.lit("p"), F.col("p_partkey").cast("string"))
    line = lambda flags, seq, qual: F.concat_ws("\t", name, F.lit(str(flags)), F.lit("c\t5\t60\t32=\t*\t0\t0"), seq, qual, F.lit("XS:i:1\txs:i:2")).alias("value")
    rows, paired = t(spark, sf, "part"), F.col("p_partkey") % 3 > 0
    own, mate, quality = _bases(F.col("p_name")), reverse_complement(_bases(F.col("p_brand"))), F.lit("I" + "?" * 31)
    rows.where(~paired).select(line(0, own, quality)).union(rows.where(paired).select(line(65, own, quality))).union(rows.where(paired).select(line(145, mate, F.reverse(quality)))).write.text(at)
    tags = readers.sam(spark, at).where("flags < 128").select("read_id", (F.col("tags")["XS"].cast("int") + F.col("tags")["xs"].cast("int")).alias("both_tags"))
    got = readers.sam_reads(spark, at).join(tags, "read_id")
    return got.select("read_id", "sequence1", "sequence2", F.get("qual1", F.lit(0)).alias("first_quality"), F.get("qual2", F.lit(31)).alias("last_quality"), "both_tags")


@query("SELECT 'part' || p_partkey AS id, p_brand || ',' || p_type AS notes, p_name || ';' || p_size AS name FROM part")
def gff3_attributes(spark, sf):
    """Features with an attribute that comes twice and one whose value holds an escaped semicolon."""
    at = _at(spark, "gff")
    text = lambda c: F.col(c).cast("string")
    line = F.concat(F.lit("c\town\tgene\t1\t9\t.\t+\t.\tID=part"), text("p_partkey"), F.lit(";Note="), "p_brand", F.lit(";Name="), "p_name", F.lit("%3B"), text("p_size"), F.lit(";Note="), "p_type")
    t(spark, sf, "part").select(line.alias("value")).write.text(at)
    of = readers.gff(spark, at, decode=True).select("attributes")
    return of.select(*[F.col("attributes")[k].alias(n) for k, n in (("ID", "id"), ("Note", "notes"), ("Name", "name"))])


@query("""SELECT l_suppkey AS prep_sample_idx, l_orderkey * 8 + l_linenumber AS sequence_idx FROM lineitem
          WHERE l_suppkey = 3 AND l_orderkey * 8 + l_linenumber BETWEEN 100 AND 90000 OR l_suppkey = 7 OR l_suppkey = 9 AND l_orderkey * 8 + l_linenumber <= 40000""")
def lake_block_read(spark, sf):
    """A block of three samples from a lake whose files hold ranges of samples: only files that meet it are opened."""
    lake = Lake(spark, _at(spark, "lake"))
    null = lambda kind: F.lit(None).cast(kind)
    rows = t(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("prep_sample_idx"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("sequence_idx"), _line_name().alias("read_id"), _bases(_line_name()).alias("sequence1"),
        null("array<short>").alias("qual1"), null("string").alias("sequence2"), null("array<short>").alias("qual2"))
    lake.append({"read": sinks.ranged(rows, "prep_sample_idx", "sequence_idx", least=8)})
    return lake.read_block("read", [(3, 100, 90_000), (7, 0, 1 << 60), (9, 0, 40_000)]).select("prep_sample_idx", "sequence_idx")


@query("SELECT event_id, user_id FROM events")
def stream_ingest(spark, sf):
    """Events that arrive in two lots, half of them in both; each key is taken in once."""
    at, out, mark = (_at(spark, x) for x in ("arriving", "taken", "progress"))
    rows = t(spark, sf, "events").select("event_id", "user_id")
    for lot in (rows.where("event_id % 4 < 3"), rows.where("event_id % 4 > 0")):
        lot.write.mode("append").parquet(at)
        ingest.ingest(ingest.read_files(spark, at, "event_id long, user_id long"), out, mark, ["event_id"]).awaitTermination()
    return spark.read.parquet(out).select("event_id", "user_id")


@query("""SELECT h AS start, h + INTERVAL 1 hour AS "end", event_type, count(*) AS n FROM (SELECT time_bucket(INTERVAL 1 hour, ts) AS h, event_type FROM events)
          WHERE h + INTERVAL 1 hour <= (SELECT max(ts) FROM events) - INTERVAL 2 hour GROUP BY h, event_type""")
def stream_windows(spark, sf):
    """Events by hour and kind as a stream; the hours for which no more rows are waited for."""
    at, out, mark = (_at(spark, x) for x in ("arriving", "windows", "progress"))
    t(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type").write.parquet(at)
    counts = ingest.windowed_counts(ingest.read_files(spark, at, "ts timestamp, event_type string"), "ts", "event_type")
    ingest.finished_windows(counts, out, mark).awaitTermination()
    ntz = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    return spark.read.schema("start timestamp, end timestamp, event_type string, n long").parquet(out).select(ntz("start"), ntz("end"), "event_type", "n")


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate FROM orders")
def arrow_stream_read(spark, sf):
    """Orders as Arrow streams, each read by a task of its own."""
    at = _at(spark, "streams")
    rows = t(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    arrow_io.write_streams(rows.repartition(6, "o_orderkey"), at)
    return arrow_io.arrow_streams(spark, rows.schema, at, rows=1000)


@query("SELECT count(*) AS row_count, true AS same_rows, true AS same_bytes, true AS same_digest, CAST(sum(l_orderkey * l_linenumber) AS BIGINT) AS keys FROM lineitem")
def reported_upload(spark, sf):
    """Lines of orders written by tasks that count and hash as they write; beside a count and hash of the files."""
    at = _at(spark, "reported")
    told = arrow_io.reported(t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"), at)
    keys = spark.read.parquet(at).agg(F.sum(F.col("l_orderkey") * F.col("l_linenumber")).alias("keys"))
    again = sinks.receipt(spark, at).crossJoin(keys)  # one row by one row
    return again.select(
        "row_count", (F.col("row_count") == told["row_count"]).alias("same_rows"), (F.col("bytes") == told["bytes"]).alias("same_bytes"),
        (F.col("sha256") == told["sha256"]).alias("same_digest"), "keys")
