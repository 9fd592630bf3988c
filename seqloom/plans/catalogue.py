"""The registered queries over the driver's tables, each beside the SQL that must give the same rows.

``orders``, ``lineitem`` and the others stand in for the lake's tables: a supplier for a sample, an
order for a read, a part for a feature, and so on; each query says which.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import alignment as aln
from ..functions import metadata, qc, sequence
from ..operators import alignment, coverage, features, masks, mutations, planning, readmodels, reference, slices
from ..schemas import schema
from ..session import shared_dir
from ..sources.lake import Lake

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# slices ------------------------------------------------------------------------------------------

ORDERS_SURFACE = slices.Surface(("o_custkey", "o_orderkey"), ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"), needs_filter=True)


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders WHERE o_custkey IN (1, 2, 3, 5, 8, 13, 21, 34, 55, 89)")
def slice_in_filter(spark, sf):
    return slices.build(t(spark, sf, "orders"), ORDERS_SURFACE, {"o_custkey": [1, 2, 3, 5, 8, 13, 21, 34, 55, 89]})


@query("SELECT p.p_partkey, p.p_name, p.p_brand FROM part p JOIN lineitem l ON p.p_partkey = l.l_partkey WHERE l.l_suppkey IN (1, 7, 9)")
def slice_membership_join(spark, sf):
    part = t(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_brand")
    return slices.scoped(part, t(spark, sf, "lineitem"), "l_partkey", "l_suppkey", [1, 7, 9]).withColumnRenamed("l_partkey", "p_partkey")


MEMBERS = [(1, 1, 4000), (2, 500, 9000), (3, 100, 15000), (7, 2000, 2500)]
_BLOCK = " OR ".join(f"(l_suppkey = {o} AND l_orderkey BETWEEN {a} AND {b})" for o, a, b in MEMBERS)


@query(f"SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey FROM lineitem WHERE {_BLOCK}")
def block_selector(spark, sf):
    return slices.block(t(spark, sf, "lineitem"), MEMBERS, "l_suppkey", "l_orderkey").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")


@query("""SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
          WHERE l_orderkey BETWEEN s_suppkey * 10 AND s_suppkey * 10 + 3000""")
def block_range_join(spark, sf):
    members = t(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), (F.col("s_suppkey") * 10).alias("a"), (F.col("s_suppkey") * 10 + 3000).alias("b"))
    return slices.block_join(t(spark, sf, "lineitem"), members, "l_suppkey", "l_orderkey", "a", "b").select("l_orderkey", "l_linenumber", "l_suppkey")


@query("""SELECT l.l_orderkey, l.l_linenumber, p.p_partkey FROM lineitem l JOIN part p ON l.l_suppkey = p.p_partkey % 9 + 1
          AND l.l_orderkey BETWEEN p.p_partkey * 3 AND p.p_partkey * 3 + p.p_size * p.p_size * p.p_size""")
def interval_join(spark, sf):
    """Members that overlap, of very different lengths, all of nine owners."""
    key, size = F.col("p_partkey"), F.col("p_size").cast("long")
    members = t(spark, sf, "part").select((key % 9 + 1).alias("l_suppkey"), (key * 3).alias("a"), (key * 3 + size * size * size).alias("b"), "p_partkey")
    return slices.interval_join(t(spark, sf, "lineitem"), members, "l_suppkey", "l_orderkey", "a", "b").select("l_orderkey", "l_linenumber", "p_partkey")


# views -------------------------------------------------------------------------------------------


@query("""SELECT d.doc_id, substr(d.text, CAST(d.doc_id % 5 AS INT) + 1, CAST(greatest(length(d.text) - d.doc_id % 5 - d.doc_id % 7, 0) AS INT)) AS sequence1
          FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.toxic = 0""")
def masked_view(spark, sf):
    docs, labels = t(spark, sf, "documents"), t(spark, sf, "labels")
    reads = docs.select(F.lit(1).alias("prep_sample_idx"), F.col("doc_id").alias("sequence_idx"), F.lit(None).cast("string").alias("read_id"), F.col("text").alias("sequence1"), F.lit(None).cast("array<short>").alias("qual1"), F.lit(None).cast("string").alias("sequence2"), F.lit(None).cast("array<short>").alias("qual2"))
    mask = labels.select(F.lit(1).alias("mask_idx"), F.lit(1).alias("prep_sample_idx"), F.col("doc_id").alias("sequence_idx"), F.when(F.col("toxic") == 0, "pass").otherwise("host").alias("reason"), (F.col("doc_id") % 5).alias("left_trim1"), (F.col("doc_id") % 7).alias("right_trim1"), F.lit(None).cast("long").alias("left_trim2"), F.lit(None).cast("long").alias("right_trim2"))
    return masks.masked(reads, mask).select(F.col("sequence_idx").alias("doc_id"), "sequence1")


@query("""SELECT vec_id, list_aggregate(list_transform(embedding[vec_id % 4 + 1 : len(embedding) - vec_id % 3], lambda x: CAST(x * 1000 AS BIGINT)), 'sum')::BIGINT AS total,
                 CAST(len(embedding[vec_id % 4 + 1 : len(embedding) - vec_id % 3]) AS INT) AS n FROM embeddings""")
def array_slice_trim(spark, sf):
    """Components times 1,000 as single floats, which SQL rounds once: by an integer Spark would multiply doubles."""
    kept = sequence.trimmed_array(F.col("embedding"), F.col("vec_id") % 4, F.col("vec_id") % 3)
    rows = t(spark, sf, "embeddings").withColumn("k", kept)
    return rows.select("vec_id", F.aggregate("k", F.lit(0).cast("long"), lambda a, x: a + F.rint(x * F.lit(1000.0).cast("float")).cast("long")).alias("total"), F.size("k").alias("n"))


@query("SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)")
def exclusion_view(spark, sf):
    blocked = t(spark, sf, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("l_suppkey"))
    return slices.excluded(t(spark, sf, "lineitem"), blocked, "l_suppkey").select("l_orderkey", "l_linenumber", "l_suppkey")


@query("""SELECT p_partkey AS l_partkey FROM part WHERE p_size = 1
          UNION SELECT l_partkey FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)""")
def exclusion_resolve(spark, sf):
    direct = t(spark, sf, "part").where("p_size = 1").select(F.col("p_partkey").alias("l_partkey"))
    blocked = t(spark, sf, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("l_suppkey"))
    return reference.resolved_exclusion(direct, blocked, t(spark, sf, "lineitem"), "l_partkey", "l_suppkey")


@query("""SELECT l_partkey, l_suppkey, how FROM (
            SELECT l_partkey, l_suppkey, how, row_number() OVER (PARTITION BY l_partkey ORDER BY how, l_suppkey) AS n FROM (
              SELECT l_partkey, l_suppkey, CASE WHEN p_size = 1 THEN 'feature' ELSE 'genome' END AS how
              FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
              WHERE p_size = 1 OR s_acctbal < 0)) WHERE n = 1""")
def exclusion_or_match(spark, sf):
    rows = t(spark, sf, "lineitem").select("l_partkey", "l_suppkey").distinct()
    parts = t(spark, sf, "part").where("p_size = 1").select(F.col("p_partkey").alias("l_partkey"))
    blocked = t(spark, sf, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("l_suppkey"))
    hits = rows.join(parts, "l_partkey", "left_semi").withColumn("how", F.lit("feature")).unionByName(rows.join(blocked, "l_suppkey", "left_semi").withColumn("how", F.lit("genome")))
    return reference.first_by(hits, ["l_partkey"], ["how", "l_suppkey"]).select("l_partkey", "l_suppkey", "how")


@query("""(SELECT l_partkey FROM lineitem WHERE l_suppkey = 1 UNION SELECT p_partkey FROM part WHERE p_brand = 'Brand#11')
          EXCEPT (SELECT l_partkey FROM lineitem WHERE l_suppkey <> 1 UNION SELECT p_partkey FROM part WHERE p_brand = 'Brand#12')""")
def orphan_set(spark, sf):
    line, part = t(spark, sf, "lineitem"), t(spark, sf, "part").withColumnRenamed("p_partkey", "l_partkey")
    return reference.orphans([line.where("l_suppkey = 1").select("l_partkey"), part.where("p_brand = 'Brand#11'").select("l_partkey")], [line.where("l_suppkey <> 1").select("l_partkey"), part.where("p_brand = 'Brand#12'").select("l_partkey")])


@query("""SELECT 'lineitem' AS name, count(*) AS before, count(*) FILTER (WHERE l_suppkey <> 3) AS after FROM lineitem
          UNION ALL SELECT 'part', count(*), count(*) FILTER (WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem GROUP BY l_partkey HAVING bool_and(l_suppkey = 3))) FROM part""")
def delete_reference_counts(spark, sf):
    line, part = t(spark, sf, "lineitem"), t(spark, sf, "part")
    orphan = reference.orphans([line.where("l_suppkey = 3").select("l_partkey")], [line.where("l_suppkey <> 3").select("l_partkey")])
    left = mutations.delete_using(part.withColumnRenamed("p_partkey", "l_partkey"), orphan, ["l_partkey"])
    count = lambda df, c: df.agg(F.count(F.lit(1)).alias(c))
    one = count(line, "before").crossJoin(count(line.where("l_suppkey <> 3"), "after"))  # one row by one row
    two = count(part, "before").crossJoin(count(left, "after"))
    return one.select(F.lit("lineitem").alias("name"), "before", "after").unionByName(two.select(F.lit("part").alias("name"), "before", "after"))


# metrics -----------------------------------------------------------------------------------------


@query("""SELECT l_returnflag AS sample, n + m AS raw, n1 + m1 AS biological, n2 + m2 AS quality_filtered, n3 + m3 AS spikein, n AS row_count FROM (
            SELECT l_returnflag, count(*) AS n, count(x) AS m,
                   count(*) FILTER (WHERE r IN ('host_minimap2', 'host_rype', 'pass')) AS n1, count(x) FILTER (WHERE r IN ('host_minimap2', 'host_rype', 'pass')) AS m1,
                   count(*) FILTER (WHERE r = 'pass') AS n2, count(x) FILTER (WHERE r = 'pass') AS m2,
                   count(*) FILTER (WHERE r = 'spikein_syndna') AS n3, count(x) FILTER (WHERE r = 'spikein_syndna') AS m3
            FROM (SELECT l_returnflag, CASE WHEN l_linenumber % 2 = 0 THEN l_linenumber END AS x,
                         CASE l_suppkey % 6 WHEN 0 THEN 'pass' WHEN 1 THEN 'host_minimap2' WHEN 2 THEN 'host_rype' WHEN 3 THEN 'spikein_syndna' WHEN 4 THEN 'twist_no_adaptor' ELSE 'qc_length' END AS r FROM lineitem) GROUP BY l_returnflag)""")
def mask_metrics(spark, sf):
    k = F.col("l_suppkey") % 6
    reason = F.when(k == 0, "pass").when(k == 1, "host_minimap2").when(k == 2, "host_rype").when(k == 3, "spikein_syndna").when(k == 4, "twist_no_adaptor").otherwise("qc_length")
    mask = t(spark, sf, "lineitem").select(F.col("l_returnflag").alias("sample"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_linenumber")).alias("right_trim2"), reason.alias("reason"))
    return masks.metrics(mask, ["sample"])


# sequences ---------------------------------------------------------------------------------------


@query("""SELECT hash, min(doc_id) AS doc_id, count(*) AS copies FROM (
            SELECT doc_id, least(md5(s), md5(reverse(translate(s, 'ACGT', 'TGCA')))) AS hash
            FROM (SELECT doc_id, regexp_replace(translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC'), '[^ACGT]', '', 'g') AS s FROM documents)) GROUP BY hash""")
def canonical_hash_dedup(spark, sf):
    bases = F.regexp_replace(F.translate("text", "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC"), "[^ACGT]", "")
    rows = t(spark, sf, "documents").select("doc_id", sequence.canonical_hash(bases).alias("hash"))
    return rows.groupBy("hash").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


@query("""SELECT doc_id, i AS chunk_index, substr(text, i * 256 + 1, 256) AS chunk_data FROM (
            SELECT doc_id, text, CAST(unnest(range(0, greatest(length(text) - 1, 0) // 256 + 1)) AS INT) AS i FROM documents)""")
def chunk_split(spark, sf):
    return t(spark, sf, "documents").select("doc_id", F.inline(sequence.split(F.col("text"), 256)))


@query("SELECT conv_id, string_agg(text, '' ORDER BY turn) AS sequence FROM conversations GROUP BY conv_id")
def chunk_reassemble(spark, sf):
    from ..sources.readers import reassembled

    return reassembled(t(spark, sf, "conversations").select("conv_id", F.col("turn").alias("chunk_index"), F.col("text").alias("chunk_data")), ["conv_id"])


@query("""WITH RECURSIVE i AS (SELECT doc_id, row_number() OVER w AS n, sum(n_chars) OVER w - n_chars AS a, sum(n_chars) OVER w AS e FROM documents WINDOW w AS (ORDER BY doc_id)),
          x AS (SELECT i.n, min(j.n) AS m FROM i JOIN i j ON j.n > i.n AND j.e > i.a + 50000 GROUP BY i.n),
          s(n) AS (SELECT CAST(1 AS BIGINT) UNION ALL SELECT m FROM s JOIN x ON x.n = s.n)
          SELECT doc_id, count(s.n) - 1 AS part FROM i JOIN s ON s.n <= i.n GROUP BY doc_id""")
def bin_pack(spark, sf):
    return planning.parts_by_budget(t(spark, sf, "documents").withColumnRenamed("n_chars", "cost"), "doc_id", "cost", 50_000)


@query("""WITH known AS (SELECT p_brand, row_number() OVER (ORDER BY p_brand) AS idx FROM (SELECT DISTINCT p_brand FROM part WHERE p_brand < 'Brand#3')),
          fresh AS (SELECT p_brand, row_number() OVER (ORDER BY p_brand) + (SELECT coalesce(max(idx), 0) FROM known) AS idx FROM (SELECT DISTINCT p_brand FROM part WHERE p_brand >= 'Brand#3'))
          SELECT p_brand, CAST(idx AS BIGINT) AS idx FROM known UNION ALL SELECT p_brand, CAST(idx AS BIGINT) FROM fresh""")
def mint_ids(spark, sf):
    brands = t(spark, sf, "part").select("p_brand").distinct()
    known = reference.dense_numbers(brands.where("p_brand < 'Brand#3'"), "p_brand", "idx").select("p_brand", F.col("idx").cast("long").alias("idx"))
    return reference.minted(known, brands, "p_brand", "idx")


@query("""SELECT l.p_partkey, r.phylum, r.domain FROM part l LEFT JOIN (
            SELECT p_partkey, split_part(p_type, ' ', 1) AS domain, nullif(split_part(p_type, ' ', 2), '') AS phylum FROM part WHERE p_size > 10) r ON l.p_partkey = r.p_partkey""")
def taxonomy_pad(spark, sf):
    part = t(spark, sf, "part")
    words = F.split("p_type", " ")
    text = F.concat(F.lit("d__"), F.get(words, F.lit(0)), F.lit("; p__"), F.coalesce(F.get(words, F.lit(1)), F.lit("")))
    lineage = reference.ranks(part.where("p_size > 10").select("p_partkey", text.alias("taxonomy")))
    return reference.padded(part.select("p_partkey"), lineage, "p_partkey").select("p_partkey", "domain", "phylum")


@query("""SELECT p_partkey FROM (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'd__a; p__b' WHEN 1 THEN 'd__a; c__b' WHEN 2 THEN 'd__a; p__b; c__c; o__d; f__e; g__f; s__g; t__h; x__i' ELSE 'd__' END AS taxonomy FROM part)
          WHERE taxonomy IN ('d__a; c__b') OR len(string_split(taxonomy, '; ')) > 8""")
def taxonomy_validate(spark, sf):
    k = F.col("p_size") % 4
    text = F.when(k == 0, "d__a; p__b").when(k == 1, "d__a; c__b").when(k == 2, "d__a; p__b; c__c; o__d; f__e; g__f; s__g; t__h; x__i").otherwise("d__")
    return reference.bad_lineages(t(spark, sf, "part").select("p_partkey", text.alias("taxonomy"))).select("p_partkey")


@query("SELECT n_nationkey, n_name, r_name FROM nation LEFT JOIN region ON n_nationkey % 2 = 0 AND n_regionkey = r_regionkey")
def tip_left_join(spark, sf):
    n, r = t(spark, sf, "nation"), t(spark, sf, "region")
    return n.join(r, (F.col("n_nationkey") % 2 == 0) & (F.col("n_regionkey") == F.col("r_regionkey")), "left").select("n_nationkey", "n_name", "r_name")


def _tree(spark, sf):
    return t(spark, sf, "orders").select(F.col("o_orderkey").alias("node_index"), F.expr("o_orderkey div 2").alias("parent_index")).where("node_index > 0")


@query("""WITH RECURSIVE c(node) AS (SELECT CAST(5 AS BIGINT) UNION ALL SELECT o_orderkey FROM orders JOIN c ON o_orderkey // 2 = c.node AND o_orderkey > 0)
          SELECT DISTINCT node FROM c""")
def clade_descendants(spark, sf):
    return reference.descendants(_tree(spark, sf), 5)


@query("""WITH RECURSIVE e AS (SELECT DISTINCT o_orderkey AS d, o_orderkey // 2 AS a FROM orders WHERE o_orderkey > 0 AND o_orderkey <> o_orderkey // 2),
          n AS (SELECT d AS x FROM e UNION SELECT a FROM e),
          c(a, d, k) AS (SELECT x, x, 0 FROM n UNION ALL SELECT e.a, c.d, c.k + 1 FROM c JOIN e ON e.d = c.a)
          SELECT a AS ancestor, d AS descendant, CAST(min(k) AS INT) AS distance FROM c GROUP BY a, d""")
def closure_distance(spark, sf):
    """Every node and every level."""
    return reference.closure(_tree(spark, sf), "node_index", "parent_index")


@query("""SELECT l_orderkey, l_partkey, l_suppkey, l_returnflag, l_linenumber FROM (
            SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey, l_returnflag ORDER BY l_orderkey, l_linenumber) AS n FROM lineitem) WHERE n = 1""")
def annotation_dedup(spark, sf):
    return reference.first_by(t(spark, sf, "lineitem"), ["l_partkey", "l_suppkey", "l_returnflag"], ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_partkey", "l_suppkey", "l_returnflag", "l_linenumber")


@query("""SELECT event_id, CASE WHEN strpos(x, ':') > 0 THEN split_part(x, ':', 1) END AS source, CASE WHEN strpos(x, ':') > 0 THEN substr(x, strpos(x, ':') + 1) ELSE x END AS accession
          FROM (SELECT event_id, unnest(string_split(event_type || ':' || user_id || ':v,plain', ',')) AS x FROM events)""")
def xref_explode(spark, sf):
    rows = t(spark, sf, "events").withColumn("dbxref", F.concat("event_type", F.lit(":"), F.col("user_id").cast("string"), F.lit(":v,plain")))
    return reference.xrefs(rows, "dbxref", ["event_id"])


@query("SELECT p_brand, max(p_name) AS definition FROM part GROUP BY p_brand")
def term_grain(spark, sf):
    return t(spark, sf, "part").groupBy("p_brand").agg(F.max("p_name").alias("definition"))


@query("SELECT DISTINCT l_partkey, l_suppkey FROM lineitem")
def link_grain(spark, sf):
    return t(spark, sf, "lineitem").select("l_partkey", "l_suppkey").distinct()


@query("SELECT o_custkey, arg_min(o_orderpriority, o_orderkey) FILTER (WHERE o_orderstatus <> 'O') AS lineage FROM orders GROUP BY o_custkey")
def genome_lineage(spark, sf):
    rows = t(spark, sf, "orders").withColumn("lineage", F.when(F.col("o_orderstatus") != "O", F.col("o_orderpriority")).otherwise(""))
    return reference.representative(rows, "o_custkey", "lineage", "o_orderkey")


# planning ----------------------------------------------------------------------------------------

_SHARDS = "SELECT p_partkey, p_type, CAST((row_number() OVER (ORDER BY p_type, p_partkey) * least(count(*) OVER (), 50) - 1) // count(*) OVER () AS BIGINT) AS shard FROM part"


@query(_SHARDS)
def tile_by_lineage(spark, sf):
    return planning.even_shards(t(spark, sf, "part").select("p_partkey", "p_type"), ["p_type", "p_partkey"], 50)


@query(f"SELECT shard, string_agg(CAST(p_partkey AS VARCHAR), ',' ORDER BY p_partkey) AS members FROM ({_SHARDS}) GROUP BY shard")
def feature_shard_list(spark, sf):
    return planning.shard_members(tile_by_lineage(spark, sf), "p_partkey").select("shard", F.array_join(F.transform("members", lambda x: x.cast("string")), ",").alias("members"))


@query("""WITH c AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey),
          l AS (SELECT o_custkey, n, sum(n) OVER (ORDER BY o_custkey) - n AS before FROM c),
          b AS (SELECT *, CAST(unnest(range(before // 100, (before + n - 1) // 100 + 1)) AS BIGINT) AS block FROM (SELECT o_custkey, n, CAST(before AS BIGINT) AS before FROM l))
          SELECT o_custkey, block, greatest(block * 100, before) - before + 1 AS first, least((block + 1) * 100, before + n) - before AS last FROM b""")
def tile_blocks(spark, sf):
    return planning.blocks(t(spark, sf, "orders").groupBy("o_custkey").count(), "o_custkey", "count", 100)


# masks -------------------------------------------------------------------------------------------


@query("""SELECT d.doc_id, CASE WHEN EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 1) THEN 'host_minimap2'
                                WHEN EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 0) THEN 'host_rype' ELSE d.lang END AS reason FROM documents d""")
def host_precedence(spark, sf):
    labels = t(spark, sf, "labels")
    reads = t(spark, sf, "documents").select("doc_id", F.col("lang").alias("reason"))
    return masks.with_precedence(reads, [(labels.where("toxic = 1"), "host_minimap2"), (labels.where("quality = 0"), "host_rype")], "doc_id")


@query("SELECT event_id, CASE WHEN user_id IN (SELECT user_id FROM events WHERE value > 95) THEN 'spikein' ELSE 'pass' END AS reason FROM events")
def spikein_mask(spark, sf):
    events = t(spark, sf, "events")
    return masks.with_precedence(events.select("event_id", "user_id", F.lit("pass").alias("reason")), [(events.where("value > 95"), "spikein")], "user_id").select("event_id", "reason")


@query("""SELECT doc_id, 'carry' AS branch, lang AS reason FROM documents WHERE lang <> 'en'
          UNION ALL SELECT doc_id, 'se', CASE WHEN n_chars < 500 THEN 'qc_length' ELSE 'pass' END FROM documents WHERE lang = 'en' AND doc_id % 2 = 0
          UNION ALL SELECT doc_id, 'pe', CASE WHEN n_chars < 900 THEN 'qc_length' ELSE 'pass' END FROM documents WHERE lang = 'en' AND doc_id % 2 = 1""")
def carry_union(spark, sf):
    docs = t(spark, sf, "documents")
    short = lambda n: F.when(F.col("n_chars") < n, "qc_length").otherwise("pass").alias("reason")
    carry = docs.where("lang <> 'en'").select("doc_id", F.lit("carry").alias("branch"), F.col("lang").alias("reason"))
    se = docs.where("lang = 'en' and doc_id % 2 = 0").select("doc_id", F.lit("se").alias("branch"), short(500))
    pe = docs.where("lang = 'en' and doc_id % 2 = 1").select("doc_id", F.lit("pe").alias("branch"), short(900))
    return carry.unionByName(se).unionByName(pe)


@query("""SELECT doc_id, CAST(CASE WHEN c IS NULL THEN NULL ELSE strpos(text, c) - 1 END AS INT) AS left_trim,
                 CAST(CASE WHEN c IS NULL THEN NULL ELSE length(text) - (strpos(text, c) - 1) - length(c) END AS INT) AS right_trim
          FROM (SELECT doc_id, text, CASE WHEN doc_id % 10 <> 0 THEN substr(text, CAST(doc_id % 4 AS INT) + 1, greatest(length(text) - 9, 0)) END AS c FROM documents)""")
def infer_trim(spark, sf):
    docs = t(spark, sf, "documents").select("doc_id", "text")
    cut = docs.where("doc_id % 10 <> 0").select("doc_id", F.expr("substring(text, cast(doc_id % 4 as int) + 1, greatest(length(text) - 9, 0))").alias("c"))
    return docs.join(cut, "doc_id", "left").withColumn("x", masks.inferred_trim(F.col("text"), F.col("c"))).select("doc_id", "x.left_trim", "x.right_trim")


# alignments --------------------------------------------------------------------------------------


def _cigars(spark, sf):
    c = F.concat(F.col("l_linenumber").cast("string"), F.lit("S"), (F.col("l_partkey") % 90 + 10).cast("string"), F.lit("="), (F.col("l_suppkey") % 7).cast("string"), F.lit("X"), (F.col("l_orderkey") % 3).cast("string"), F.lit("I"), (F.col("l_orderkey") % 4).cast("string"), F.lit("D"))
    return t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", c.alias("cigar"))


_SCORED = """SELECT *, CAST(e AS DOUBLE) / (e + x + i + d) AS identity, CAST(e + x AS DOUBLE) / (e + x + i + s) AS coverage FROM (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_linenumber AS s, l_partkey % 90 + 10 AS e, l_suppkey % 7 AS x, l_orderkey % 3 AS i, l_orderkey % 4 AS d FROM lineitem)"""


@query(f"SELECT l_orderkey, l_linenumber, round(identity, 6) AS identity, round(coverage, 6) AS coverage FROM ({_SCORED})")
def cigar_scores(spark, sf):
    return _cigars(spark, sf).select("l_orderkey", "l_linenumber", F.round(aln.sequence_identity(F.col("cigar")), 6).alias("identity"), F.round(aln.query_coverage(F.col("cigar")), 6).alias("coverage"))


@query(f"SELECT l_orderkey, l_linenumber FROM ({_SCORED}) WHERE identity >= 0.93 AND coverage >= 0.91")
def align_gate_se(spark, sf):
    return alignment.gate_single(_cigars(spark, sf), 0.93, 0.91).select("l_orderkey", "l_linenumber")


@query(f"""SELECT l_orderkey, l_linenumber FROM (
             SELECT *, CAST(sum(e) OVER w AS DOUBLE) / sum(e + x + i + d) OVER w AS pi, CAST(sum(e + x) OVER w AS DOUBLE) / sum(e + x + i + s) OVER w AS pc
             FROM ({_SCORED}) WINDOW w AS (PARTITION BY l_orderkey, l_partkey % 5, least(l_linenumber, 3), greatest(l_linenumber, 3))) WHERE pi >= 0.93 AND pc >= 0.91""")
def align_gate_pe(spark, sf):
    rows = _cigars(spark, sf).select("l_orderkey", "l_linenumber", F.col("l_orderkey").alias("sequence_idx"), (F.col("l_partkey") % 5).alias("feature_idx"), F.col("l_linenumber").alias("position"), F.lit(3).alias("mate_position"), "cigar")
    return alignment.gate_paired(rows, 0.93, 0.91).select("l_orderkey", "l_linenumber")


@query("SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN l_partkey WHEN 1 THEN NULL WHEN 2 THEN l_suppkey END AS mate_feature_idx FROM lineitem")
def rnext_decode(spark, sf):
    k = F.col("l_linenumber") % 4
    rows = t(spark, sf, "lineitem").withColumn("rnext", F.when(k == 0, "=").when(k == 1, "*").when(k == 2, F.col("l_suppkey").cast("string")))
    return rows.select("l_orderkey", "l_linenumber", aln.mate_feature(F.col("rnext"), F.col("l_partkey")).alias("mate_feature_idx"))


@query("""SELECT event_id, (event_id & 1) <> 0 AS is_paired, (event_id & 4) <> 0 AS is_unmapped, (event_id & 16) <> 0 AS is_reverse, (event_id & 1024) <> 0 AS is_duplicate,
                 (event_id & 2304) = 0 AS is_primary, (event_id & 2308) = 0 AS is_mapped_primary FROM events""")
def flag_predicates(spark, sf):
    f = (F.col("event_id") % 4096).cast("int")
    return t(spark, sf, "events").select("event_id", *[aln.has_flag(f, n).alias(f"is_{n}") for n in ("paired", "unmapped", "reverse", "duplicate")], aln.is_primary(f).alias("is_primary"), aln.is_mapped_primary(f).alias("is_mapped_primary"))


def _spans(spark, sf):
    """Events as intervals on their user's genome."""
    start = (F.col("event_id") * 37 % 5000).cast("long")
    return t(spark, sf, "events").select(F.col("user_id").alias("genome_idx"), start.alias("position"), (start + F.col("event_id") % 90 + 10).alias("stop_position"))


_ISLANDS = """s AS (SELECT user_id AS g, event_id * 37 % 5000 AS p, event_id * 37 % 5000 + event_id % 90 + 10 AS q FROM events),
  o AS (SELECT g, p, q, CASE WHEN p <= max(q) OVER (PARTITION BY g ORDER BY p, q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS n FROM s),
  m AS (SELECT g, p, q, sum(n) OVER (PARTITION BY g ORDER BY p, q ROWS UNBOUNDED PRECEDING) AS k FROM o),
  i AS (SELECT g, k, min(p) AS p, max(q) AS q FROM m GROUP BY g, k)"""


@query(f"WITH {_ISLANDS} SELECT g AS genome_idx, CAST(sum(q - p) AS BIGINT) AS covered FROM i GROUP BY g")
def genome_breadth(spark, sf):
    return coverage.covered(_spans(spark, sf), ["genome_idx"], width=1000)


@query(f"WITH {_ISLANDS} SELECT g AS genome_idx, p AS position, q AS stop_position FROM i")
def compress_intervals(spark, sf):
    return coverage.islands(_spans(spark, sf), ["genome_idx"], width=1000)  # spans of some 5,000 positions, so that borders are met


@query("""WITH s AS (SELECT user_id AS g, event_id * 37 % 5000 AS p, event_id * 37 % 5000 + event_id % 90 + 10 AS q FROM events),
          e AS (SELECT g, x, sum(d) AS d FROM (SELECT g, p AS x, 1 AS d FROM s UNION ALL SELECT g, q, -1 FROM s) GROUP BY g, x),
          r AS (SELECT g, x, sum(d) OVER (PARTITION BY g ORDER BY x ROWS UNBOUNDED PRECEDING) AS depth, lead(x) OVER (PARTITION BY g ORDER BY x) AS y FROM e)
          SELECT g AS genome_idx, x AS position, y AS stop_position, CAST(depth AS BIGINT) AS depth FROM r WHERE depth > 0""")
def coverage_depth(spark, sf):
    return coverage.depth(_spans(spark, sf), ["genome_idx"], width=1000)


@query("""WITH x AS (SELECT p_partkey AS f FROM part WHERE p_size = 1),
  c AS (SELECT p_partkey AS f, p_partkey % 97 AS g, 60 + p_size AS len FROM part),
  a AS (SELECT l_returnflag AS s, l_orderkey AS r, c.g, c.f * 200 + l_linenumber AS p, c.f * 200 + l_linenumber + CAST(l_quantity AS BIGINT) AS q
        FROM lineitem JOIN c ON l_partkey = c.f WHERE l_partkey NOT IN (SELECT f FROM x)),
  d AS (SELECT DISTINCT g, p, q FROM a WHERE p < q),
  o AS (SELECT g, p, q, CASE WHEN p <= max(q) OVER (PARTITION BY g ORDER BY p, q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS n FROM d),
  m AS (SELECT g, p, q, sum(n) OVER (PARTITION BY g ORDER BY p, q ROWS UNBOUNDED PRECEDING) AS k FROM o),
  i AS (SELECT g, sum(q - p) AS covered FROM (SELECT g, k, min(p) AS p, max(q) AS q FROM m GROUP BY g, k) GROUP BY g),
  v AS (SELECT i.g FROM i JOIN (SELECT g, sum(len) AS len FROM c GROUP BY g) USING (g) WHERE covered / len >= 0.5),
  h AS (SELECT DISTINCT s, r, g FROM a WHERE g IN (SELECT g FROM v)),
  n AS (SELECT s, r, g, count(*) OVER (PARTITION BY s, r) AS k FROM h)
  SELECT s AS prep_sample_idx, g AS genome_idx, round(sum(1.0::DOUBLE / k), 6) AS value FROM n GROUP BY s, g""")
def ogu_table(spark, sf):
    """The flagship: a read is an order, a contig a part, a genome 97 classes of parts, a sample a return flag."""
    part = t(spark, sf, "part")
    contigs = part.select(F.col("p_partkey").alias("feature_idx"), (F.col("p_partkey") % 97).alias("genome_idx"), (F.col("p_size") + 60).alias("sequence_length_bp"))
    at = F.col("l_partkey") * 200 + F.col("l_linenumber")
    rows = t(spark, sf, "lineitem").select(F.col("l_returnflag").alias("prep_sample_idx"), F.col("l_orderkey").alias("sequence_idx"), F.col("l_partkey").alias("feature_idx"), at.alias("position"), (at + F.col("l_quantity").cast("long")).alias("stop_position"))
    blocked = part.where("p_size = 1").select(F.col("p_partkey").alias("feature_idx"))
    return features.feature_table(rows, blocked, contigs, 0.5).withColumn("value", F.round("value", 6))


# quality control ---------------------------------------------------------------------------------


@query("""SELECT lang, string_agg(v || ':' || n, ',' ORDER BY v) AS histogram FROM (
            SELECT lang, n_chars // 1000 AS v, count(*) AS n FROM documents GROUP BY lang, n_chars // 1000) GROUP BY lang""")
def qc_report(spark, sf):
    rows = readmodels.value_counts(t(spark, sf, "documents"), F.expr("n_chars div 1000"), ["lang"])
    return rows.select("lang", F.array_join(F.transform("histogram", lambda x: F.concat(x["value"].cast("string"), F.lit(":"), x["n"].cast("string"))), ",").alias("histogram"))


def _mate_sql(mate: int) -> str:
    told = lambda value: f"(SELECT string_agg(v || ':' || n, ',' ORDER BY v) FROM (SELECT {value} AS v, count(*) AS n FROM r{mate} x WHERE x.sample = r{mate}.sample GROUP BY 1) WHERE v IS NOT NULL)"
    return f"""SELECT sample, {mate} AS mate, count(*) AS reads, CAST(sum(len) AS BIGINT) AS total_bases, round(CAST(sum(qs) AS DOUBLE) / sum(len), 6) AS mean_quality, round(CAST(sum(gc) AS DOUBLE) / sum(len), 6) AS gc_content,
        round(CAST(sum(nn) AS DOUBLE) / sum(len), 6) AS n_content, min(len) AS min_length, max(len) AS max_length, round(avg(len), 6) AS mean_length, {told("CAST(round(mq) AS INTEGER)")} AS quality_histogram,
        {told("CASE WHEN len > 0 THEN CAST(round(100.0 * gc / len) AS INTEGER) END")} AS gc_histogram, {told("len")} AS length_histogram FROM r{mate} GROUP BY sample"""


_MATES = """SELECT p_size % 5 AS sample, length(s) AS len, length(s) - length(regexp_replace(s, '[GCgc]', '', 'g')) AS gc, length(s) - length(regexp_replace(s, '[Nn]', '', 'g')) AS nn, list_sum(q) AS qs, list_avg(q) AS mq FROM (
    SELECT p_size, {0} AS s, CASE WHEN p_partkey % 7 <> 0 THEN list_transform(range(1, length({0}) + 1), lambda i: (i * i * p_partkey) % 41) END AS q FROM part WHERE {1})"""


@query(f"""WITH r1 AS ({_MATES.format("p_name", "p_name IS NOT NULL")}), r2 AS ({_MATES.format("p_type", "p_partkey % 3 = 0 AND p_size % 5 <> 4 AND p_type IS NOT NULL")})
  {_mate_sql(1)} UNION ALL {_mate_sql(2)}""")
def qc_mate_report(spark, sf):
    """Parts' names as first mates and a third of their types as second ones, a quality for each letter or, of a seventh, none; a fifth of the sizes is a sample, of which one has no second mates."""
    part = t(spark, sf, "part").withColumn("p_type", F.when((F.col("p_partkey") % 3 == 0) & (F.col("p_size") % 5 != 4), F.col("p_type"))).withColumn("sample", F.col("p_size") % 5)
    quality = lambda c: F.when((F.col("p_partkey") % 7 != 0) & (F.length(c) > 0), F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: (i * i * F.col("p_partkey") % 41).cast("short")))
    mates = [readmodels.read_report(part.withColumn("quality", quality(c)), c, "quality", ["sample"]).withColumn("mate", F.lit(m)) for m, c in ((1, "p_name"), (2, "p_type"))]
    both = mates[0].unionByName(mates[1])
    text = lambda c: F.nullif(F.array_join(F.transform(F.map_entries(c), lambda x: F.concat(x["key"].cast("string"), F.lit(":"), x["value"].cast("string"))), ","), F.lit(""))
    means = {c: F.round(c, 6) for c in ("mean_quality", "gc_content", "n_content", "mean_length")}
    return both.withColumns(means | {f"{k}_histogram": text(f"{k}_histogram") for k in ("quality", "gc", "length")}).select(
        "sample", "mate", "reads", "total_bases", *means, "min_length", "max_length", "quality_histogram", "gc_histogram", "length_histogram")


@query("SELECT s_suppkey, s_name, p_brand AS mask_state FROM supplier LEFT JOIN part ON p_partkey = s_suppkey AND p_size = 7")
def gate_roster(spark, sf):
    """Suppliers as samples, parts as their gates, whose size is the mask: the state under mask 7, null where there is none."""
    gates = t(spark, sf, "part").select(F.col("p_partkey").alias("s_suppkey"), "p_size", F.col("p_brand").alias("mask_state"))
    return readmodels.with_state(t(spark, sf, "supplier").select("s_suppkey", "s_name"), gates, "s_suppkey", F.col("p_size") == 7, "mask_state")


@query("""SELECT doc_id, length(text) >= 100 AND n <= 50 AND length(text) <= 5000 AS passed,
                 CASE WHEN length(text) < 100 THEN 'length' WHEN n > 50 THEN 'n_base' WHEN length(text) > 5000 THEN 'too_long' END AS fail_reason
          FROM (SELECT doc_id, text, length(text) - length(replace(replace(text, 'N', ''), 'n', '')) AS n FROM documents)""")
def qc_filter(spark, sf):
    """Documents of every language."""
    verdict = qc.filter_read(F.col("text"), F.lit(None).cast("array<short>"), min_len=100, max_len=5000, max_n=50)
    return t(spark, sf, "documents").select("doc_id", verdict.alias("v")).select("doc_id", "v.passed", "v.fail_reason")


@query("""SELECT p_partkey, r.passed, r.fail_reason, r.low AS low_qual_bases, round(r.mean, 6) AS mean_quality FROM (
            SELECT p_partkey, {'passed': NOT (n < 12 OR 100 * low > 40 * n OR mean < 14 OR n > 26), 'low': CAST(low AS INT), 'mean': mean,
                               'fail_reason': CASE WHEN n < 12 THEN 'length' WHEN 100 * low > 40 * n OR mean < 14 THEN 'quality' WHEN n > 26 THEN 'too_long' END} AS r
            FROM (SELECT p_partkey, length(p_name) AS n, len(list_filter(q, lambda x: x < 15)) AS low, CAST(list_sum(q) AS DOUBLE) / len(q) AS mean
                  FROM (SELECT p_partkey, p_name, list_transform(range(1, length(p_name) + 1), lambda i: (i * i * p_partkey) % 41) AS q FROM part)))""")
def qc_reads(spark, sf):
    """The read filter with qualities: parts' names as reads, a quality for each letter."""
    qual = F.transform(F.sequence(F.lit(1), F.length("p_name")), lambda i: (i * i * F.col("p_partkey") % 41).cast("short"))
    verdict = qc.filter_read(F.col("p_name"), qual, min_len=12, max_len=26, min_avg_q=14, max_n=1000)
    rows = t(spark, sf, "part").select("p_partkey", verdict.alias("v"))
    return rows.select("p_partkey", "v.passed", "v.fail_reason", "v.low_qual_bases", F.round("v.mean_quality", 6).alias("mean_quality"))


@query()
def qc_trim_filter(spark, sf):
    """Whole documents as reads; of three one has a mate that ends the insert halfway, one a mate that doesn't meet it. A pair passes if both mates do."""
    bases = F.translate(F.lower(F.coalesce("text", F.lit(""))), "bdefhijklmnopqrsuvwxyz ", "acgtacgtacgtacgtacgtacg")
    one = t(spark, sf, "documents").select("doc_id", F.upper(F.regexp_replace(bases, "[^acgt]", "")).alias("sequence1"))
    half = F.floor(F.length("sequence1") / 2).cast("int")
    mate = F.when(F.col("doc_id") % 3 == 0, F.concat(sequence.reverse_complement(F.substring("sequence1", F.lit(1), half)), F.substring("sequence1", F.lit(1), half))).when(F.col("doc_id") % 3 == 1, F.reverse("sequence1"))
    cut = qc.trim_lengths(one.withColumn("sequence2", mate), ["AGATCGGAAGAGC"], poly_g=True)
    none = F.lit(None).cast("array<short>")
    first = qc.filter_read(F.substring("sequence1", F.lit(1), F.col("kept1")), none)
    second = F.when(F.col("kept2").isNotNull(), qc.filter_read(F.substring("sequence2", F.lit(1), F.col("kept2")), none))
    told = cut.select("doc_id", "kept1", "kept2", F.coalesce(first["fail_reason"], second["fail_reason"]).alias("fail_reason"))
    return told.select("doc_id", "kept1", "kept2", F.col("fail_reason").isNull().alias("passed"), "fail_reason")


@query("SELECT doc_id AS feature_idx, true AS same FROM documents")
def format_roundtrip(spark, sf):
    """Documents as FASTA records, written, read again by the reader and compared."""
    from ..sources import readers, sinks

    at = f"{shared_dir(spark)}/fasta-{uuid.uuid4().hex}"
    rows = t(spark, sf, "documents").select(F.col("doc_id").alias("feature_idx"), F.lit(None).cast("string").alias("accession"), F.upper(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z]", "")).alias("sequence"))
    sinks.fasta(rows, at)
    back = readers.fastx(spark, at).select(F.regexp_extract("read_id", r"^feature_(\d+)$", 1).cast("long").alias("feature_idx"), F.md5("sequence").alias("digest"))
    return rows.select("feature_idx", F.md5("sequence").alias("own")).join(back, "feature_idx").select("feature_idx", (F.col("own") == F.col("digest")).alias("same"))


# read models -------------------------------------------------------------------------------------

_STEPS = "CASE WHEN bool_or(o_orderstatus = 'F') THEN 'completed' WHEN bool_or(o_orderstatus = 'P') THEN 'in_flight' WHEN bool_or(o_totalprice < 1000) THEN 'no_data' ELSE 'not_submitted' END"


@query(f"""SELECT count(*) FILTER (WHERE status = 'completed') AS completed, count(*) FILTER (WHERE status = 'in_flight') AS in_flight,
                  count(*) FILTER (WHERE status = 'no_data') AS no_data, count(*) FILTER (WHERE status = 'not_submitted') AS not_submitted
           FROM (SELECT o_custkey, {_STEPS} AS status FROM orders GROUP BY o_custkey)""")
def completion_ladder(spark, sf):
    status = readmodels.ladder(t(spark, sf, "orders"), "o_custkey", [("completed", F.col("o_orderstatus") == "F"), ("in_flight", F.col("o_orderstatus") == "P"), ("no_data", F.col("o_totalprice") < 1000)], "not_submitted")
    return readmodels.tally(status, ["completed", "in_flight", "no_data", "not_submitted"])


@query("""SELECT c_nationkey, count(*) AS samples, CAST(sum(n) AS BIGINT) AS reads, round(sum(q) FILTER (WHERE seg IS DISTINCT FROM 'BUILDING'), 2) AS quantity FROM (
            SELECT c_custkey, c_nationkey, c_mktsegment AS seg, count(l_orderkey) AS n, sum(l_quantity) AS q
            FROM customer LEFT JOIN orders ON c_custkey = o_custkey LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL) GROUP BY c_nationkey""")
def pool_metrics(spark, sf):
    c, o, l = t(spark, sf, "customer"), t(spark, sf, "orders"), t(spark, sf, "lineitem")  # noqa: E741
    per_order = l.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("q"))
    per_sample = o.join(per_order, "o_orderkey", "left").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("n").alias("n"), F.sum("q").alias("q"))
    rows = c.join(per_sample, "c_custkey", "left")
    live = ~F.col("c_mktsegment").eqNullSafe(F.lit("BUILDING"))
    return rows.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("samples"), F.sum(F.coalesce("n", F.lit(0))).alias("reads"), F.round(F.sum(F.when(live, F.col("q"))), 2).alias("quantity"))


@query("""SELECT c_custkey FROM customer c WHERE c_acctbal IS NULL OR c_acctbal = 0
             OR (EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o_orderstatus = 'P') AND NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o_orderstatus = 'F'))""")
def sample_exceptions(spark, sf):
    c, o = t(spark, sf, "customer"), t(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey")
    failed = c.join(o.where("o_orderstatus = 'P'"), "c_custkey", "left_semi").join(o.where("o_orderstatus = 'F'"), "c_custkey", "left_anti")
    return c.where("c_acctbal is null or c_acctbal = 0").select("c_custkey").union(failed.select("c_custkey")).distinct()


@query("""SELECT c_custkey, o_orderkey, o_orderstatus FROM customer JOIN (
            SELECT o_custkey, o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderstatus = 'F') DESC, o_orderdate DESC, o_orderkey) AS n FROM orders) ON c_custkey = o_custkey WHERE n = 1
          UNION ALL SELECT c_custkey, NULL, 'none' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def masked_sample_roster(spark, sf):
    c, o = t(spark, sf, "customer"), t(spark, sf, "orders")
    first = reference.first_by(o, ["o_custkey"], [F.desc(F.col("o_orderstatus") == "F"), F.desc("o_orderdate"), "o_orderkey"])
    have = c.join(first, c.c_custkey == first.o_custkey).select("c_custkey", "o_orderkey", "o_orderstatus")
    none = mutations.delete_using(c, o.select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"]).select("c_custkey", F.lit(None).cast("long").alias("o_orderkey"), F.lit("none").alias("o_orderstatus"))
    return have.unionByName(none)


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def visible_samples(spark, sf):
    bad = t(spark, sf, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return readmodels.without_violation(t(spark, sf, "customer"), bad, "c_custkey").select("c_custkey")


@query("""SELECT c_custkey, o_orderkey, o_orderdate FROM customer LEFT JOIN (
            SELECT o_custkey, o_orderkey, o_orderdate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) ON c_custkey = o_custkey AND n = 1""")
def lateral_latest(spark, sf):
    events = t(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return readmodels.with_latest(t(spark, sf, "customer").select("c_custkey"), events, "c_custkey", [F.desc("o_orderdate"), F.desc("o_orderkey")], ["o_orderkey", "o_orderdate"])


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 101")
def list_page(spark, sf):
    return readmodels.page(t(spark, sf, "orders").select("o_orderkey", "o_orderdate"), [F.desc("o_orderdate"), F.desc("o_orderkey")], 100)


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderkey LIMIT 25")
def bounded_release(spark, sf):
    return mutations.released(t(spark, sf, "orders"), F.col("o_orderstatus") == "O", ["o_orderkey"], 25).select("o_orderkey", "o_custkey")


@query("""SELECT event_id, CAST(TRY_CAST(x AS DECIMAL(38, 6)) AS DOUBLE) AS number, CASE WHEN TRY_CAST(x AS DECIMAL(38, 6)) IS NULL THEN 'not a numeric: ' || x END AS error
          FROM (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'n/a' ELSE CAST(event_id AS VARCHAR) || '.25' END AS x FROM events)""")
def metadata_typed_decode(spark, sf):
    raw = F.when(F.col("event_id") % 5 == 0, " n/a ").otherwise(F.concat(F.lit(" "), F.col("event_id").cast("string"), F.lit(".25 ")))
    rows = t(spark, sf, "events").select("event_id", metadata.decoded(raw, F.lit("numeric")).alias("m"))
    return rows.select("event_id", F.col("m.number").cast("double").alias("number"), "m.error")


_TYPES = ["click", "login", "purchase", "view"]


@query("SELECT user_id, " + ", ".join(f"max(value) FILTER (WHERE event_type = '{x}') AS {x}" for x in _TYPES) + " FROM events GROUP BY user_id")
def metadata_pivot(spark, sf):
    return readmodels.pivot(t(spark, sf, "events"), "user_id", "event_type", "value", _TYPES)


@query("SELECT l_suppkey, sha256(unhex(string_agg(DISTINCT h, '' ORDER BY h))) AS set_digest FROM (SELECT l_suppkey, md5(CAST(l_partkey AS VARCHAR)) AS h FROM lineitem) GROUP BY l_suppkey")
def set_digest(spark, sf):
    rows = t(spark, sf, "lineitem").select("l_suppkey", F.md5(F.col("l_partkey").cast("string")).alias("h")).distinct()
    return reference.set_digest(rows, "l_suppkey", "h")


# changes -----------------------------------------------------------------------------------------


def _lake(spark):
    return Lake(spark, f"{shared_dir(spark)}/lake-{uuid.uuid4().hex}")


@query("SELECT p_partkey AS feature_idx FROM part WHERE p_size = 1")
def full_replace_sync(spark, sf):
    lake = _lake(spark)
    part = t(spark, sf, "part").select(F.col("p_partkey").alias("feature_idx"), "p_size")
    lake.full_replace("reference_exclusion", part.where("p_size > 40").select("feature_idx"))
    lake.full_replace("reference_exclusion", part.where("p_size = 1").select("feature_idx"))
    return lake.read("reference_exclusion")


@query("SELECT p_partkey AS feature_idx FROM part WHERE p_size = 2 UNION ALL SELECT p_partkey FROM part WHERE p_size = 3")
def register_files(spark, sf):
    lake = _lake(spark)
    part = t(spark, sf, "part").select(F.col("p_partkey").alias("feature_idx"), "p_size")
    for n in (2, 3):
        part.where(F.col("p_size") == n).select("feature_idx").write.parquet(f"{lake.root}/staged{n}")
        lake.register({"reference_exclusion": f"{lake.root}/staged{n}"})
    return lake.read("reference_exclusion")


@query("SELECT p_partkey, CASE WHEN p_size = 5 THEN 'new' ELSE p_brand END AS p_brand FROM part WHERE p_size <> 7")
def update_and_delete(spark, sf):
    part = t(spark, sf, "part").select("p_partkey", "p_brand", "p_size")
    fresh = part.where("p_size = 5").select("p_partkey", F.lit("new").alias("p_brand"))
    return mutations.delete_using(mutations.update_from(part, fresh, "p_partkey", "p_brand"), part.where("p_size = 7"), ["p_partkey"]).select("p_partkey", "p_brand")


@query("SELECT p_brand AS k, count(*) AS n FROM part WHERE p_size < 10 GROUP BY p_brand UNION ALL SELECT DISTINCT p_brand, 0 FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_size < 10)")
def insert_if_missing(spark, sf):
    part = t(spark, sf, "part")
    have = part.where("p_size < 10").groupBy(F.col("p_brand").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return mutations.insert_missing(have, part.select(F.col("p_brand").alias("k"), F.lit(0).cast("long").alias("n")).distinct(), ["k"])


# the lake's tables and surfaces --------------------------------------------------------------------

#: Stand-ins for the lake's tables, by DuckDB; ``_stand_ins`` has the same rows.
_LAKE = """reference_membership AS (SELECT DISTINCT l_suppkey % 5 AS reference_idx, l_partkey AS feature_idx FROM lineitem WHERE l_linenumber < 3),
  reference_sequences AS (SELECT p_partkey AS feature_idx, md5(p_name) AS sequence_hash, CAST(p_size AS BIGINT) AS sequence_length_bp FROM part),
  reference_sequence_chunks AS (SELECT p_partkey AS feature_idx, CAST(i AS INT) AS chunk_index, CASE i WHEN 0 THEN p_name ELSE p_brand END AS chunk_data FROM part, (SELECT unnest([0, 1]) AS i)),
  reference_exclusion AS (SELECT p_partkey AS feature_idx FROM part WHERE p_size = 1),
  reference_taxonomy AS (SELECT p_size % 5 AS reference_idx, p_partkey AS feature_idx, p_type AS domain, p_brand AS phylum FROM part),
  reference_phylogeny AS (SELECT o_orderkey % 5 AS reference_idx, o_orderkey AS node_index, o_orderkey // 2 AS parent_index, o_orderstatus = 'O' AS is_tip FROM orders),
  reference_placements AS (SELECT l_suppkey % 5 AS reference_idx, l_partkey AS feature_idx, CAST(l_linenumber AS INT) AS edge_num, l_quantity AS likelihood FROM lineitem),
  reference_annotation AS (SELECT l_orderkey * 10 + l_linenumber AS annotation_idx, l_suppkey % 5 AS reference_idx, l_partkey AS feature_idx, l_suppkey AS parent_feature_idx, l_returnflag AS source FROM lineitem),
  "read" AS (SELECT o_custkey % 20 AS prep_sample_idx, o_orderkey AS sequence_idx, 'r' || o_orderkey AS read_id, o_orderpriority AS sequence1, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus || 'ACGT' END AS sequence2 FROM orders),
  read_mask AS (SELECT m AS mask_idx, prep_sample_idx, sequence_idx, CASE (sequence_idx + m) % 4 WHEN 0 THEN 'qc_length' WHEN 1 THEN 'host_rype' ELSE 'pass' END AS reason,
                       sequence_idx % 3 AS left_trim1, sequence_idx % 2 AS right_trim1, CASE WHEN sequence2 IS NOT NULL THEN 1 END AS left_trim2, CASE WHEN sequence2 IS NOT NULL THEN 2 END AS right_trim2
                FROM "read", (SELECT unnest([1, 2]) AS m)),
  alignment AS (SELECT l_linenumber % 3 AS alignment_idx, l_suppkey % 20 AS prep_sample_idx, l_orderkey AS sequence_idx, l_partkey AS feature_idx, CAST(l_linenumber AS INT) AS flags, l_orderkey AS position, l_orderkey + 9 AS stop_position FROM lineitem),
  read_masked AS (SELECT mask_idx, prep_sample_idx, sequence_idx, read_id, substr(sequence1, left_trim1 + 1, greatest(length(sequence1) - left_trim1 - right_trim1, 0)) AS sequence1,
                         substr(sequence2, left_trim2 + 1, greatest(length(sequence2) - left_trim2 - right_trim2, 0)) AS sequence2
                  FROM "read" JOIN read_mask USING (prep_sample_idx, sequence_idx) WHERE reason = 'pass')"""


def _stand_ins(spark, sf):
    """The lake's tables by name; what the driver's tables have no counterpart for is null."""
    part, line, orders = (t(spark, sf, x) for x in ("part", "lineitem", "orders"))
    c, long = F.col, lambda x: F.col(x).cast("long")
    second = F.when(c("o_orderkey") % 3 == 0, F.concat("o_orderstatus", F.lit("ACGT")))
    k = (c("sequence_idx") + c("mask_idx")) % 4
    reads = orders.select((c("o_custkey") % 20).alias("prep_sample_idx"), c("o_orderkey").alias("sequence_idx"), F.concat(F.lit("r"), c("o_orderkey").cast("string")).alias("read_id"), c("o_orderpriority").alias("sequence1"), second.alias("sequence2"))
    mated = c("sequence2").isNotNull()
    made = {
        "reference_membership": lambda: line.where("l_linenumber < 3").select((c("l_suppkey") % 5).alias("reference_idx"), c("l_partkey").alias("feature_idx")).distinct(),
        "reference_sequences": lambda: part.select(c("p_partkey").alias("feature_idx"), F.md5("p_name").alias("sequence_hash"), long("p_size").alias("sequence_length_bp")),
        "reference_sequence_chunks": lambda: part.select(c("p_partkey").alias("feature_idx"), F.posexplode(F.array("p_name", "p_brand")).alias("chunk_index", "chunk_data")),
        "reference_exclusion": lambda: part.where("p_size = 1").select(c("p_partkey").alias("feature_idx")),
        "reference_taxonomy": lambda: part.select((c("p_size") % 5).alias("reference_idx"), c("p_partkey").alias("feature_idx"), c("p_type").alias("domain"), c("p_brand").alias("phylum")),
        "reference_phylogeny": lambda: orders.select((c("o_orderkey") % 5).alias("reference_idx"), c("o_orderkey").alias("node_index"), F.expr("o_orderkey div 2").alias("parent_index"), (c("o_orderstatus") == "O").alias("is_tip")),
        "reference_placements": lambda: line.select((c("l_suppkey") % 5).alias("reference_idx"), c("l_partkey").alias("feature_idx"), c("l_linenumber").alias("edge_num"), c("l_quantity").alias("likelihood")),
        "reference_annotation": lambda: line.select((c("l_orderkey") * 10 + c("l_linenumber")).alias("annotation_idx"), (c("l_suppkey") % 5).alias("reference_idx"), c("l_partkey").alias("feature_idx"), c("l_suppkey").alias("parent_feature_idx"), c("l_returnflag").alias("source")),
        "read": lambda: reads,
        "read_mask": lambda: reads.select(F.explode(F.array(F.lit(1), F.lit(2))).alias("mask_idx"), "prep_sample_idx", "sequence_idx", "sequence2").select("mask_idx", "prep_sample_idx", "sequence_idx", F.when(k == 0, "qc_length").when(k == 1, "host_rype").otherwise("pass").alias("reason"), (c("sequence_idx") % 3).alias("left_trim1"), (c("sequence_idx") % 2).alias("right_trim1"), F.when(mated, F.lit(1)).alias("left_trim2"), F.when(mated, F.lit(2)).alias("right_trim2")),
        "alignment": lambda: line.select((c("l_linenumber") % 3).alias("alignment_idx"), (c("l_suppkey") % 20).alias("prep_sample_idx"), c("l_orderkey").alias("sequence_idx"), c("l_partkey").alias("feature_idx"), c("l_linenumber").alias("flags"), c("l_orderkey").alias("position"), (c("l_orderkey") + 9).alias("stop_position")),
    }

    def table(name: str) -> DataFrame:
        df = made[name]()
        return df.select([(c(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema(name)])

    return table


def _surface(name: str, columns: str, where: dict, members: list = (), sql: str | None = None):
    """Registers a query over one surface; ``columns`` are those the stand-ins fill."""
    terms = [f"{c} IN ({', '.join(map(str, v))})" for c, v in where.items()]
    if members:
        terms.append("(" + " OR ".join(f"(prep_sample_idx = {o} AND sequence_idx BETWEEN {a} AND {b})" for o, a, b in members) + ")")
    source = {"read_block": '"read"', "read_masked_block": "read_masked", "reference_taxonomy_visible": "reference_taxonomy", "alignment_visible": "alignment"}.get(name, name)
    terms += ["feature_idx NOT IN (SELECT feature_idx FROM reference_exclusion)"] * name.endswith("_visible")

    def run(spark, sf):
        return slices.fetch(_stand_ins(spark, sf), name, where, members).select(columns.split(", "))

    QUERIES[f"surface_{name}"] = run
    SQL[f"surface_{name}"] = f"WITH {_LAKE} " + (sql or f"SELECT {columns} FROM {source} WHERE {' AND '.join(terms)}")


_IN_BLOCK = [(1, 1, 3000), (1, 2000, 5000), (4, 100, 9000), (7, 1, 60000)]
_surface("reference_sequences", "feature_idx, sequence_hash, sequence_length_bp", {"reference_idx": [1, 3]}, sql="SELECT t.* FROM reference_sequences t JOIN reference_membership m ON t.feature_idx = m.feature_idx WHERE m.reference_idx IN (1, 3)")
_surface("reference_sequence_chunks", "feature_idx, chunk_index, chunk_data", {"reference_idx": [2], "feature_idx": [1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144]}, sql="SELECT t.* FROM reference_sequence_chunks t JOIN reference_membership m ON t.feature_idx = m.feature_idx WHERE m.reference_idx IN (2) AND t.feature_idx IN (1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144)")
_surface("reference_taxonomy_visible", "reference_idx, feature_idx, domain, phylum", {"reference_idx": [1, 2]})
_surface("reference_phylogeny", "reference_idx, node_index, parent_index, is_tip", {"reference_idx": [0], "node_index": list(range(5, 4000, 35))})
_surface("reference_placements", "reference_idx, feature_idx, edge_num, likelihood", {"reference_idx": [4]})
_surface("reference_annotation", "annotation_idx, reference_idx, feature_idx, parent_feature_idx, source", {"reference_idx": [1], "parent_feature_idx": [1, 6]})
_surface("read_masked", "mask_idx, prep_sample_idx, sequence_idx, read_id, sequence1, sequence2", {"mask_idx": [2], "prep_sample_idx": [3, 4]})
_surface("alignment_visible", "prep_sample_idx, sequence_idx, feature_idx, flags, position, stop_position", {"alignment_idx": [1], "prep_sample_idx": [0, 5, 7]})
_surface("read_block", "prep_sample_idx, sequence_idx, read_id, sequence1, sequence2", {}, _IN_BLOCK)
_surface("read_masked_block", "prep_sample_idx, sequence_idx, read_id, sequence1, sequence2", {"mask_idx": [1]}, _IN_BLOCK)


@query(f"WITH {_LAKE} SELECT count(*) AS n FROM read_mask WHERE mask_idx = 1 AND prep_sample_idx = 3 AND reason = 'pass'")
def masked_count(spark, sf):
    return masks.pass_count(_stand_ins(spark, sf)("read_mask"), 1, 3)


def _filled(spark, sf, *names):
    lake, tables = _lake(spark), _stand_ins(spark, sf)
    lake.replace({n: tables(n) for n in names})
    return lake


def _counts(lake, deleted: dict[str, int]):
    """Of each table the rows that went and those that are left."""
    out = None
    for name, n in sorted(deleted.items()):
        row = lake.read(name).agg(F.count(F.lit(1)).alias("left_rows")).select(F.lit(name).alias("name"), F.lit(n).cast("long").alias("deleted"), "left_rows")
        out = row if out is None else out.unionByName(row)
    return out


_REFERENCE = ("reference_taxonomy", "reference_phylogeny", "reference_membership", "reference_placements", "reference_annotation")


@query(f"""WITH {_LAKE},
  mine AS (SELECT feature_idx FROM reference_membership WHERE reference_idx = 2 UNION SELECT feature_idx FROM reference_annotation WHERE reference_idx = 2),
  rest AS (SELECT feature_idx FROM reference_membership WHERE reference_idx <> 2 UNION SELECT feature_idx FROM reference_annotation WHERE reference_idx <> 2),
  orphan AS (SELECT feature_idx FROM mine EXCEPT SELECT feature_idx FROM rest)
  """ + " UNION ALL ".join([f"SELECT '{x}' AS name, count(*) FILTER (WHERE reference_idx = 2) AS deleted, count(*) FILTER (WHERE reference_idx <> 2) AS left_rows FROM {x}" for x in _REFERENCE] + [f"SELECT '{x}', count(*) FILTER (WHERE feature_idx IN (FROM orphan)), count(*) FILTER (WHERE feature_idx NOT IN (FROM orphan)) FROM {x}" for x in ("reference_sequences", "reference_sequence_chunks")]))
def lake_delete_reference(spark, sf):
    lake = _filled(spark, sf, "reference_sequences", "reference_sequence_chunks", *_REFERENCE)
    return _counts(lake, lake.delete_reference(2))


@query(f"WITH {_LAKE} SELECT 'read_mask' AS name, count(*) FILTER (WHERE mask_idx = 1) AS deleted, count(*) FILTER (WHERE mask_idx <> 1) AS left_rows FROM read_mask")
def lake_delete_mask(spark, sf):
    lake = _filled(spark, sf, "read_mask")
    return _counts(lake, {"read_mask": lake.delete_mask(1)})


@query(f"WITH {_LAKE} " + " UNION ALL ".join(f"""SELECT '{x}' AS name, count(*) FILTER (WHERE prep_sample_idx IN (2, 3, 5)) AS deleted, count(*) FILTER (WHERE prep_sample_idx NOT IN (2, 3, 5)) AS left_rows FROM "{x}" """ for x in ("read", "read_mask")))
def lake_delete_pool_reads(spark, sf):
    lake = _filled(spark, sf, "read", "read_mask")
    return _counts(lake, lake.delete_pool_reads([2, 3, 5]))


_HIT = "(" + " OR ".join(f"(prep_sample_idx = {o} AND sequence_idx BETWEEN {a} AND {b})" for o, a, b in _IN_BLOCK) + ")"


@query(f"""WITH {_LAKE} SELECT 'read_mask' AS name, count(*) FILTER (WHERE mask_idx = 2 AND {_HIT}) AS deleted, count(*) FILTER (WHERE NOT (mask_idx = 2 AND {_HIT})) AS left_rows FROM read_mask
  UNION ALL SELECT 'alignment', count(*) FILTER (WHERE alignment_idx = 1 AND {_HIT}), count(*) FILTER (WHERE NOT (alignment_idx = 1 AND {_HIT})) FROM alignment""")
def lake_delete_block(spark, sf):
    lake = _filled(spark, sf, "read_mask", "alignment")
    return _counts(lake, {"read_mask": lake.delete_block("read_mask", "mask_idx", 2, _IN_BLOCK), "alignment": lake.delete_block("alignment", "alignment_idx", 1, _IN_BLOCK)})


@query(f"""WITH {_LAKE} SELECT prep_sample_idx, sequence_idx, read_id, sequence1, sequence2 FROM "read" WHERE prep_sample_idx = 6""")
def sample_export(spark, sf):
    """One sample's reads, exported and read back."""
    from ..sources import sinks

    at = f"{shared_dir(spark)}/export-{uuid.uuid4().hex}"
    sinks.export_sample(_stand_ins(spark, sf), 6, at)
    return spark.read.parquet(at).drop("qual1", "qual2")
