"""Further registered queries: filters, joins, aggregates, set operations and changes of the read models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import masks, mutations, planning, reference
from .catalogue import query, t

# filters -----------------------------------------------------------------------------------------


@query("SELECT o_orderkey FROM orders WHERE CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderstatus END IS DISTINCT FROM 'F'")
def null_safe_inequality(spark, sf):
    state = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus"))
    return t(spark, sf, "orders").where(~state.eqNullSafe(F.lit("F"))).select("o_orderkey")


@query("SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%' || 'a_t' || '%'")
def partial_match(spark, sf):
    return t(spark, sf, "part").where(F.col("p_name").like("%a_t%")).select("p_partkey", "p_name")


@query("SELECT page_id FROM pages WHERE regexp_full_match(url, 'https?://[a-z.-]+/en/[0-9]+(\\.html)?')")
def regex_full_match(spark, sf):
    return t(spark, sf, "pages").where(F.col("url").rlike(r"^https?://[a-z.-]+/en/[0-9]+(\.html)?$")).select("page_id")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P'")
def optional_filters(spark, sf):
    """Conditions are added only where a value is given."""
    asked = {"o_orderstatus": "P", "o_custkey": None, "o_orderpriority": None}
    rows = t(spark, sf, "orders")
    for column, value in asked.items():
        if value is not None:
            rows = rows.where(F.col(column) == value)
    return rows.select("o_orderkey")


@query("""SELECT o_orderkey FROM orders WHERE (CASE WHEN o_orderkey % 4 <> 0 THEN o_orderdate END IS NULL OR o_orderdate > TIMESTAMP '1995-06-01') AND NOT o_orderstatus = 'F'""")
def temporal_validity(spark, sf):
    expires = F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderdate"))
    valid = expires.isNull() | (expires > F.expr("timestamp'1995-06-01'"))
    return t(spark, sf, "orders").where(valid & (F.col("o_orderstatus") != "F")).select("o_orderkey")


@query("SELECT vec_id FROM embeddings WHERE label IN (1, 2) AND label NOT IN (3)")
def array_membership(spark, sf):
    return t(spark, sf, "embeddings").where(F.array_contains(F.array(F.lit(1), F.lit(2)), F.col("label")) & ~F.array_contains(F.array(F.lit(3)), F.col("label"))).select("vec_id")


@query("SELECT o_orderkey, TRY_CAST(o_orderpriority[1:1] AS INT) AS level FROM orders")
def lenient_cast(spark, sf):
    return t(spark, sf, "orders").select("o_orderkey", F.substring("o_orderpriority", 1, 1).try_cast("int").alias("level"))


# joins -------------------------------------------------------------------------------------------


@query("""SELECT l_orderkey, l_linenumber, p_name, s_name FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey WHERE p_size < 3""")
def star_join(spark, sf):
    part = t(spark, sf, "part").where("p_size < 3")
    rows = t(spark, sf, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).join(t(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.select("l_orderkey", "l_linenumber", "p_name", "s_name")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def semi_join(spark, sf):
    urgent = t(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"))
    return t(spark, sf, "lineitem").join(urgent, "l_orderkey", "left_semi").select("l_orderkey", "l_linenumber")


@query("""SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AS has_failed,
                 EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS has_completed FROM customer""")
def exists_flags(spark, sf):
    flags = t(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.bool_or(F.col("o_orderstatus") == "P").alias("p"), F.bool_or(F.col("o_orderstatus") == "F").alias("f"))
    none = F.lit(False)
    return t(spark, sf, "customer").select("c_custkey").join(flags, "c_custkey", "left").select("c_custkey", F.coalesce("p", none).alias("has_failed"), F.coalesce("f", none).alias("has_completed"))


@query("""SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON c_custkey = coalesce(CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey % 100 END, o_custkey)""")
def computed_key_join(spark, sf):
    own = t(spark, sf, "orders").withColumn("c_custkey", F.coalesce(F.when(F.col("o_orderkey") % 5 == 0, F.col("o_orderkey") % 100), F.col("o_custkey")))
    return own.join(t(spark, sf, "customer"), "c_custkey", "left").select("o_orderkey", "c_name")


@query("""SELECT o_orderkey FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority = '1-URGENT' OR c_nationkey = 3
             OR EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_suppkey = 7)""")
def disjunction_of_memberships(spark, sf):
    """Directly, through the joined row, or through any member: three key sets instead of one OR."""
    orders = t(spark, sf, "orders")
    direct = orders.where("o_orderpriority = '1-URGENT'").select("o_orderkey")
    joined = orders.join(t(spark, sf, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_semi").select("o_orderkey")
    member = t(spark, sf, "lineitem").where("l_suppkey = 7").select(F.col("l_orderkey").alias("o_orderkey"))
    return orders.join(direct.union(joined).union(member).distinct(), "o_orderkey", "left_semi").select("o_orderkey")


@query("""SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')
             AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '5-LOW')""")
def lacking_both(spark, sf):
    orders = t(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey")
    rows = mutations.delete_using(t(spark, sf, "customer"), orders.where("o_orderstatus = 'P'"), ["c_custkey"])
    return mutations.delete_using(rows, orders.where("o_orderpriority = '5-LOW'"), ["c_custkey"]).select("c_custkey")


@query("""SELECT c_custkey, CASE WHEN c_acctbal > 9000 THEN 'owner' WHEN g.k IS NOT NULL THEN 'editor' WHEN v.k IS NOT NULL THEN 'viewer' ELSE 'none' END AS role FROM customer
          LEFT JOIN (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_totalprice > 300000) g ON g.k = c_custkey
          LEFT JOIN (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_totalprice > 100000) v ON v.k = c_custkey""")
def effective_role(spark, sf):
    orders = t(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey")
    rows = t(spark, sf, "customer").select("c_custkey", "c_acctbal", F.lit("none").alias("role"))
    granted = masks.with_precedence(rows, [(orders.where("o_totalprice > 300000"), "editor"), (orders.where("o_totalprice > 100000"), "viewer")], "c_custkey", "role")
    return granted.select("c_custkey", F.when(F.col("c_acctbal") > 9000, "owner").otherwise(F.col("role")).alias("role"))


# aggregates --------------------------------------------------------------------------------------


@query("SELECT count(*) AS reads, count(CASE WHEN l_linenumber % 2 = 0 THEN 1 END) AS mates FROM lineitem")
def read_count(spark, sf):
    return t(spark, sf, "lineitem").agg(F.count(F.lit(1)).alias("reads"), F.count(F.when(F.col("l_linenumber") % 2 == 0, 1)).alias("mates"))


@query("SELECT text, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1")
def duplicate_groups(spark, sf):
    return t(spark, sf, "documents").groupBy("text").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("SELECT l_suppkey, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_orderkey) AS orders FROM lineitem GROUP BY l_suppkey")
def distinct_counts(spark, sf):
    return t(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.countDistinct("l_partkey").alias("parts"), F.countDistinct("l_orderkey").alias("orders"))


@query("SELECT o_custkey, string_agg(DISTINCT o_orderpriority, ', ' ORDER BY o_orderpriority) AS priorities FROM orders GROUP BY o_custkey")
def distinct_listing(spark, sf):
    return t(spark, sf, "orders").groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ", ").alias("priorities"))


@query("SELECT l_partkey, min(l_suppkey) AS shard, min(l_shipdate) AS first, max(l_shipdate) AS last FROM lineitem GROUP BY l_partkey")
def extremes(spark, sf):
    return t(spark, sf, "lineitem").groupBy("l_partkey").agg(F.min("l_suppkey").alias("shard"), F.min("l_shipdate").alias("first"), F.max("l_shipdate").alias("last"))


@query("SELECT o_orderstatus AS state, count(*) AS n FROM orders GROUP BY o_orderstatus")
def state_counts(spark, sf):
    return t(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("state")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT o_custkey % 10 AS cohort, count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'O') AS held, count(*) FILTER (WHERE o_orderstatus = 'P') AS running FROM orders GROUP BY o_custkey % 10""")
def cohort_status(spark, sf):
    return t(spark, sf, "orders").groupBy((F.col("o_custkey") % 10).alias("cohort")).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("o_orderstatus") == "O").alias("held"), F.count_if(F.col("o_orderstatus") == "P").alias("running"))


@query("SELECT lang, round(CAST(sum(len(regexp_extract_all(text, '[aeiou]'))) AS DOUBLE) / sum(n_chars), 6) AS share FROM documents GROUP BY lang")
def ratio_of_sums(spark, sf):
    vowels = F.length("text") - F.length(F.translate("text", "aeiou", ""))
    return t(spark, sf, "documents").groupBy("lang").agg(F.round(F.sum(vowels).cast("double") / F.sum("n_chars"), 6).alias("share"))


# sets and series ---------------------------------------------------------------------------------


@query("SELECT c_nationkey AS k FROM customer WHERE c_acctbal < 0 INTERSECT SELECT s_nationkey FROM supplier")
def shared_keys(spark, sf):
    return t(spark, sf, "customer").where("c_acctbal < 0").select(F.col("c_nationkey").alias("k")).intersect(t(spark, sf, "supplier").select("s_nationkey"))


@query("SELECT s_suppkey, CAST(i AS BIGINT) AS shard FROM supplier, range(0, 4) r(i)")
def series_per_row(spark, sf):
    return t(spark, sf, "supplier").select("s_suppkey", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("shard"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE json_extract_string(props, '$.k') = '69'")
def json_field(spark, sf):
    rows = t(spark, sf, "events").withColumn("v", F.get_json_object("props", "$.k"))
    return rows.where("v = '69'").select("event_id", F.col("v").cast("long").alias("k"))


# changes -----------------------------------------------------------------------------------------


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 AND o_orderstatus IN ('O', 'P') THEN 'running' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def compare_and_set(spark, sf):
    rows, _ = mutations.compare_and_set(t(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), F.col("o_orderkey") % 2 == 0, "o_orderstatus", ["O", "P"], "running")
    return rows


@query("SELECT p_partkey, CASE WHEN p_size > 45 THEN 'large' ELSE p_brand END AS p_brand FROM part WHERE p_size < 10 OR p_size > 45")
def upsert(spark, sf):
    part = t(spark, sf, "part")
    return mutations.upsert(part.where("p_size < 10").select("p_partkey", "p_brand"), part.where("p_size > 45").select("p_partkey", F.lit("large").alias("p_brand")), ["p_partkey"])


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 6 <> 0 AND (o_orderkey % 4 = 0 OR o_orderdate > TIMESTAMP '1996-01-01')")
def expiry_purge(spark, sf):
    rows = t(spark, sf, "orders").withColumn("expires", F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderdate"))).withColumn("consumed", F.when(F.col("o_orderkey") % 6 == 0, F.lit(1)))
    return mutations.purge(rows, "expires", "consumed", F.expr("timestamp'1996-01-01'")).select("o_orderkey")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')")
def cascade_delete(spark, sf):
    doomed = t(spark, sf, "orders").where("o_orderstatus = 'P'")
    left = mutations.cascade(doomed, "o_orderkey", {"lines": (t(spark, sf, "lineitem"), "l_orderkey")})
    return left["lines"].select("l_orderkey", "l_linenumber")


@query("SELECT user_id, string_agg(k || '=' || v, ',' ORDER BY k) AS merged FROM (SELECT user_id, event_type AS k, CASE WHEN bool_or(event_id % 2 = 0) THEN 'new' ELSE 'old' END AS v FROM events GROUP BY user_id, event_type) GROUP BY user_id")
def map_merge(spark, sf):
    def part(odd: int, value: str, name: str):
        rows = t(spark, sf, "events").where(F.col("event_id") % 2 == odd).select("user_id", "event_type").distinct()
        return rows.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", F.lit(value)))).alias(name))

    merged = part(1, "old", "a").join(part(0, "new", "b"), "user_id", "full").withColumn("m", mutations.merged_map(F.col("a"), F.col("b")))
    return merged.select("user_id", F.array_join(F.array_sort(F.transform(F.map_entries("m"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",").alias("merged"))


@query("SELECT p_type, arg_min(p_partkey, (p_size, p_partkey)) AS p_partkey FROM part GROUP BY p_type")
def first_of_group(spark, sf):
    return reference.first_by(t(spark, sf, "part"), ["p_type"], ["p_size", "p_partkey"]).select("p_type", "p_partkey")


@query("SELECT CAST(count(*) FILTER (WHERE n > 5) AS BIGINT) AS large, CAST(count(*) AS BIGINT) AS all_customers FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey)")
def two_level_tally(spark, sf):
    per = t(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.count_if(F.col("n") > 5).alias("large"), F.count(F.lit(1)).alias("all_customers"))


@query("""SELECT shard, count(*) AS n FROM (SELECT CAST((row_number() OVER (ORDER BY c_custkey) * least(count(*) OVER (), 7) - 1) // count(*) OVER () AS BIGINT) AS shard FROM customer) GROUP BY shard""")
def shard_sizes(spark, sf):
    """Even shards differ by one row at most."""
    rows = planning.even_shards(t(spark, sf, "customer").select("c_custkey"), ["c_custkey"], 7)
    return rows.groupBy("shard").agg(F.count(F.lit(1)).alias("n"))
