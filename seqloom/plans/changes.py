"""Registered queries of changes that reach over several tables or into documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import jsontext
from ..operators.cascades import Cascade, Link
from .catalogue import query, t

_DOC = """CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '{}' WHEN 2 THEN '{"' || event_type || '": {"mem_gb": 4, "walltime": ' || event_id || '}, "z": null}'
          ELSE '{"' || event_type || '": null, "other": {"mem_gb": 8, "steps": [1, {"k": 2}]}}' END"""


@query(f"""SELECT event_id, json_extract_string(m, '$.' || event_type || '.mem_gb') AS mem, json_extract_string(m, '$.' || event_type || '.walltime') AS walltime,
                  json_extract_string(m, '$.other.steps[1].k') AS nested, array_to_string(list_sort(json_keys(m)), ',') AS members,
                  CASE WHEN event_id % 4 = 3 THEN CAST(user_id AS VARCHAR) END AS replaced
           FROM (SELECT *, json_merge_patch(COALESCE({_DOC}, '{{}}'), json_object(event_type, json_object('mem_gb', user_id))) AS m FROM events)""")
def json_path_merge(spark, sf):
    """A figure merged into the object that a document holds for the event's kind (null, missing and filled documents and objects), and one replaced only where its parent is there."""
    doc, user = F.expr(_DOC), F.col("user_id").cast("string")
    merged = jsontext.json_merged(doc, F.concat(F.lit('{"mem_gb": '), user, F.lit("}")), [F.col("event_type")])
    rows = t(spark, sf, "events").withColumn("m", merged).withColumn("r", jsontext.json_set(doc, ["other", "mem_gb"], user))
    of = lambda name: F.expr(f"get_json_object(m, '$.' || event_type || '{name}')")
    return rows.select(
        "event_id", of(".mem_gb").alias("mem"), of(".walltime").alias("walltime"), F.get_json_object("m", "$.other.steps[1].k").alias("nested"),
        F.array_join(F.array_sort(F.json_object_keys("m")), ",").alias("members"), F.get_json_object("r", "$.other.mem_gb").alias("replaced"))


@query("SELECT event_id, event_id % 3 <> 0 AS same FROM events")
def json_equality(spark, sf):
    """Documents of one content in two spellings; a third of them differ in a number."""
    a = F.expr("""'{"a": ' || user_id || '.50, "b": [' || event_id || ', null, {"x": 1, "y": 2}]}'""")
    b = F.expr("""'{"b":[' || event_id || ',null,{"y":2,"x":1}],"a":' || (user_id + IF(event_id % 3 = 0, 1, 0)) || '.5}'""")
    return t(spark, sf, "events").select("event_id", jsontext.same_json(a, b).alias("same"))


LINKS = [
    Link("customer", "c_nationkey", "nation", "n_nationkey"),
    Link("supplier", "s_nationkey", "nation", "n_nationkey"),
    Link("orders", "o_custkey", "customer", "c_custkey"),
    Link("lineitem", "l_orderkey", "orders", "o_orderkey"),
    Link("lineitem", "l_suppkey", "supplier", "s_suppkey"),
    Link("events", "user_id", "customer", "c_custkey", "unset"),
    Link("part", "p_partkey", "supplier", "s_suppkey", via=("shipped", "suppkey", "partkey")),
    Link("shipped", "partkey", "part", "p_partkey"),
    Link("shipped", "suppkey", "supplier", "s_suppkey"),
]


@query("""WITH c AS (SELECT c_custkey FROM customer WHERE c_nationkey = 3), s AS (SELECT s_suppkey FROM supplier WHERE s_nationkey = 3), o AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (FROM c)),
            shipped AS (SELECT DISTINCT l_partkey AS partkey, l_suppkey AS suppkey FROM lineitem), p AS (SELECT partkey FROM shipped WHERE suppkey IN (FROM s))
          SELECT 'customer' AS kind, count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS keys FROM customer WHERE c_custkey NOT IN (FROM c)
          UNION ALL SELECT 'supplier', count(*), CAST(sum(s_suppkey) AS BIGINT) FROM supplier WHERE s_suppkey NOT IN (FROM s)
          UNION ALL SELECT 'orders', count(*), CAST(sum(o_orderkey) AS BIGINT) FROM orders WHERE o_orderkey NOT IN (FROM o)
          UNION ALL SELECT 'lineitem', count(*), CAST(sum(l_orderkey * 8 + l_linenumber) AS BIGINT) FROM lineitem WHERE l_orderkey NOT IN (FROM o) AND l_suppkey NOT IN (FROM s)
          UNION ALL SELECT 'events', count(*), CAST(sum(user_id) FILTER (WHERE user_id NOT IN (FROM c)) AS BIGINT) FROM events
          UNION ALL SELECT 'part', count(*), CAST(sum(p_partkey) AS BIGINT) FROM part WHERE p_partkey NOT IN (FROM p)
          UNION ALL SELECT 'shipped', count(*), CAST(sum(partkey * 1000 + suppkey) AS BIGINT) FROM shipped WHERE partkey NOT IN (FROM p) AND suppkey NOT IN (FROM s)""")
def cascade_graph(spark, sf):
    """What a nation leaves behind: its customers and suppliers go with their orders, lines (named by both) and shipments; a part goes with any supplier who ships it; events stay without their customer."""
    tables = {x: t(spark, sf, x) for x in ("nation", "customer", "supplier", "orders", "lineitem", "events", "part")}
    tables["shipped"] = tables["lineitem"].select(F.col("l_partkey").alias("partkey"), F.col("l_suppkey").alias("suppkey")).distinct()
    plan = Cascade(tables, LINKS, "nation", tables["nation"].where("n_nationkey = 3"))
    keys = {"customer": "c_custkey", "supplier": "s_suppkey", "orders": "o_orderkey", "lineitem": "l_orderkey * 8 + l_linenumber", "events": "user_id", "part": "p_partkey", "shipped": "partkey * 1000 + suppkey"}
    each = [plan.left(x).agg(F.lit(x).alias("kind"), F.count(F.lit(1)).alias("n"), F.sum(F.expr(k)).cast("long").alias("keys")) for x, k in keys.items()]
    return reduce(DataFrame.union, each)
