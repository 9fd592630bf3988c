"""Reference loading: taxonomy, phylogeny, annotations, exclusion, orphans, identifiers."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_dir, written

#: Rank prefixes of a lineage text, in order: fixed values of the format.
RANKS = {"d": "domain", "p": "phylum", "c": "class", "o": "order", "f": "family", "g": "genus", "s": "species", "t": "strain"}


def ranks(taxonomy: DataFrame, text: str = "taxonomy", separator: str = r";\s*") -> DataFrame:
    """A column for each rank of ``d__…; p__…``; ranks that are missing or empty are null."""
    parts = F.split(F.col(text), separator)
    out = taxonomy
    for prefix, name in RANKS.items():
        mark = F.lit(prefix + "__")
        own = F.get(F.filter(parts, lambda x: F.startswith(x, mark)), F.lit(0))  # noqa: B023 - used at once
        out = out.withColumn(name, F.nullif(F.substr(own, F.lit(4)), F.lit("")))
    return out


def bad_lineages(taxonomy: DataFrame, text: str = "taxonomy", separator: str = r";\s*") -> DataFrame:
    """Rows with more ranks than there are, or a rank whose prefix isn't the one of its place."""
    wanted = F.array(*[F.lit(p + "__") for p in RANKS])
    parts = F.split(F.col(text), separator)
    wrong = F.exists(F.zip_with(parts, F.slice(wanted, 1, F.least(F.size(parts), F.lit(len(RANKS)))), lambda x, w: ~F.coalesce(F.startswith(x, w), F.lit(False))), lambda b: b)
    return taxonomy.where((F.size(parts) > len(RANKS)) | wrong)


def one_per_feature(taxonomy: DataFrame, key: str) -> DataFrame:
    """A feature that is listed several times keeps its least row, so that joins don't multiply it."""
    rest = [c for c in taxonomy.columns if c != key]
    return taxonomy.groupBy(key).agg(F.min(F.struct(*rest)).alias("__row")).select(key, *[F.col(f"__row.`{c}`").alias(c) for c in rest])


def padded(features: DataFrame, taxonomy: DataFrame, key: str) -> DataFrame:
    """One row for each feature; without taxonomy its ranks are null."""
    return features.join(one_per_feature(taxonomy, key), key, "left")


def first_by(rows: DataFrame, by: list, order: list) -> DataFrame:
    """One row of each group: the first in ``order``, which must decide."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("__n = 1").drop("__n")


def orphans(own: list[DataFrame], others: list[DataFrame]) -> DataFrame:
    """Keys listed by any of ``own`` and none of ``others``."""
    return reduce(DataFrame.union, own).subtract(reduce(DataFrame.union, others))


def resolved_exclusion(direct: DataFrame, genomes: DataFrame, membership: DataFrame, feature: str, genome: str) -> DataFrame:
    """Features blocked themselves or through their genome, once each."""
    return direct.select(feature).union(membership.join(genomes, genome, "left_semi").select(feature)).distinct()


def minted(existing: DataFrame, wanted: DataFrame, key: str, ident: str) -> DataFrame:
    """(key, ident) for every wanted key: known ones keep theirs, new ones follow the largest, in key order. Repeating it changes nothing."""
    fresh = wanted.select(key).where(F.col(key).isNotNull()).distinct().join(existing, key, "left_anti")
    top = existing.agg(F.coalesce(F.max(ident), F.lit(0)).alias("__top"))
    numbered = dense_numbers(fresh, key, "__n")
    placed = numbered.crossJoin(F.broadcast(top)).select(key, (F.col("__top") + F.col("__n")).cast("long").alias(ident))  # one row: the largest id
    return existing.join(wanted.select(key).distinct(), key, "left_semi").select(key, ident).unionByName(placed)


def running(rows: DataFrame, key: str, value: Column, name: str, partitions: int | None = None) -> DataFrame:
    """``rows`` with the running sum of ``value`` (a long) up to and with each row, in the order of a unique key.

    No task sees all rows: ranges of the key are written with their number, so that their sizes and
    their rows are read from one and the same cut, summed apart, and shifted by the sums before them.
    """
    n = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(rows.withColumn("__v", value).repartitionByRange(n, key).withColumn("__p", F.spark_partition_id()), "ranges")
    sums = ranged.groupBy("__p").agg(F.sum("__v").alias("__sum"))  # a row per range
    before = sums.select("__p", F.coalesce(F.sum("__sum").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    within = F.sum("__v").over(Window.partitionBy("__p").orderBy(key).rowsBetween(Window.unboundedPreceding, 0))
    return ranged.withColumn("__i", within).join(F.broadcast(before), "__p").withColumn(name, F.col("__i") + F.col("__before")).drop("__p", "__v", "__i", "__before")


def dense_numbers(rows: DataFrame, key: str, name: str, partitions: int | None = None) -> DataFrame:
    """1, 2, … in the order of a unique key."""
    return running(rows, key, F.lit(1).cast("long"), name, partitions)


def descendants(edges: DataFrame, root: int, node: str = "node_index", parent: str = "parent_index") -> DataFrame:
    """Nodes under ``root``, itself included. Jumps double each round, so the rounds grow with the logarithm of the depth; circles end too."""
    jump = written(edges.select(F.col(node).cast("long").alias("node"), F.col(parent).cast("long").alias("up")).where("up is not null and node <> up").distinct(), "jumps")
    found = edges.sparkSession.createDataFrame([(int(root),)], "node long")
    steps = jump.count()
    while steps:
        near = jump.join(found.withColumnRenamed("node", "up"), "up", "left_semi").select("node")
        found = written(found.union(near).distinct(), "clade")
        further = jump.withColumnRenamed("up", "via").join(jump.select(F.col("node").alias("via"), F.col("up")), "via").select("node", "up").distinct()
        jump, steps = written(further, "jumps"), steps // 2
        if jump.isEmpty():
            break
    return found


def closure(edges: DataFrame, node: str, parent: str, levels: int | None = None) -> DataFrame:
    """(ancestor, descendant, distance) up to ``levels``, each node at distance 0 to itself; of several paths the shortest.

    Without ``levels`` it goes on until nothing is added. Where no node has two parents, as in a tree, each node's way up is one array
    and ways double; otherwise a step of all pairs follows the other, each written to the shared folder. Circles end too.
    """
    e = edges.select(F.col(node).alias("descendant"), F.col(parent).alias("ancestor")).where("descendant <> ancestor").distinct()
    if levels is None:
        e = written(e, "edges")
        if e.groupBy("descendant").count().where("count > 1").isEmpty():
            return _ways_up(e)
    out = e.select("descendant").union(e.select("ancestor")).distinct().select(F.col("descendant").alias("ancestor"), "descendant", F.lit(0).alias("distance"))
    step = e.select("ancestor", "descendant", F.lit(1).alias("distance"))
    if levels is None:
        spark = edges.sparkSession
        at, n = f"{shared_dir(spark)}/closure-{uuid.uuid4().hex}", 0

        def kept(df: DataFrame, what: str) -> DataFrame:
            df.write.parquet(f"{at}/{what}")
            return spark.read.schema(df.schema).parquet(f"{at}/{what}")

        out, step = kept(out, "pairs/n=0"), kept(step, "pairs/n=1")
        while not step.isEmpty():
            out, n = out.unionByName(step), n + 1
            further = step.withColumnRenamed("ancestor", "via").join(e.select(F.col("descendant").alias("via"), "ancestor"), "via").select("ancestor", "descendant").distinct()
            step = kept(further.join(out, ["ancestor", "descendant"], "left_anti").withColumn("distance", F.lit(n + 1)), f"pairs/n={n + 1}")
        return out
    out = out.unionByName(step)
    for _ in range(levels - 1):
        step = step.withColumnRenamed("ancestor", "via").join(e.select(F.col("descendant").alias("via"), "ancestor"), "via").select("ancestor", "descendant", (F.col("distance") + 1).alias("distance"))
        out = out.unionByName(step)
    return out.groupBy("ancestor", "descendant").agg(F.min("distance").alias("distance"))


def _ways_up(e: DataFrame) -> DataFrame:
    """``closure`` of edges (descendant, ancestor) that give each node one parent at most.

    A way up is an array of a node's ancestors, nearest first. A round appends to each way that is open the way of
    its last node, so ways double. Only ways of nodes that are last on another are looked up; these become few, and
    then no way is shuffled. A way shuts at a root, or where a circle comes back to a node that it holds. Pairs are
    made of the ways at the very end and never shuffled.
    """
    open_ = e.select("descendant", F.array("ancestor").alias("up"))
    shut: list[DataFrame] = []
    every = open_
    while True:
        last = written(open_.select(F.element_at("up", -1).alias("last")).distinct(), "last")
        ways = every if shut else open_.withColumn("goes_on", F.lit(True))
        further = written(ways.join(last, F.col("descendant") == F.col("last"), "left_semi").select(F.col("descendant").alias("last"), F.col("up").alias("more"), "goes_on"), "further")
        joined = open_.withColumn("last", F.element_at("up", -1)).join(further, "last", "left")
        longer = F.concat("up", F.coalesce("more", F.array().cast(open_.schema["up"].dataType)))
        once = F.array_distinct(F.concat(F.array("descendant"), longer))
        told = joined.select("descendant", F.slice(once, 2, F.size(once)).alias("up"), (F.coalesce("goes_on", F.lit(False)) & (F.size(once) == F.size(longer) + 1)).alias("goes_on"))
        told = written(told, "ways")
        shut.append(told.where("not goes_on").select("descendant", "up"))
        open_ = told.where("goes_on").select("descendant", "up")
        every = reduce(DataFrame.union, shut).withColumn("goes_on", F.lit(False)).union(open_.withColumn("goes_on", F.lit(True)))
        if open_.isEmpty():
            break
    tops = e.select(F.col("ancestor").alias("top")).distinct().join(e, F.col("top") == F.col("descendant"), "left_anti").select(F.col("top").alias("ancestor"), F.col("top").alias("descendant"), F.lit(0).alias("distance"))
    ways = reduce(DataFrame.union, shut)
    pairs = ways.select("descendant", F.posexplode(F.concat(F.array("descendant"), "up")).alias("distance", "ancestor")).select("ancestor", "descendant", "distance")
    return tops.unionByName(pairs)


def xrefs(rows: DataFrame, listing: str, keep: list[str]) -> DataFrame:
    """keep, source, accession: each comma-separated entry, parted at its first colon; entries without one have no source."""
    each = rows.select(*keep, F.explode(F.split(F.col(listing), ",")).alias("x")).withColumn("x", F.btrim("x")).where("x <> ''")
    at = F.instr(F.col("x"), ":")
    return each.select(*keep, F.when(at > 0, F.substring_index("x", ":", 1)).alias("source"), F.when(at > 0, F.expr("substring(x, instr(x, ':') + 1)")).otherwise(F.col("x")).alias("accession"))


def representative(rows: DataFrame, by: str, value: str, order: str) -> DataFrame:
    """Of each group the value of its least ``order`` that isn't empty; null if all are."""
    return rows.groupBy(by).agg(F.min_by(value, F.when(F.col(value) != "", F.col(order))).alias(value))


#: Bytes of digests that are handed on as one row.
PACK_BYTES = 1 << 13


def set_digest(rows: DataFrame, by: str, digest: str) -> DataFrame:
    """SHA-256 over a group's sorted distinct digests (hex), so that equal sets have equal digests.

    Groups are sorted in ranges over all tasks, which pack runs of some ``PACK_BYTES``; then one state for
    a group is fed its runs in order, so that memory doesn't grow with a group and a set of 50 million digests is some 200,000
    rows for its task. Null digests count for nothing (a group of nothing else has the digest of no bytes); one that isn't hex fails the job.
    """
    from ..session import ship

    ship(rows.sparkSession)
    raw = F.when(F.col("__d").isNotNull(), F.coalesce(F.unhex("__d"), F.raise_error(F.concat(F.lit("not hex: "), F.col("__d"))).cast("binary")))
    each = rows.select(F.col(by).alias("__by"), F.col(digest).alias("__d")).distinct()
    ranged = each.repartitionByRange("__by", "__d").sortWithinPartitions("__by", "__d").select("__by", "__d", raw.alias("__raw"))
    kind = rows.schema[by].dataType.simpleString()
    packs = ranged.mapInArrow(_packed, f"`__by` {kind}, `__d` string, `__raw` binary")
    fed = packs.repartition("__by").sortWithinPartitions("__by", "__d").mapInArrow(_fed, f"`__by` {kind}, set_digest string")
    return fed.withColumnRenamed("__by", by)


def _runs(by):
    """(first, end) of each run of equal values of an Arrow column; nulls are equal to each other."""
    import pyarrow.compute as pc

    n = len(by)
    if not n:
        return
    a, b = by.slice(1), by.slice(0, n - 1)
    differs = pc.if_else(pc.or_(pc.is_null(a), pc.is_null(b)), pc.xor(pc.is_null(a), pc.is_null(b)), pc.not_equal(a, b))
    cuts = [0, *(pc.indices_nonzero(differs).to_numpy() + 1).tolist(), n]
    yield from zip(cuts, cuts[1:])


def _packed(batches):
    """Runs of one group's digests, each as one value beside its least digest, which keeps their order."""
    import pyarrow as pa

    for batch in batches:
        by, digest, raw = batch.columns
        out = []
        for first, end in _runs(by):
            step = max(1, PACK_BYTES * (end - first) // max(1, raw.slice(first, end - first).nbytes))
            for at in range(first, end, step):
                n = min(step, end - at)
                out.append((at, b"".join(x for x in raw.slice(at, n).to_pylist() if x is not None)))
        if out:
            places = pa.array([at for at, _ in out], pa.int64())
            yield pa.RecordBatch.from_arrays([by.take(places), digest.take(places), pa.array([x for _, x in out], pa.binary())], ["__by", "__d", "__raw"])


def _fed(batches):
    """A group's packs in order through one state."""
    import hashlib

    import pyarrow as pa

    state = group = None
    for batch in batches:
        by, _, raw = batch.columns
        done = []
        for first, end in _runs(by):
            here = by.slice(first, 1)
            if state is not None and not here.equals(group):
                done.append((group, state.hexdigest()))
                state = None
            if state is None:
                state, group = hashlib.sha256(), here
            for at in range(first, end):
                state.update(raw[at].as_py())
        if done:
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([g for g, _ in done]), pa.array([x for _, x in done])], ["__by", "set_digest"])
    if state is not None:
        yield pa.RecordBatch.from_arrays([group, pa.array([state.hexdigest()])], ["__by", "set_digest"])
