"""Arrow streams, the reporting sink, stream state, cascades over many tables, JSON documents, streamed digests."""

import hashlib
import json
import os
import random
import shutil
import threading

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from seqloom.functions import jsontext
from seqloom.operators import reference
from seqloom.operators.cascades import Cascade, Link, Refused, order
from seqloom.sources import arrow_io, sinks
from seqloom.sources.lake import Lake
from seqloom.streaming import ingest

# Arrow streams -----------------------------------------------------------------------------------

KIND = "k long, v string, w array<int>"


def stream_file(path, batches, end=True):
    schema = pa.schema([("v", pa.large_string()), ("k", pa.int64()), ("more", pa.bool_()), ("w", pa.list_(pa.int32()))])
    with open(path, "wb") as f:
        writer = pa.ipc.new_stream(f, schema)
        for ks in batches:
            writer.write_batch(pa.RecordBatch.from_pylist([{"v": f"t{k}", "k": k, "more": True, "w": [k, None]} for k in ks], schema))
        if end:
            writer.close()
        else:
            f.flush()


def test_streams_are_partitions(spark, tmp_path):
    stream_file(tmp_path / "a.arrows", [range(25), [], range(25, 30)])
    stream_file(tmp_path / "b.arrows", [range(30, 40)])
    stream_file(tmp_path / "c.arrows", [])
    (tmp_path / "other.txt").write_text("not a stream")
    df = arrow_io.arrow_streams(spark, KIND, str(tmp_path), rows=7)
    assert df.rdd.getNumPartitions() == 3
    assert sorted((r.k, r.v, r.w) for r in df.collect()) == [(k, f"t{k}", [k, None]) for k in range(40)]
    (tmp_path / "none").mkdir()
    assert arrow_io.arrow_streams(spark, KIND, str(tmp_path / "none")).count() == 0


def test_batches_are_bounded():
    reader = arrow_io._Streams([], None, 0)
    assert reader.partitions() == []
    kind = pa.schema([("k", pa.int64())])
    with pytest.raises(ValueError, match="no column k"):
        arrow_io._fitted(pa.RecordBatch.from_pydict({"x": [1]}), kind, "here")
    with pytest.raises(ValueError, match="is double"):
        arrow_io._fitted(pa.RecordBatch.from_pydict({"k": [1.0]}), kind, "here")


def test_broken_streams_fail_the_job(spark, tmp_path):
    for name, make in {
        "no end": lambda p: stream_file(p, [range(5)], end=False),
        "cut": lambda p: (stream_file(p, [range(500)]), os.truncate(p, os.path.getsize(p) - 100)),
        "empty": lambda p: p.write_bytes(b""),
    }.items():
        at = tmp_path / name
        at.mkdir()
        make(at / "a.arrows")
        with pytest.raises(Exception, match="no end"):
            arrow_io.arrow_streams(spark, KIND, str(at)).count()
    at = tmp_path / "kind"
    at.mkdir()
    stream_file(at / "a.arrows", [range(3)])
    with pytest.raises(Exception, match="column v is"):
        arrow_io.arrow_streams(spark, "v long", str(at)).collect()


def test_flight_tickets(spark):
    flight = pytest.importorskip("pyarrow.flight")

    class Server(flight.FlightServerBase):
        def do_get(self, context, ticket):
            n = int(ticket.ticket)
            table = pa.table({"k": pa.array(range(n * 10, n * 10 + 10), pa.int64())})
            if n == 9:
                def broken():
                    yield table.to_batches()[0]
                    raise RuntimeError("gone")
                return flight.GeneratorStream(table.schema, broken())
            return flight.RecordBatchStream(table)

    with Server("grpc://127.0.0.1:0") as server:
        threading.Thread(target=server.serve, daemon=True).start()
        where = f"grpc://127.0.0.1:{server.port}"
        df = arrow_io.arrow_streams(spark, "k long", tickets=[(where, b"0"), (where, b"1"), (where, b"2")])
        assert sorted(r.k for r in df.collect()) == list(range(30))
        with pytest.raises(Exception, match="gone"):
            arrow_io.arrow_streams(spark, "k long", tickets=[(where, b"0"), (where, b"9")]).count()


def test_written_streams_come_back(spark, tmp_path):
    df = spark.range(1000).select("id", F.current_timestamp().alias("at"), F.array("id").alias("a"), F.when(F.col("id") % 3 == 0, "x").alias("s"))
    df = spark.createDataFrame(df.collect(), df.schema).repartition(5)
    assert arrow_io.write_streams(df, str(tmp_path / "s")) == 1000
    assert arrow_io.write_streams(df, str(tmp_path / "s")) == 1000  # partitions replace their files
    back = arrow_io.arrow_streams(spark, df.schema, str(tmp_path / "s"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


# the reporting sink ------------------------------------------------------------------------------


def test_tasks_report_what_they_wrote(spark, tmp_path):
    at = str(tmp_path / "w")
    told = arrow_io.reported(spark.range(100_000).repartition(3).withColumn("t", F.col("id").cast("string")), at)
    files = sorted((tmp_path / "w").glob("*.parquet"))
    each = {f.name: (pq.ParquetFile(f).metadata.num_rows, f.stat().st_size, hashlib.sha256(f.read_bytes()).hexdigest()) for f in files}
    assert {n: (r, b, h) for n, r, b, h in told["files"]} == each
    again = sinks.receipt(spark, at).first()
    assert (told["row_count"], told["bytes"], told["sha256"]) == (again["row_count"], again["bytes"], again["sha256"]) and told["row_count"] == 100_000
    for f in files:
        meta = pq.ParquetFile(f).metadata
        sizes = [meta.row_group(i).num_rows for i in range(meta.num_row_groups)]
        assert all(n == arrow_io.ROW_GROUP_ROWS for n in sizes[:-1]) and 0 < sizes[-1] <= arrow_io.ROW_GROUP_ROWS and len(sizes) > 1
    assert arrow_io.receipt(at) == told
    with pytest.raises(FileExistsError):
        arrow_io.reported(spark.range(1), at)
    assert spark.read.parquet(at).count() == 100_000


def test_groups_close_at_their_bytes(spark, tmp_path):
    arrow_io.reported(spark.range(3000).coalesce(1).select(F.repeat(F.lit("A"), 1000).alias("s")), str(tmp_path / "b"), limit=200_000)
    (f,) = (tmp_path / "b").glob("*.parquet")
    meta = pq.ParquetFile(f).metadata
    assert meta.num_row_groups >= 15 and max(meta.row_group(i).num_rows for i in range(meta.num_row_groups)) <= 200
    arrow_io.reported(spark.range(10).where("id < 0"), str(tmp_path / "none"))
    assert spark.read.parquet(str(tmp_path / "none")).columns == ["id"] and spark.read.parquet(str(tmp_path / "none")).count() == 0


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    bad = spark.range(0, 40_000, 1, 4).select(F.when(F.col("id") == 35_000, F.raise_error(F.lit("broken row")).cast("long")).otherwise(F.col("id")).alias("x"))
    with pytest.raises(Exception, match="broken row"):
        arrow_io.reported(bad, str(tmp_path / "w"))
    assert list(tmp_path.iterdir()) == []


def test_commit_takes_only_reported_files(tmp_path):
    from pyspark.sql.types import LongType, StructField, StructType

    writer = arrow_io._Parquet(str(tmp_path / "w"), StructType([StructField("k", LongType())]), 10, 1 << 30)
    batch = pa.RecordBatch.from_pydict({"k": list(range(25))})
    lost, kept = writer.write(iter([batch])), writer.write(iter([batch, batch.slice(0, 0)]))
    writer.commit([kept, writer.write(iter([])), None])
    assert lost.file != kept.file and [p.name for p in (tmp_path / "w").glob("*.parquet")] == [kept.file]
    assert [p.name for p in tmp_path.iterdir()] == ["w"]
    meta = pq.ParquetFile(tmp_path / "w" / kept.file).metadata
    assert [meta.row_group(i).num_rows for i in range(meta.num_row_groups)] == [10, 10, 5]
    late = arrow_io._Parquet(str(tmp_path / "w"), writer.kind, 10, 1 << 30)
    message = late.write(iter([batch]))
    with pytest.raises(FileExistsError):
        late.commit([message])
    assert [p.name for p in tmp_path.iterdir()] == ["w"]


# stream state ------------------------------------------------------------------------------------


def arrive(spark, src, rows, ddl="k long, v string"):
    spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(src)


def test_keys_are_state_not_output(spark, tmp_path):
    src, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    run = lambda: ingest.ingest(ingest.read_files(spark, src, "k long, v string"), out, mark, ["k"]).awaitTermination()
    arrive(spark, src, [(1, "a"), (2, "b")])
    run()
    assert sorted(r.k for r in spark.read.parquet(out).collect()) == [1, 2]
    shutil.rmtree(out)  # earlier output isn't needed to know its keys
    arrive(spark, src, [(2, "b"), (3, "c")])
    run()
    assert [r.k for r in spark.read.parquet(out).collect()] == [3]


def test_a_batch_that_was_cut_off_replaces_itself(spark, tmp_path):
    src, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    run = lambda: ingest.ingest(ingest.read_files(spark, src, "k long, v string"), out, mark, ["k"]).awaitTermination()
    for rows in ([(1, "a"), (2, "b")], [(2, "b"), (3, "c")]):
        arrive(spark, src, rows)
        run()
    last = max((tmp_path / "mark" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    for f in (last, last.with_name(f".{last.name}.crc")):
        f.unlink(missing_ok=True)  # as if it had been killed after writing
    arrive(spark, src, [(3, "c"), (4, "d")])
    run()
    assert sorted(r.k for r in spark.read.parquet(out).collect()) == [1, 2, 3, 4]


def test_state_expires(spark, tmp_path):
    src, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    ddl = "k long, at timestamp"

    def run():
        q = ingest.ingest(ingest.read_files(spark, src, ddl), out, mark, ["k"], "at", "1 hour")
        q.awaitTermination()
        return q.lastProgress["stateOperators"][0]["numRowsTotal"]

    import datetime as dt

    hour = lambda h: dt.datetime(2024, 1, 1, h)
    arrive(spark, src, [(1, hour(1)), (2, hour(1)), (1, hour(1))], ddl)
    run()
    arrive(spark, src, [(1, hour(1)), (3, hour(10))], ddl)
    assert run() == 1  # 1 and 2 are forgotten, 3 is kept
    arrive(spark, src, [(1, hour(11)), (3, hour(10)), (2, hour(2))], ddl)
    run()
    assert sorted(r.k for r in spark.read.parquet(out).collect()) == [1, 1, 2, 3]  # the late 2 is left out
    with pytest.raises(ValueError):
        ingest.ingest(ingest.read_files(spark, src, ddl), out, mark, ["k"], at="at")


# cascades ----------------------------------------------------------------------------------------

POOL = [
    Link("ticket", "pool", "pool", "id"), Link("sample", "pool", "pool", "id"), Link("ticket", "sample", "sample", "id"), Link("step", "ticket", "ticket", "id"),
    Link("metadata", "sample", "sample", "id"), Link("exception", "sample", "sample", "id"), Link("to_study", "sample", "sample", "id"), Link("pooled", "sample", "sample", "id"), Link("pooled", "pool", "pool", "id"),
    Link("block", "id", "sample", "id", via=("member", "sample", "block")), Link("member", "block", "block", "id"), Link("member", "sample", "sample", "id"), Link("block_ticket", "block", "block", "id"),
    Link("mask_gate", "sample", "sample", "id"), Link("range", "sample", "sample", "id"), Link("genome", "sample", "sample", "id", "unset"),
]


def brute(tables, links, root, gone_root):
    """Rows that go, by repeating all links until nothing changes."""
    gone = {t: set() for t in tables} | {root: set(gone_root)}
    while True:
        before = sum(map(len, gone.values()))
        for x in links:
            if x.action != "delete":
                continue
            names = {tables[x.of][i][x.key] for i in gone[x.of]} - {None}
            if x.via:
                table, there, here = x.via
                names = {r[here] for r in tables[table] if r[there] in names}
            gone[x.table] |= {i for i, r in enumerate(tables[x.table]) if r[x.column] in names and r[x.column] is not None}
        if sum(map(len, gone.values())) == before:
            return gone


def test_pool_of_fourteen_tables(spark):
    dice = random.Random(5)
    some = lambda n: dice.choice([None, *range(n)])
    tables = {
        "pool": [{"id": i} for i in range(4)], "sample": [{"id": i, "pool": some(4)} for i in range(20)], "ticket": [{"id": i, "pool": some(4), "sample": some(20)} for i in range(30)],
        "step": [{"ticket": some(30), "n": i} for i in range(40)], "pooled": [{"sample": some(20), "pool": some(4)} for i in range(20)], "block": [{"id": i} for i in range(12)],
        "member": [{"block": some(12), "sample": some(20)} for i in range(25)], "block_ticket": [{"block": some(12), "n": i} for i in range(12)],
    } | {t: [{"sample": some(20), "n": i} for i in range(15)] for t in ("metadata", "exception", "to_study", "mask_gate", "range", "genome")}
    assert len(tables) == 14
    frames = {t: spark.createDataFrame([tuple(r.values()) for r in rows], ", ".join(f"{c} long" for c in rows[0])) for t, rows in tables.items()}
    plan = Cascade(frames, POOL, "pool", frames["pool"].where("id in (1, 2)"))
    gone = brute(tables, POOL, "pool", [1, 2])
    key = lambda rows: sorted(map(tuple, rows), key=repr)
    unset = {tables["sample"][i]["id"] for i in gone["sample"]}
    for t, rows in tables.items():
        if t == "pool":
            continue
        left = [tuple(r.values()) for i, r in enumerate(rows) if i not in gone[t]]
        if t == "genome":
            left = [(None if s in unset else s, n) for s, n in left]
            assert t not in plan.counts
        else:
            assert plan.counts[t] == len(gone[t])
            assert key(plan.gone(t).collect()) == key(tuple(rows[i].values()) for i in gone[t])
        assert key(plan.left(t).collect()) == key(left)


def test_links_that_forbid_or_run_in_circles(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "id long"), spark.createDataFrame([(1, 1), (2, None)], "id long, a long")
    with pytest.raises(Refused, match="b.a"):
        Cascade({"a": a, "b": b}, [Link("b", "a", "a", "id", "refuse")], "a", a.where("id = 1"))
    Cascade({"a": a, "b": b}, [Link("b", "a", "a", "id", "refuse")], "a", a.where("id = 2"))
    both = [Link("b", "a", "a", "id", "refuse"), Link("b", "id", "a", "id")]  # the row that forbids goes too
    assert Cascade({"a": a, "b": b}, both, "a", a.where("id = 1")).counts == {"a": 1, "b": 1}
    with pytest.raises(ValueError, match="circle"):
        order([Link("b", "x", "a", "id"), Link("c", "x", "b", "id"), Link("a", "x", "c", "id")])
    with pytest.raises(ValueError, match="no such action"):
        order([Link("b", "x", "a", "id", "drop")])
    with pytest.raises(ValueError, match="no table c"):
        Cascade({"a": a}, [Link("c", "x", "a", "id")], "a", a)


def test_a_lake_loses_a_graph_in_one_version(spark, tmp_path):
    lake = Lake(spark, str(tmp_path / "lake"))
    frame = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    lake.append({"top": frame([(1,), (2,)], "id long"), "mid": frame([(10, 1), (20, 2), (30, None)], "id long, top long"), "low": frame([(10, 1), (20, 2), (20, 1), (None, None)], "mid long, top long")})
    v = lake.version()
    links = [Link("mid", "top", "top", "id"), Link("low", "mid", "mid", "id"), Link("low", "top", "top", "id")]
    assert lake.delete_graph(links, "top", F.col("id") == 1) == {"top": 1, "mid": 1, "low": 2}
    assert lake.version() == v + 1
    assert [r.id for r in lake.read("top").collect()] == [2] and sorted(r.id for r in lake.read("mid").collect()) == [20, 30]
    assert sorted(map(tuple, lake.read("low").collect()), key=repr) == [(20, 2), (None, None)]
    with pytest.raises(Refused):
        lake.delete_graph([Link("mid", "top", "top", "id", "refuse")], "top", F.col("id") == 2)
    assert lake.version() == v + 1
    assert lake.delete_graph(links, "top", F.col("id") == 99) == {"top": 0, "mid": 0, "low": 0} and lake.version() == v + 1


# JSON --------------------------------------------------------------------------------------------


def test_merged_and_set_by_hand(spark):
    dice = random.Random(3)

    def value(depth=0):
        kind = dice.randrange(6 if depth < 3 else 4)
        return [None, 7, "te\"xt", True, None, None][kind] if kind < 4 else [value(depth + 1) for _ in range(2)] if kind == 4 else {k: value(depth + 1) for k in dice.sample("abc", dice.randrange(4))}

    def at(doc, path, change, needed):
        if not path:
            return change(doc)
        m = doc or {}
        if needed > 0 and path[0] not in m:
            return doc
        return m | {path[0]: at(m.get(path[0]), path[1:], change, needed - 1)}

    def walkable(doc, path):
        for p in path:
            if doc is not None and not isinstance(doc, dict):
                return False
            doc = (doc or {}).get(p)
        return doc is None or isinstance(doc, dict)

    rows = []
    while len(rows) < 150:
        doc = dice.choice([None, {k: value() for k in "abc" if dice.random() < 0.7}])
        patch, path = {k: value() for k in "abd" if dice.random() < 0.5}, [dice.choice("abe"), dice.choice("abe")]
        if walkable(doc, path):
            rows.append((len(rows), json.dumps(doc) if doc is not None else None, json.dumps(patch), *path))
    df = spark.createDataFrame(rows, "n long, doc string, patch string, p string, q string")
    path, args = [F.col("p"), F.col("q")], (F.col("doc"), F.col("patch"))
    got = df.select("n", jsontext.json_merged(*args, path).alias("a"), jsontext.json_merged(*args, path, parents=False).alias("b"), jsontext.json_set(F.col("doc"), path, F.col("patch")).alias("c"),
                    jsontext.json_set(F.col("doc"), path, F.col("patch"), parents=True).alias("d"), jsontext.json_set(F.col("doc"), path, F.col("patch"), create=False).alias("e")).collect()
    for r in got:
        _, doc, patch, p, q = rows[r.n]
        doc, patch = json.loads(doc) if doc else {}, json.loads(patch)
        merge, put = (lambda v: (v or {}) | patch), (lambda v: (v or {}) | {q: patch})  # noqa: B023
        only = lambda v: (v or {}) | {q: patch} if q in (v or {}) else v  # noqa: B023, E731
        want = [at(doc, [p, q], merge, 0), at(doc, [p, q], merge, 1), at(doc, [p], put, 1), at(doc, [p], put, 0), at(doc, [p], only, 1)]
        got5 = [json.loads(x) for x in (r.a, r.b, r.c, r.d, r.e)]
        if p in doc and doc[p] is None and got5[4] != want[4]:
            want[4] = doc | {p: {}}  # JSON's null on the way counts as an empty object
        assert got5 == want, rows[r.n]


def test_json_of_odd_shapes(spark):
    one = spark.range(1)
    lit = lambda x: F.lit(x).cast("string")
    get = lambda c: one.select(c).first()[0]
    assert get(jsontext.json_merged(lit(None), lit(None))) == "{}"
    assert get(jsontext.json_merged(lit('{"a":1}'), lit('{"b":2}'), [lit(None)])) is None
    assert get(jsontext.json_set(lit('{"a":1}'), ["a"], lit(None))) is None
    assert get(jsontext.same_json(lit('{"a":[1,2]}'), lit('{"a":[2,1]}'))) is False and get(jsontext.same_json(lit(None), lit("1"))) is None
    for bad in (jsontext.json_merged(lit('{"a":[1]}'), lit("{}"), ["a"]), jsontext.json_merged(lit("{}"), lit("3")), jsontext.json_merged(lit("not"), lit("{}")), jsontext.json_set(lit('{"a":5}'), ["a", "b"], lit("1"))):
        with pytest.raises(Exception):
            get(bad)
    with pytest.raises(ValueError):
        jsontext.json_set(lit("{}"), [], lit("1"))


# digests -----------------------------------------------------------------------------------------


def test_digest_is_fed_in_order(spark, monkeypatch):
    dice = random.Random(1)
    rows = [(dice.choice([None, 1, 2, 2, 2, 2]), hashlib.md5(str(dice.randrange(4000)).encode()).hexdigest()) for _ in range(9000)] + [(3, None), (1, None), (4, ""), (5, "AB")]
    df = spark.createDataFrame(rows, "g long, h string").repartition(5)
    want = {}
    for g, h in set(rows):
        want.setdefault(g, set()).add(h)
    want = {g: hashlib.sha256(bytes.fromhex("".join(sorted(h for h in hs if h)))).hexdigest() for g, hs in want.items()}
    for step in (1, 100, 1 << 20):
        monkeypatch.setattr(reference, "PACK_BYTES", step)
        assert {r.g: r.set_digest for r in reference.set_digest(df, "g", "h").collect()} == want
    with pytest.raises(Exception, match="not hex"):
        reference.set_digest(spark.createDataFrame([(1, "xyz")], "g long, h string"), "g", "h").collect()
    assert reference.set_digest(spark.createDataFrame([], "g string, h string"), "g", "h").collect() == []
