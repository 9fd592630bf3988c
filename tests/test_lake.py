"""Changes of the lake beside other writers, odd paths, file statistics and moved files."""

import random

import pytest
from pyspark.sql import functions as F

from seqloom.schemas import schema
from seqloom.sources.lake import Conflict, Lake


def members(spark, *rows):
    return spark.createDataFrame(list(rows), schema("reference_membership"))


def sequences(spark, *features):
    return spark.createDataFrame([(f, str(f), 1) for f in features], schema("reference_sequences"))


@pytest.fixture(params=["lake", "my lake", "a%20b", "c%41"])
def lake(spark, tmp_path, request):
    return Lake(spark, "file://" + str(tmp_path / request.param))


def left(lake, table="reference_membership"):
    return sorted((tuple(r) for r in lake.read(table).collect()), key=repr)


def test_deletes_under_any_root(spark, lake):
    lake.replace({"reference_membership": members(spark, (1, 10), (None, 12), (2, 11), (1, None))})
    lake.append({"reference_membership": members(spark, (3, 30), (4, 40))})
    assert lake.delete_where("reference_membership", F.col("feature_idx") == 10) == 1
    assert lake.delete("reference_membership", lambda rows: rows.where("feature_idx = 40"), ["reference_idx", "feature_idx"]) == 1
    assert left(lake) == [(1, None), (2, 11), (3, 30), (None, 12)]
    assert lake.delete_where("reference_membership", F.col("feature_idx") > 0) == 3 and left(lake) == [(1, None)]
    assert lake.delete_where("reference_membership", F.lit(True)) == 1 and lake.read("reference_membership").columns == ["reference_idx", "feature_idx"]


@pytest.mark.parametrize("step", ["_written", "_publish", "_frame"])
def test_delete_reference_beside_a_writer(spark, tmp_path, step):
    """Another reference lists the feature between two steps of the delete: the delete is a conflict, or sees it; the sequence stays."""
    lake, other = (Lake(spark, "file://" + str(tmp_path / "lake")) for _ in range(2))
    lake.replace({"reference_membership": members(spark, (1, 10), (3, 99)).coalesce(1), "reference_sequences": sequences(spark, 10, 99).coalesce(1)})
    real, done = getattr(lake, step), []

    def meanwhile(*a, **k):
        if not done:
            done.append(other.append({"reference_membership": members(spark, (2, 10))}))
        return real(*a, **k)

    setattr(lake, step, meanwhile)
    with pytest.raises(Conflict):
        lake.delete_reference(1)
    assert done and left(lake) == [(1, 10), (2, 10), (3, 99)] and left(lake, "reference_sequences") == [(10, "10", 1), (99, "99", 1)]
    setattr(lake, step, real)
    assert lake.delete_reference(1)["reference_sequences"] == 0 and left(lake) == [(2, 10), (3, 99)] and lake.read("reference_sequences").count() == 2


def test_vacuum_beside_a_writer(spark, tmp_path):
    """At any step of an append; what a writer that died left goes once its lease is old."""
    lake, other = (Lake(spark, "file://" + str(tmp_path / "lake")) for _ in range(2))
    lake.replace({"reference_membership": members(spark, (1, 10))})
    for step in ("_written", "_described", "_add", "_publish"):
        real = getattr(lake, step)

        def both(*a, real=real, **k):
            other.vacuum()
            out = real(*a, **k)
            other.vacuum()
            return out

        setattr(lake, step, both)
        lake.append({"reference_membership": members(spark, (2, 20))})
        setattr(lake, step, real)
    assert len(left(lake)) == 5
    lake._publish = lambda *a: (_ for _ in ()).throw(KeyboardInterrupt())
    lake._release = lambda leases: None
    with pytest.raises(KeyboardInterrupt):
        lake.append({"reference_membership": members(spark, (3, 30))})
    lake = other
    folders = lambda: len(lake._listed(f"{lake.root}/reference_membership"))
    n = folders()
    lake.vacuum()
    assert folders() == n
    lake.vacuum(lease_seconds=-1)
    assert folders() == n - 1 and len(left(lake)) == 5 and not lake._listed(f"{lake.root}/_leases")


def test_vacuum_keeps_young_versions(spark, tmp_path):
    lake = Lake(spark, "file://" + str(tmp_path / "lake"))
    lake.replace({"reference_membership": members(spark, (1, 10))})
    old = lake.read("reference_membership")
    lake.full_replace("reference_membership", members(spark, (2, 20)))
    lake.vacuum(keep_seconds=600)  # only files without rows
    assert old.count() == 1 and len(lake._listed(f"{lake.root}/_versions")) == 2
    assert lake.vacuum() > 0 and left(lake) == [(2, 20)]


def test_appends_meet(spark, tmp_path):
    """An append that finds another published is published anew."""
    lake, other = (Lake(spark, "file://" + str(tmp_path / "lake")) for _ in range(2))
    real, done = lake._publish, []

    def late(*a):
        if not done:
            done.append(other.append({"reference_membership": members(spark, (2, 20))}))
        return real(*a)

    lake._publish = late
    lake.append({"reference_membership": members(spark, (1, 10))})
    assert left(lake) == [(1, 10), (2, 20)]


@pytest.mark.parametrize("samples", [20, 100])
def test_a_block_opens_its_own_files(spark, tmp_path, samples):
    """A file for each sample: a block of four samples opens four files, however many there are."""
    lake = Lake(spark, "file://" + str(tmp_path / "lake"))
    rows = [(p, s, "r", "A", None, None, None) for p in range(samples) for s in range(p * 100, p * 100 + 10)]
    lake.replace({"read": spark.createDataFrame(rows, schema("read")).repartitionByRange(samples, "prep_sample_idx")})
    assert len(lake.contents()["read"]) == samples
    block = [(3, 300, 399), (7, 705, 720), (8, 0, 10_000), (15, 1500, 1500), (16, 0, 10)]  # the last meets no row of its sample
    got = lake.read_block("read", block)
    assert len(got.inputFiles()) == 4 and got.count() == 10 + 5 + 10 + 1
    assert len(lake.read_values("read", "prep_sample_idx", [2, 19, 500]).inputFiles()) == 2
    many = [(p, p * 100 + k, p * 100 + k) for p in (1, 4) for k in range(0, 10, 2)] * 40
    assert len(lake.read_block("read", many).inputFiles()) == 2 and lake.read_block("read", many).count() == 10
    v = lake.version()
    assert lake.delete_pool_reads([5]) == {"read": 10, "read_mask": 0} and len(lake.contents()["read"]) == samples - 1
    assert lake.read_block("read", [(5, 0, 10_000)], version=v).count() == 10 and lake.read_block("read", [(5, 0, 10_000)]).count() == 0


def test_pruned_reads_equal_plain_ones(spark, tmp_path):
    rng = random.Random(6)
    lake = Lake(spark, "file://" + str(tmp_path / "lake"))
    rows = [(None if rng.random() < 0.1 else rng.randint(0, 30), None if rng.random() < 0.1 else rng.randint(0, 500), "r", "A", None, None, None) for _ in range(600)]
    lake.replace({"read": spark.createDataFrame(rows, schema("read")).repartitionByRange(12, "prep_sample_idx", "sequence_idx")})
    for _ in range(4):
        block = [(rng.randint(0, 32), a := rng.randint(0, 500), a + rng.randint(0, 80)) for _ in range(rng.randint(1, 6))]
        want = sum(any(r[0] == o and r[1] is not None and a <= r[1] <= b for o, a, b in block) for r in rows)
        assert lake.read_block("read", block).count() == want


def test_register_moves_files(spark, tmp_path):
    lake = Lake(spark, "file://" + str(tmp_path / "lake"))
    at = str(tmp_path / "staged")
    members(spark, (1, 10), (2, 20), (3, 30)).repartition(3).write.parquet(at)
    assert lake.register({"reference_membership": at}) == {"reference_membership": 3} and len(left(lake)) == 3
    assert not list((tmp_path / "staged").glob("*.parquet"))
    spark.range(3).write.parquet(str(tmp_path / "other"))
    with pytest.raises(ValueError, match="feature_idx"):
        lake.register({"reference_membership": str(tmp_path / "other")})
    members(spark, (4, 40)).write.parquet(str(tmp_path / "more"))
    lake._publish = lambda *a: (_ for _ in ()).throw(OSError("no"))
    with pytest.raises(OSError):
        lake.register({"reference_membership": str(tmp_path / "more")})
    assert spark.read.parquet(str(tmp_path / "more")).count() == 1 and len(left(lake)) == 3
