"""Trees read in byte ranges against the sequential parse, and interval joins against all pairs."""

import random

import pytest

from seqloom.operators import slices
from seqloom.sources import newick, readers


def label(rng):
    name = rng.choice(["", f"a{rng.randint(0, 99)}", f"'q,u''o(te){rng.randint(0, 9)}'", "O'Brien", " x y ", f"'lo,ng,,,{',' * rng.randint(0, 30)},'"])
    return name + rng.choice(["", f":{rng.random():.2f}", ": 1e-3 ", f":0.5{{{rng.randint(0, 99)}}}"]) + rng.choice(["", "", "[c,(;'om]"])


def tree(rng, tips, chain=False):
    parts = [label(rng) for _ in range(tips)]
    while len(parts) > 1:
        k = min(len(parts), rng.randint(2, 4))
        i = 0 if chain else rng.randint(0, len(parts) - k)
        parts[i : i + k] = ["(" + rng.choice([",", ", ", ",\n"]).join(parts[i : i + k]) + ")" + label(rng)]
    return parts[0] + ";" + rng.choice(["", " junk(,)", "\n"])


@pytest.mark.parametrize(("tips", "chain", "split", "chunk", "few"), [(1, False, 300, 20_000, 10**6), (80, False, 200, 3, 10**6), (150, True, 700, 7, 0), (200, True, 10**8, 5, 10**6), (300, False, 1000, 20_000, 10**6)])
def test_ranges_equal_the_sequential_parse(spark, tmp_path, monkeypatch, tips, chain, split, chunk, few):
    """Borders fall inside quotes, comments and clades of many levels."""
    monkeypatch.setattr(newick, "CHUNK", chunk)
    monkeypatch.setattr(newick, "MAX_BROADCAST_BLOCKS", few)
    text = tree(random.Random(tips), tips, chain)
    (tmp_path / "t.nwk").write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        got = sorted(tuple(r) for r in readers.newick(spark, str(tmp_path / "t.nwk")).collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == readers.parse_newick(text)


@pytest.mark.parametrize("few", [10**6, 0])
def test_interval_join_by_hand(spark, monkeypatch, few):
    """One owner holds most rows and members; lengths from 1 to all positions; members overlap and repeat; nulls and empty members match nothing."""
    monkeypatch.setattr(slices, "MAX_BROADCAST_OWNERS", few)
    rng = random.Random(8)
    owner = lambda: rng.choice([1, 1, 1, 2, 3, None])
    points = [(owner(), rng.choice([rng.randint(-500, 500), 7, None]), i) for i in range(600)]
    members = [(owner(), a := rng.randint(-600, 600), a + rng.choice([-5, 0, 3, 40, 2000]), i) for i in range(150)] + [(1, -(2**62), 2**62, 900), (1, 7, 7, 901), (1, 7, 7, 901)]
    a = spark.createDataFrame(points, "o long, at long, i int")
    b = spark.createDataFrame(members, "o long, first long, last long, m int")
    got = sorted((r["i"], r["m"]) for r in slices.interval_join(a, b, "o", "at", "first", "last").collect())
    assert got == sorted((i, m) for o, at, i in points for q, first, last, m in members if o is not None and o == q and at is not None and first <= at <= last)


def test_interval_cells_deal_a_hot_owner(spark):
    """One owner with all rows, lengths that differ by 300 times: no cell holds a hundredth of them, and members become few rows."""
    points = spark.range(100_000).selectExpr("1 AS o", "id AS at")
    members = spark.range(2000).selectExpr("1 AS o", "id * 50 AS first", "id * 50 + IF(id % 100 = 0, 20000, 60) AS last", "id AS m")
    rows, cut = slices.interval_cells(points, members, "o", "at", "first", "last")
    assert max(r["count"] for r in rows.groupBy("o", "__cell").count().collect()) < 1000
    assert cut.count() <= (2 + slices.CELLS_PER_MEMBER) * 2000
