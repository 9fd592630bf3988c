import os

import pytest

import corpus_pipeline
from seqloom.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.exists(SF), reason="no tables here")
def test_stages(spark):
    docs = before = spark.read.parquet(f"{SF}/documents.parquet")
    sizes = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "encoding":
            assert out.columns == before.columns
        from seqloom.llm.common import keep

        docs = keep(out)
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] >= sizes[2] > 0 and sizes[3] == sizes[4]
    assert corpus_pipeline.run(spark, SF).count() == sizes[-1]


WORDS = "river stone cloud paper garden window silver bread mountain letter candle forest bridge winter music harbor story orange field lantern".split()
CLEAN = [" ".join(f"{WORDS[(i * 7 + k * (i + 3)) % 20]}{chr(97 + k % 26)}{chr(97 + i)}" for k in range(60)) for i in range(6)]
ROWS = [
    (1, CLEAN[0], "a"), (2, CLEAN[0], "a"), (2, CLEAN[0], "a"), (3, CLEAN[1], None), (None, CLEAN[2], "b"), (None, CLEAN[2], "b"), (5, None, "a"), (6, "", "b"), (7, "too short", "a"),
    (8, CLEAN[3], "a"), (9, CLEAN[3] + " onemoreword", "a"), (10, " ".join(f"{CLEAN[4]} {k} {k * k}" for k in range(1)) + " " + " ".join(f"w{k}x{k % 7}" for k in range(60_000)), "b"), (11, CLEAN[5], ""),
]
COLUMNS = "doc_id long, text string, source string, lang string, n_chars long, row string, txt string, node string, words string, weight string, ids string, kept string, epoch string"


def test_stages_on_odd_rows(spark):
    """Null and empty texts go, null ids stay, copies and near copies leave one, very long texts and columns of clashing names pass through."""
    docs = spark.createDataFrame([(*r, *[f"x{i}" for i in range(2)][:1], 7, *["c"] * 8) for r in ROWS], COLUMNS)
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs_next = stage(spark, docs, None)
        if name != "encoding":
            assert docs_next.columns == docs.columns
        from seqloom.llm.common import keep

        docs = keep(docs_next)
        kept[name] = sorted((r["doc_id"] or 0 for r in docs.select("doc_id").collect()))
    assert kept["quality rules"] == [0, 0, 1, 2, 2, 3, 8, 9, 10, 11]
    assert kept["exact dedup"] == [0, 2, 3, 8, 9, 10, 11]
    assert kept["near dedup"] == [0, 2, 3, 8, 10, 11]
    assert set(kept["mixing"]) <= set(kept["near dedup"]) and kept["encoding"] == kept["mixing"]
    assert all(len(r["ids"]) == r["n_tokens"] > 0 for r in docs.collect())


def test_stages_on_an_empty_table(spark):
    docs = spark.createDataFrame([], COLUMNS)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, None)
        assert docs.count() == 0


def test_registered():
    import __spark_entry__

    every = __spark_entry__.queries()
    assert {f"op{n}" for n in range(1, 11)} <= {k.split("_")[0] for k in every} and "pipeline" in every
    assert set(queries.oracle_sql()) <= set(queries.queries())


@pytest.mark.skipif(not os.path.exists(SF), reason="no tables here")
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "conversations", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    want = con.sql(queries.SQL[name])
    names = list(want.columns)
    assert sorted(names) == sorted(df.columns)
    got = sorted((tuple(r[c] for c in sorted(names)) for r in df.collect()), key=repr)
    assert got == sorted((tuple(v for _, v in sorted(zip(names, row, strict=True))) for row in want.fetchall()), key=repr)
