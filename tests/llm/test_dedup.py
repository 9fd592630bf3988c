import hashlib
import itertools
import random

import pytest
from pyspark.sql import functions as F

from seqloom.llm import common, exact_dedup, ngram_jaccard

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, word string, txt string, row string, node string, sha string, id string"


def table(spark, texts):
    """Documents with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, x, None, "s", None, None, "w", "t", "r", "n", "h", "i") for i, x in texts], DOCS)


EDGES = [(1, None), (2, ""), (3, "a b"), (4, "a b"), (4, "a b"), (5, " a b"), (None, "a b"), (None, None), (9, "x " * 300_000), (8, "x " * 300_000), (7, "lone")]


def test_exact_label(spark):
    got = exact_dedup.label(table(spark, EDGES)).collect()
    assert len(got) == len(EDGES)
    by = {}
    for i, x in EDGES:
        by.setdefault(x or "", []).append(i)
    for r in got:
        (text,) = [x for x in by if hashlib.sha256(x.encode()).hexdigest() == r["text_sha256"]]
        ids = by[text]
        best = max((i for i in ids if i is not None), default=None)
        assert (r["keep_id"], r["group_size"]) == (best, len(ids))
    assert sum(r["kept"] for r in got) == len(by)


def test_exact_dedup_keeps_rows_whole(spark):
    docs = table(spark, EDGES)
    out = exact_dedup.dedup(docs)
    assert out.columns == docs.columns
    assert sorted((r["doc_id"] or -1, len(r["text"] or "")) for r in out.collect()) == [(2, 0), (4, 3), (5, 4), (7, 4), (9, 600_000)]


def test_exact_empty(spark):
    none = table(spark, EDGES).where("false")
    assert exact_dedup.label(none).count() == 0 and exact_dedup.dedup(none).count() == 0


def test_filter_has_no_false_negatives(spark, monkeypatch):
    """Even with a filter far too small for the rows."""
    monkeypatch.setattr(common, "MAX_WORDS", 8)
    rng = random.Random(3)
    texts = [(i, str(rng.randint(0, 700))) for i in range(1500)]
    got = exact_dedup.label(table(spark, texts)).where("kept").count()
    assert got == len({x for _, x in texts})


def near(rng, words, changes):
    out = list(words)
    for _ in range(changes):
        out[rng.randrange(len(out))] = f"z{rng.randrange(10**6)}"
    return out


def brute(texts):
    """Classes and links by all pairs."""
    sets = {}
    for i, (_, x) in enumerate(texts):
        w = (x or "").split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    low = {i: i for i in sets}

    def find(i):
        while low[i] != i:
            i = low[i]
        return i

    links = {i: set() for i in sets}
    for a, b in itertools.combinations(sets, 2):
        same = (texts[a][1] or "") == (texts[b][1] or "")
        alike = same or (sets[a] and len(sets[a] & sets[b]) * 5 >= 4 * len(sets[a] | sets[b]))
        if alike:
            x, y = sorted((find(a), find(b)))
            low[y] = x
            if not same:
                links[a].add(texts[b][1] or "")
                links[b].add(texts[a][1] or "")
    group = {}
    for i in sets:
        group.setdefault(find(i), []).append(i)
    out = {}
    for members in group.values():
        ids = [texts[i][0] for i in members if texts[i][0] is not None]
        for i in members:
            out[i] = (min(ids, default=None), len(links[i]))
    return out


@pytest.mark.parametrize("block", [400, 5])
def test_jaccard_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_jaccard, "BLOCK_TEXTS", block)
    rng = random.Random(block)
    texts = []
    for _ in range(12):
        base = [f"w{rng.randrange(50)}" for _ in range(rng.choice([4, 30, 120, 400]))]
        texts += [" ".join(near(rng, base, rng.choice([0, 1, 2, 4]))) for _ in range(rng.choice([1, 3, 9]))]
    texts += ["", None, "  \n", "a", "a", "a b c d", "w " * 50_000]
    rng.shuffle(texts)
    texts = list(enumerate(texts))
    want = brute(texts)
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ngram_jaccard.classes(table(spark, texts)).collect()}
    assert got == want


def test_jaccard_edges(spark):
    got = ngram_jaccard.classes(table(spark, EDGES)).collect()
    assert len(got) == len(EDGES)
    kept = ngram_jaccard.dedup(table(spark, EDGES))
    assert kept.columns == table(spark, EDGES).columns
    assert sorted(r[0] for r in kept.select("doc_id").collect()) == [1, 3, 7, 8]
    lost = ngram_jaccard.dedup(table(spark, [(None, "a b"), (None, "c d"), (3, "c d"), (None, "e f g h i j k l m n o p q r s"), (None, "f g h i j k l m n o p q r s")]))
    assert sorted(str(r[0]) for r in lost.select("doc_id").collect()) == ["3", "None", "None"]
    none = table(spark, EDGES).where("false")
    assert ngram_jaccard.classes(none).count() == 0 and ngram_jaccard.dedup(none).columns == none.columns


def test_pruning_table():
    least = ngram_jaccard.least_agreeing()
    assert least[0] == 0 and all(b - a in (0, 1) for a, b in zip(least, least[1:]))
    # a pair at the threshold is dropped at a step with probability of about the tolerance
    from math import comb

    n = ngram_jaccard.STEP
    assert sum(comb(n, m) * 0.8**m * 0.2 ** (n - m) for m in range(least[n])) < 1e-5


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, 1000 + k) for k in range(1, 200)] + [(rng.randrange(5000, 5400), rng.randrange(5000, 5400)) for _ in range(150)]
    got = dict(tuple(r) for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect())
    low = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(low[a], low[b])
            if low[a] != m or low[b] != m:
                low[a] = low[b] = m
                changed = True
    loops = {a for a, b in edges if a == b}
    assert {k: v for k, v in low.items() if k in got} == got and set(low) - set(got) <= loops
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_salted_join_is_whole(spark):
    big = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    small = spark.createDataFrame([(0, "a"), (1, "b")], "k long, v string")
    assert common.salted(big, small, ["k"], "inner", F.col("id")).count() == 667
    assert common.salted(big, small, ["k"], "left", F.col("id")).count() == 1000


def test_batches_of_long_texts_are_bounded(spark):
    """Near dedup and the encoder take texts some megabytes at a time, however long they are."""
    from seqloom import session
    from seqloom.llm import bpe

    def sizes(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"])

    docs = spark.range(0, 40, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("a b "), 1 << 18).alias("text"))
    for operator in (lambda: bpe.encode(docs, bpe.vocabulary()), lambda: ngram_jaccard.dedup(docs.limit(2))):
        spark.conf.unset(session.BATCH)
        operator()
        got = [r["n"] for r in docs.select("text").mapInArrow(sizes, "n long").collect()]
        assert max(got) < 10 << 20 < sum(got)
    spark.conf.set(session.BATCH, "1m")
    session.bound_batches(spark)
    assert spark.conf.get(session.BATCH) == "1m"  # what a session says holds
    spark.conf.unset(session.BATCH)


def test_near_dedup_lets_go_of_the_encoder():
    from seqloom.llm import bpe

    for task in (ngram_jaccard._keyed, ngram_jaccard._judged):
        bpe._codecs[1] = object()
        assert list(task(iter([]))) == []
        assert not bpe._codecs
