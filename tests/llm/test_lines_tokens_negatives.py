"""Line dedup, token alignment and hard negatives against plain versions of the same rules."""

import collections
import hashlib
import random

import numpy as np
import pytest

from seqloom.llm import align_tokens, hard_negatives, line_dedup

CLASHES = "id long, sum long, pos int, keep string, slice string, pair int, label_ string"


def docs(spark, rows):
    """Documents with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, x, 1, 2, 3, "k", "s", 4, "l") for i, x in rows], "doc_id long, text string, " + CLASHES)


# lines -----------------------------------------------------------------------------------------------

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def lines_by_hand(rows, least, chars):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    held = collections.defaultdict(set)
    for i, x in rows:
        for line in (x or "").split("\n"):
            if len(key(line)) >= chars:
                held[key(line)].add((i, x or ""))
    out = []
    for i, x in rows:
        lines = (x or "").split("\n")
        stay = [line for line in lines if len(key(line)) < chars or len(held[key(line)]) < least]
        out.append((i, len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    return sorted(out, key=repr)


def line_rows():
    rng = random.Random(1)
    pool = ["Alpha", " alpha\t", "ÀB", "àB", "x" * 300, "hot line", "", "  ", "z\r", "Z"] + [f"l{i}" for i in range(60)]
    rows = [(None, None), (None, "hot line"), (None, "hot line"), (None, "HOT LINE\na"), (1, ""), (1, "hot line\n"), (1, "hot line\n"), (7, "a\n" * 20_000), (8, "q" * 300_000)]
    return rows + [(i, "\n".join(["Hot Line"] * rng.randint(0, 3) + [rng.choice(pool) for _ in range(rng.randint(0, 6))])) for i in range(1200)]


@pytest.mark.parametrize(("batch", "least", "chars"), [(10_000, 10, 1), (37, 10, 1), (37, 200, 2)])
def test_lines_against_hand(spark, monkeypatch, batch, least, chars):
    """A line that most documents hold is cut over several ranges; batches cut keys anywhere."""
    monkeypatch.setattr(line_dedup, "RANGE_LINES", 3000)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        rows = line_rows()
        got = sorted(map(tuple, line_dedup.label(docs(spark, rows).repartition(5), least, chars).collect()), key=repr)
        assert got == lines_by_hand(rows, least, chars)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_lines_apply_keeps_columns(spark):
    rows = line_rows()[:400]
    table = docs(spark, rows)
    out = line_dedup.apply(table)
    assert out.columns == table.columns
    got = sorted(((r["doc_id"], hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in out.collect()), key=repr)
    assert got == sorted(((i, d) for i, _, _, d in lines_by_hand(rows, 10, 1)), key=repr)


def test_lines_bitmaps_and_empty(spark):
    rows = [(i, f"own {i}\nshared\nlast") for i in range(10)]
    got = line_dedup.bitmaps(docs(spark, rows)).collect()
    assert {r["id"] for r in got} == set(range(10))
    for r in got:
        assert (r["n_dropped"], r["last"]) == (2, 2) and line_dedup.unpacked(r["keep"], 3).tolist() == [True, False, False]
    none = docs(spark, rows).where("false")
    assert line_dedup.label(none).count() == 0 and line_dedup.apply(none).count() == 0


# alignment -------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def libraries():
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    first.encode_special_tokens = True
    first.no_truncation()
    first.no_padding()
    return first, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def aligned_by_hand(text, libraries):
    """Ids, ends, groups and links of a text, or None."""
    from seqloom.llm.bpe import byte_letters

    if not text:
        return None
    first, second = libraries
    back = {c: b for b, c in byte_letters().items()}
    a, b = first.encode(" " + text, add_special_tokens=False).ids, second.encode(text)
    said_a = [bytes(back[c] for c in first.id_to_token(i)) for i in a]
    pieces = [second.id_to_piece(i) for i in b]
    said_b = [bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, pieces, strict=True)]
    whole = (" " + text).encode()
    if b"".join(said_a) != whole or b"".join(said_b) != whole:
        return None
    ends_a, ends_b = np.cumsum([len(x) for x in said_a]).tolist(), np.cumsum([len(x) for x in said_b]).tolist()
    groups, low = [], -1
    for cut in sorted(set(ends_a) & set(ends_b)):
        groups.append(([i for i, e in zip(a, ends_a, strict=True) if low < e <= cut], [i for i, e in zip(b, ends_b, strict=True) if low < e <= cut]))
        low = cut
    at = {e: j for j, e in enumerate(ends_b)}
    links = [(a[i], b[at[e]]) for i, e in enumerate(ends_a) if e in at]
    overlaps = [(i, j) for i, e in enumerate(ends_a) for j, f in enumerate(ends_b) if e - len(said_a[i]) < f and f - len(said_b[j]) < e] if len(a) < 100 else None
    return a, b, groups, links, overlaps


def token_texts(sf):
    import pyarrow.parquet as pq

    rng = random.Random(5)
    texts = [t for t in pq.read_table(f"{sf}/documents.parquet")["text"].to_pylist() if t and len(t) < 3000][:80]
    texts += [None, "", " ", "  ", "\n", " \n ", "the ", "the  ", "a▁b", "<|endoftext|> x<s></s>", "\tx\n\n  y \r\n{\r z", "é ①ﬁ 中文字 ", "a\x1c b\x85 c\xa0 d", "<0x41> <unk>", "� a", "x" * 3000, " " * 900 + "z", "a b " * 500, "\0 a\0"]
    letters = [" ", "  ", "\n", "\t", "a", "the", "ing", "'s", "1", "中", "é", "😀", ".", "\r", "{", "b"]
    return texts + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 40))) for _ in range(120)] + ["the  "]


def test_alignment_against_libraries(spark, sf, libraries, monkeypatch):
    monkeypatch.setattr(align_tokens, "SLICE_CHUNKS", 700)
    texts = token_texts(sf)
    by_hand = [aligned_by_hand(x, libraries) for x in texts]
    count = collections.Counter(k for r in by_hand if r for k in r[3])
    most = collections.defaultdict(int)
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    want = {}
    for i, r in enumerate(by_hand):
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in r[2]) if r else ""
        want[i] = (len(r[0]), len(r[1]), len(r[2]), len(r[3]), sum(count[k] == most[k[1]] for k in r[3]), sum(count[k] for k in r[3]), hashlib.sha256(said.encode()).hexdigest()) if r else (0, 0, 0, 0, 0, 0, "")
    given = docs(spark, list(enumerate(texts))).repartition(3)
    got = {r[0]: tuple(r[1:]) for r in align_tokens.label(given, align_tokens.vocabularies()).collect()}
    assert got == want
    pairs = {(r["a"], r["b"]): (r["n"], r["best"]) for r in align_tokens.pair_counts(given, align_tokens.vocabularies()).collect()}
    assert pairs == {k: (n, n == most[k[1]]) for k, n in count.items()}


def test_alignment_overlaps(spark, libraries):
    texts = ["Bonjour, les amis", "x 中文", None, "a▁b", "naïve  coöperation"]
    got = collections.defaultdict(set)
    for r in align_tokens.overlaps(docs(spark, list(enumerate(texts))), align_tokens.vocabularies()).collect():
        got[r["doc_id"]].add((r["a_pos"], r["b_pos"]))
    assert got == {i: set(r[4]) for i, x in enumerate(texts) if (r := aligned_by_hand(x, libraries))}


def test_alignment_empty_and_null_ids(spark):
    rows = docs(spark, [(None, "a b"), (None, "a b"), (3, None)])
    got = align_tokens.label(rows, align_tokens.vocabularies()).collect()
    assert sorted((r["doc_id"] or 0, r["n_links"]) for r in got) == [(0, 2), (0, 2), (3, 0)] and {r["count_sum"] for r in got} == {0, 4}
    assert align_tokens.label(rows.where("false"), align_tokens.vocabularies()).count() == 0


# hard negatives --------------------------------------------------------------------------------------


def mined_by_hand(rows):
    of = {}
    for i, v, y in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        if i is None or v is None or y is None or any(x is None or not np.isfinite(x) or abs(np.floor(256.0 * x)) > 2**24 for x in v):
            continue
        q = [int(np.floor(256.0 * x)) for x in v]
        of[i] = min(of.get(i, (y, q)), (y, q))
    out = []
    score = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    for i, (y, q) in of.items():
        if i % 100:
            continue
        every = sorted((-score(q, of[j][1]), j) for j in of if j != i)
        for p, pos in [(-p, j) for p, j in every if of[j][0] == y][:5]:
            fits = [(-n, j) for n, j in every if of[j][0] != y and 30 * p <= -100 * n <= 90 * p][:10]
            out += [(i, pos, k + 1, j, p, n) for k, (n, j) in enumerate(fits)]
    return sorted(out)


@pytest.mark.parametrize("scale", [0.3, 40.0, 0.004])
def test_hard_negatives_by_hand(spark, monkeypatch, scale):
    """Small blocks, stripes and tiles; many ties at the smallest scale; odd rows; one label with a third of the rows."""
    for name, value in (("ANCHOR_BLOCK", 3), ("LEAST_STRIPE", 50), ("TILE", 500)):
        monkeypatch.setattr(hard_negatives, name, value)
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(0.2, 1, 8) * scale).astype(np.float32).tolist(), int(rng.choice([0, 0, 1, 2, 3]))) for i in range(700)]
    rows += [(700, None, 1), (800, [0.1] * 8, None), (None, [0.1] * 8, 1), (900, [float("nan")] * 8, 1), (901, [None, 0.1], 1), (902, [float("inf")], 1), (903, [1e9] * 8, 0), (904, [0.5, 0.5], 0), (1000, [], 0), (1100, [-1.0] * 12, 0), rows[200], rows[200], (200, rows[7][1], 3), (905, rows[5][1], rows[5][2])]
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, label int, cell long, kind string")
    got = sorted(tuple(r) for r in hard_negatives.mine(table, hard_negatives.F.col("vec_id") % 100 == 0).collect())
    want = mined_by_hand(rows)
    assert len(want) > 50 and got == want
    assert hard_negatives.mine(table.where("false"), hard_negatives.F.col("vec_id") % 100 == 0).count() == 0


def test_planes_drop_most_pairs():
    rng = np.random.default_rng(2)
    q = (rng.normal(0, 0.125, (600, 64)) * 256).astype(np.int64)
    best = [hard_negatives.Best(10, np.full(50, -(2**62)), np.full(50, 2**62))]
    last = sum(hard_negatives.tile(q[:50], q[k : k + 100], np.arange(k, k + 100), np.ones((50, 100), bool), best) for k in range(0, 600, 100))
    assert last < 0.5 * 50 * 600
    exact = q[:50] @ q.T
    for a in range(50):
        order = np.lexsort((np.arange(600), -exact[a]))[:10]
        mine = best[0].anchor == a
        assert best[0].id[mine].tolist() == order.tolist() and best[0].score[mine].tolist() == exact[a][order].tolist()
