import collections
import math
import random
import re
import zlib

import numpy as np
import pytest

from seqloom.llm import kn_quality, lm_trie, textnum, toxicity
from seqloom.llm.elias_fano import EliasFano

WORDS = re.compile("[^\x20\x09-\x0d]+")


def test_word_hashes():
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab \n\tc é") for _ in range(rng.randint(0, 40))) for _ in range(200)] + ["", "x" * 600_000 + " y", " " * 300_000 + "ab"]
    words = textnum.Words([t.encode() for t in texts])
    seen = {}
    for k, t in enumerate(texts):
        own = words.hashes[words.offsets[k] : words.offsets[k + 1]]
        found = WORDS.findall(t)
        assert len(own) == len(found)
        for w, h in zip(found, own):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_shingles():
    texts = ["a b c d e f", "a b c d e f", "b c d e f g", "a b", "", "a b c d e"]
    h, off = textnum.shingles(textnum.Words([t.encode() for t in texts]), 5)
    s = [list(h[off[i] : off[i + 1]]) for i in range(len(texts))]
    assert [len(x) for x in s] == [2, 2, 2, 1, 0, 1]
    assert s[0] == s[1] and s[0][1] == s[2][0] and s[5][0] == s[0][0] and s[3][0] != s[0][0]


def test_elias_fano():
    rng = random.Random(2)
    for _ in range(150):
        n, top = rng.choice([0, 1, 2, 5, 50, 1000]), rng.choice([1, 3, 100, 10**6, 2**45, 2**63])
        v = np.sort(np.array([rng.randrange(top) for _ in range(n)], np.uint64))
        e = EliasFano.of(v)
        assert (e.get(np.arange(n)) == v).all()
        keys = np.array([rng.randrange(top) for _ in range(50)] + list(v[:20]) + [0, 2**64 - 1], np.uint64)
        place, equal = e.successor(keys)
        assert (place == np.searchsorted(v, keys)).all() and (equal == np.isin(keys, v)).all()


def test_elias_fano_is_compact():
    v = np.arange(0, 64_000_000, 640, dtype=np.uint64)
    bits = sum(p.nbytes for p in EliasFano.of(v).parts()) * 8 / len(v)
    assert bits < np.log2(640) + 4.5


def tokens(text):
    return WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) + ["</s>"]


@pytest.mark.parametrize("sampled", [lm_trie.SAMPLED, 1])
def test_trie_against_counting(spark, monkeypatch, sampled):
    monkeypatch.setattr(lm_trie, "SAMPLED", sampled)
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["The", "the", "of", "É", f"w{rng.randrange(300)}"]) for _ in range(rng.randint(0, 40))) for _ in range(300)] + [None, "", "a " * 100_000, "zz"]
    docs = spark.createDataFrame([(i, x, 1, 2) for i, x in enumerate(texts)] + [(None, "the of", 1, 2)], "doc_id long, text string, held_out int, score int")
    if sampled == 1:  # words that hold more than a shard's part are dealt out, the mark before texts among them
        few = docs.where("doc_id <> 302").selectExpr("coalesce(text, '') as txt")
        shards, slices = lm_trie.layout(few)
        told = collections.Counter(a for x in texts[:302] + texts[303:] for a in ["<s>", *tokens(x)[:-1]])
        parts = shards * lm_trie.FINE
        assert sorted(slices.numbers) == sorted(-(-n * parts // told.total()) for n in told.values() if n * parts > told.total())
        assert max(slices.numbers) > 2 and len(np.unique(slices.keys()[0])) == slices.numbers.sum()
        assert lm_trie.layout(docs.selectExpr("coalesce(text, '') as txt"))[1].numbers.max() > parts * 0.9
    got = {r["doc_id"]: r for r in lm_trie.apply(docs).collect()}
    assert len(got) == len(texts) + 1
    learned = [tokens(x) for i, x in [*enumerate(texts), ("", "the of")] if zlib.crc32(str(i).encode()) % 7 != 2]
    one = collections.Counter(w for x in learned for w in x)
    two = collections.Counter(p for x in learned for p in zip(["<s>", *x], x))
    types, total = collections.Counter(a for a, _ in two), collections.Counter()
    for (a, _), n in two.items():
        total[a] += n
    three = collections.Counter(p for x in learned for p in zip(["<s>", *x], x, x[1:]))
    types3, total3 = collections.Counter((a, b) for a, b, _ in three), collections.Counter()
    for (a, b, _), k in three.items():
        total3[a, b] += k
    n, v = sum(one.values()), len(one)
    for i, x in enumerate(texts):
        w = tokens(x)
        r = got[i]
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 7 == 2)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(one[t] > 0 for t in w), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((one[t] + 1) / (n + v + 1)) for t in w), rel=1e-9)
        p = [(two[a, b] + types[a] * (one[b] + 1) / (n + v + 1)) / (total[a] + types[a]) if total[a] else (one[b] + 1) / (n + v + 1) for a, b in zip(["<s>", *w], w)]
        for k, (h, a, b) in enumerate(zip(["<s>", *w], w, w[1:]), 1):
            if two[h, a] >= lm_trie.TWICE:
                p[k] = (three[h, a, b] + types3[h, a] * p[k]) / (total3[h, a] + types3[h, a])
        assert r["score"] == pytest.approx(sum(map(math.log10, p)), abs=len(w) / lm_trie.STEPS)
    none = docs.where("false")
    assert lm_trie.apply(none).count() == 0
    # nothing to learn from: all unknown
    held = docs.where("doc_id = 9").withColumn("doc_id", __import__("pyspark").sql.functions.lit(next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 2)).cast("long"))
    assert lm_trie.apply(held).first()["n_known"] == 0


def test_kneser_ney_sums_to_one(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("abc d\n") for _ in range(rng.randint(0, 200))) for _ in range(60)]
    top = kn_quality.count_runs(spark.createDataFrame([(t,) for t in texts], "txt string"))
    model = kn_quality.estimate(top)
    for most in (10**9, 40):
        parts = kn_quality.shards(model, most)
        for context in (b"abca", b"\0\0\0a", b"zzzz", b"zzza", b"bc d"):
            base = int.from_bytes(context, "big") << 8
            codes = np.array([base | c for c in range(256)], np.uint64)
            assert np.exp(sum(s.logp(codes) for s in parts)).sum() == pytest.approx(1, abs=1e-9)
        assert len(parts) == 1 or most == 40


def kneser_ney_by_hand(texts, order):
    """P(byte | context) of interpolated modified Kneser-Ney, from the counts alone."""
    top = collections.Counter()
    for t in texts:
        raw = b"\0" * (order - 1) + t.encode() + b"\1"
        top.update(raw[i : i + order] for i in range(len(raw) - order + 1))
    n = {order: top}
    for k in range(order - 1, 0, -1):
        n[k] = collections.Counter(r[1:] for r in n[k + 1])
    cuts = {}
    for k, t in n.items():
        n1, n2, n3, n4 = (max(sum(c == i for c in t.values()), 1) for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2)
        cuts[k] = [min(max(d, 0.05), i - 0.05) for i, d in enumerate((1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3), 1)]

    def p(run):
        k = len(run)
        if not k:
            return 1 / 256
        after = {r: c for r, c in n[k].items() if r[:-1] == run[:-1]}
        if not after:
            return p(run[1:])
        d = lambda c: cuts[k][min(c, 3) - 1]
        own = n[k].get(run, 0)
        return ((own - d(own)) if own else 0) / sum(after.values()) + sum(map(d, after.values())) / sum(after.values()) * p(run[1:])

    return p


def test_kneser_ney_by_hand(spark):
    rng = random.Random(14)
    texts = ["".join(rng.choice("aab c") for _ in range(rng.randint(0, 60))) for _ in range(25)]
    p = kneser_ney_by_hand(texts, kn_quality.ORDER)
    model = kn_quality.estimate(kn_quality.count_runs(spark.createDataFrame([(t,) for t in texts], "txt string")))
    other = ["abc ca", "zz", "", texts[0], "aaaaabbbbb"]
    docs = spark.createDataFrame(list(enumerate(other)), "doc_id long, txt string")
    for most in (10**9, 30):
        got = {r["doc_id"]: r["bits"] for r in kn_quality.log_perplexity(docs, kn_quality.shards(model, most)).collect()}
        for i, t in enumerate(other):
            raw = b"\0" * 4 + t.encode() + b"\1"
            assert got[i] == pytest.approx(-sum(math.log2(p(raw[j : j + 5])) for j in range(len(raw) - 4)) / (len(t) + 1))


def test_classifier_tells_junk(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice(["an", "er", "th", "on", "re"]) for _ in range(rng.randint(1, 3)))
    good = [" ".join(word() for _ in range(60)) for _ in range(200)]
    junk = ["".join(rng.choice("#$%&*Q!") for _ in range(200)) for _ in range(20)]
    odd = [None, "", "x" * 3_000_000]
    texts = good + junk + odd
    docs = spark.createDataFrame([(i, x, "en" if i % 2 else None, 1, 2) for i, x in enumerate(texts)] + [(0, good[0], None, 1, 2)], "doc_id long, text string, lang string, bits int, bytes int")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(150)] + [(200, 0, 0), (201, None, 0)], "doc_id long, quality int, toxic int")
    got = collections.defaultdict(list)
    for r in kn_quality.classify(docs, labels).collect():
        got[r["doc_id"]].append(r)
    assert len(got) == len(texts) and len(got[0]) == 2 and got[0][0] == got[0][1]
    assert sum(got[i][0]["kept"] for i in range(200)) >= 196
    assert not any(got[i][0]["kept"] for i in range(200, 220))
    assert got[220][0]["bytes"] == got[221][0]["bytes"] == 1
    assert kn_quality.classify(docs.where("false"), labels).count() == 0
    assert all(r["kept"] for r in kn_quality.classify(docs, labels.where("false")).collect())


def test_shards_add_up(spark):
    texts = ["the quick brown fox", "jumps over", ""]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, txt string")
    model = kn_quality.estimate(kn_quality.count_runs(docs.select("txt")))
    whole = {r["doc_id"]: r["bits"] for r in kn_quality.log_perplexity(docs, kn_quality.shards(model)).collect()}
    parted = {r["doc_id"]: r["bits"] for r in kn_quality.log_perplexity(docs, kn_quality.shards(model, 20)).collect()}
    assert parted == pytest.approx(whole)


def test_shards_keep_every_row(spark):
    texts = ["abcd efgh", "abcd abcd", "hgfe dcba", "hgfe dcba", ""]
    docs = spark.createDataFrame([("en" if i < 4 else None, t) for i, t in enumerate(texts)], "lang string, txt string")
    model = kn_quality.estimate(kn_quality.count_runs(docs.select("txt")))
    whole, parts = kn_quality.shards(model), kn_quality.shards(model, 20)
    assert len(whole) == 1 and len(parts) > 1
    bits = lambda m: sorted((r["lang"] or "", r["bytes"], round(r["bits"], 9)) for r in kn_quality.log_perplexity(docs, m).collect())
    assert bits(parts) == bits(whole) and len(bits(parts)) == len(texts)


def test_limits_over_all_trusted_rows(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(kn_quality, "MAX_TRUSTED_ROWS", 40)
    rng = random.Random(7)
    texts = ["".join(rng.choice("abcd " if i % 8 else "wxyz ") for _ in range(rng.randint(20, 60))) for i in range(400)]
    docs = spark.createDataFrame([(i, x, "en" if i % 8 else "de") for i, x in enumerate(texts)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(400)], "doc_id long, quality int")
    draw = {r[0]: r[1] for r in labels.select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit("trusted")), F.lit(1 << 20))).collect()}
    trained = {i for i, d in draw.items() if d < (1 << 20) // 10 and d % 2 == 0}
    got = kn_quality.classify(docs, labels).collect()
    assert len(got) == 400 and 0 < len(trained) < 40
    for lang in ("en", "de"):
        over = [r["bits"] for r in got if r["lang"] == lang and r["doc_id"] not in trained]
        assert all(r["limit"] == pytest.approx(np.quantile(over, kn_quality.QUANTILE)) for r in got if r["lang"] == lang)


def test_quantised_values_are_looked_up():
    level = object.__new__(lm_trie.Level)
    level.share = level.backoff = np.arange(1 << 16).astype(np.uint16)
    places = np.arange(1 << 16)[::-1]
    want = 10.0 ** (-places.astype(float) / lm_trie.STEPS)
    assert (level.shares(places) == want).all() and (level.weights(places) == want).all()
    assert level.shares(places[:0]).dtype == float and len(level.shares(places[:0])) == 0


def test_bits_are_selected_in_whole_words():
    """The k-th one of a word, for every k, without taking the word apart."""
    from seqloom.llm import elias_fano

    rng = random.Random(11)
    words = [1, 1 << 63, (1 << 64) - 1, 0xFF00FF00FF00FF00, *(rng.getrandbits(64) & rng.getrandbits(64) | 1 << rng.randrange(64) for _ in range(300))]
    want = [(w, k, bit) for w in words for k, bit in enumerate(b for b in range(64) if w >> b & 1)]
    got = elias_fano._select_in(np.array([w for w, _, _ in want], np.uint64), np.array([k for _, k, _ in want], np.uint64))
    assert got.tolist() == [bit for _, _, bit in want] and got.dtype == np.int64
    values = np.sort(np.array([rng.randrange(5000) << 20 for _ in range(3000)], np.uint64))
    keys = np.array([rng.randrange(5100) << 20 for _ in range(2000)], np.uint64)
    at, hit = EliasFano.of(values).successor(keys)  # keys in no order
    assert (at == np.searchsorted(values, keys)).all() and (hit == np.isin(keys, values)).all()


def test_only_trusted_texts_move(spark, monkeypatch):
    """Texts of rows that aren't trusted stay where they are, however large the table of trusted ids is."""
    from pyspark.sql import functions as F

    def moved() -> int:
        store, gateway = spark._jsc.sc().statusStore(), spark.sparkContext._gateway
        stages = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    grew = []

    def counted(df):
        before = moved()
        assert df.count() == half
        grew.append(moved() - before)
        return count(df)

    count = kn_quality.count_runs
    rows = spark.range(4_000)
    text = F.concat_ws("", F.transform(F.sequence(F.lit(1), F.lit(40)), lambda k: F.sha2(F.concat(F.col("id"), k).cast("string"), 256)))  # hex of random bytes, 2560 letters
    docs = rows.select(F.col("id").alias("doc_id"), text.alias("text"), F.lit("en").alias("lang"))
    labels = rows.select(F.col("id").alias("doc_id"), F.when(F.col("id") < 400, 1).otherwise(0).alias("quality"))
    half = labels.where((F.col("quality") == 1) & (F.pmod(F.xxhash64("doc_id", F.lit("trusted")), F.lit(2)) == 0)).count()
    monkeypatch.setattr(kn_quality, "count_runs", counted)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kn_quality.classify(docs.withColumn("text", F.concat("text", F.lit(" "))), labels)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert 0 < half < 400 and grew[0] < 400 * 2560 < 2_000 * 1280


def test_every_trusted_row_trains_or_sets_limits(spark, monkeypatch):
    """Far more trusted rows than were once drawn: half of them are counted, the others are the calibration."""
    from pyspark.sql import functions as F

    seen = []
    count = kn_quality.count_runs
    monkeypatch.setattr(kn_quality, "count_runs", lambda df: seen.append(df.count()) or count(df))
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("ab").alias("text"), F.lit("en").alias("lang"))
    labels = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    assert kn_quality.classify(docs, labels).count() == 20_000
    even = labels.where(F.pmod(F.xxhash64("doc_id", F.lit("trusted")), F.lit(2)) == 0).count()
    assert seen == [even] and 9_000 < even < 11_000


def test_quantiles_are_exact(spark):
    rng = random.Random(8)
    values = {"one": [rng.random() for _ in range(500)], "two": [1.5] * 300 + [1.5 + rng.random() / kn_quality.CELLS for _ in range(7)], "few": [3.25], "pair": [0.1, 7.0]}
    df = spark.createDataFrame([(k, x) for k, xs in values.items() for x in xs], "k string, x double")
    for q in (0.0, 0.5, 0.995, 1.0):
        got = {r["k"]: (r["limit"], r["n"]) for r in kn_quality.quantiles(df, "k", "x", q).collect()}
        assert got == {k: (pytest.approx(np.quantile(xs, q)), len(xs)) for k, xs in values.items()}


def test_isotonic():
    x, y = toxicity.isotonic(np.array([1.0, 2, 3, 4, 5]), np.array([0.0, 1, 0, 1, 1]))
    assert list(np.interp([1, 2, 3, 4, 5], x, y)) == [0, 0.5, 0.5, 1, 1]
    x, y = toxicity.isotonic(np.array([1.0, 1, 1]), np.array([0.0, 1, 1]))
    assert np.interp(1.0, x, y) == pytest.approx(2 / 3)


def test_features_count():
    lex = toxicity.word_hashes(["idiot"])
    you = toxicity.word_hashes(["you"])
    f = toxicity.features([b"You are an IDIOT!", b"", b"id1ot i.d.i.o.t aaa", b"x " * 9 + b"idiot", "é".encode()], lex, lex[:0], you)
    at = {n: i for i, n in enumerate(toxicity.FEATURES)}
    assert f[0][at["strong_per_100"]] == 25 and f[0][at["near_you_share"]] == 1 and f[0][at["exclamations_per_100"]] == 25
    assert not f[1].any()
    assert f[2][at["hidden_log"]] == pytest.approx(np.log1p(2)) and f[2][at["runs_per_100"]] > 0
    assert f[3][at["strong_per_100"]] == 10 and f[3][at["near_you_share"]] == 0


def test_toxicity_held_out(spark):
    rng = random.Random(6)
    bad, plain = ["scum", "idiot", "trash"], [f"w{i}" for i in range(80)]
    rows = []
    for i in range(900):
        words = [rng.choice(plain) for _ in range(rng.randint(5, 80))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(rng.randint(1, 4)):
                words[rng.randrange(len(words))] = rng.choice(bad)
        rows.append((i, " ".join(words), "en", int(toxic)))
    rows += [(2000, None, None, 0), (2001, "", None, None), (2002, "z " * 200_000, None, 0), (None, "scum", None, None)]
    docs = spark.createDataFrame([(i, x, lang, 1, 2) for i, x, lang, _ in rows], "doc_id long, text string, lang string, score int, y int")
    labels = spark.createDataFrame([(i, y, 1) for i, _, _, y in rows if i is not None] + [(0, 0, 0)], "doc_id long, toxic int, quality int")
    got = {r["doc_id"]: r for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())
    held = [(got[i]["predicted"], y) for i, _, _, y in rows[:900] if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, *_ in rows[:900])
    assert sum(p == y for p, y in held) / len(held) > 0.97
    assert toxicity.score(docs.where("false"), toxicity.fit(docs, labels)).count() == 0
    none = toxicity.fit(docs, labels.where("false"))
    assert {r["score"] for r in toxicity.score(docs, none).collect()} == {0.0}
