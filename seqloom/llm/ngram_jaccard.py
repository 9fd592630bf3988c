"""N-gram Jaccard join with Bayesian candidate pruning.

1. Each text gets HASHES MinHash values over its five-word shingles; BANDS bands of ROWS values make
   keys, and texts that share a key are tied to the least of them: a star, never all pairs.
2. Connected stars form candidate sets. Each set is dealt into blocks, and each pair of blocks is one
   unit of work of bounded size, whatever the set's size. Within a unit, MinHash values of each pair
   are compared STEP at a time, and a pair is dropped once the posterior probability (uniform prior)
   that its similarity reaches the threshold falls below TOLERANCE. The rest is verified exactly on
   the shingle sets. A unit returns one row per text and one edge per joined text, not its pairs.
3. Verified edges give the classes; links are summed.

A pair at the threshold shares a band with probability 1 - (1 - 0.8^6)^40 > 0.99999, more similar
ones sooner; the pruning loses one at the threshold with probability below TOLERANCE a step. Equal
texts are told by a 64-bit hash and joined before all this.

Defined cases: null text counts as empty; a text without words is similar only to its equals; one
of fewer than five words has a single shingle of them all; rows that share doc_id and text count as
copies (they stay or go together); null doc_id sorts above the others; an empty table gives no rows; other columns are left alone.
"""

from __future__ import annotations

from math import comb

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bloom_of, bloom_words, bound_batches, components, in_bloom, keep, salted, ship, text_of

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 40, 6
HASHES = BANDS * ROWS
STEP, TOLERANCE = 24, 1e-6
#: A block holds about so many texts and bytes of text; a unit is two blocks.
BLOCK_TEXTS, BLOCK_BYTES = 200, 1 << 21
_ODD = np.random.RandomState(7).randint(0, 1 << 31, HASHES).astype(np.uint32) * np.uint32(2) + np.uint32(1)  # multipliers of the permutations


def least_agreeing(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[int]:
    """After n values compared, the least agreements with which a pair stays.

    With a uniform prior, n values and m agreements, the similarity is Beta(m + 1, n - m + 1), so it
    reaches t with the probability that a Binomial(n + 1, t) is at most m.
    """
    out = []
    for n in range(HASHES + 1):
        below, m = 0.0, -1
        while below < tolerance and m < n:
            m += 1
            below += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


def signatures(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """MinHash values (texts x HASHES; largest value where a text has no words), shingle hashes, their offsets."""
    from .textnum import Words, shingles

    hashes, off = shingles(Words(texts), SHINGLE)
    out = np.full((len(texts), HASHES), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(np.diff(off))
    if len(full):
        short = (hashes >> np.uint64(32)).astype(np.uint32)
        starts, buf = off[:-1][full], np.empty_like(short)
        for k in range(HASHES):
            np.multiply(short, _ODD[k], out=buf)
            out[full, k] = np.minimum.reduceat(buf, starts)
    return out, hashes, off


def band_keys(values: np.ndarray) -> np.ndarray:
    """A 64-bit key for each text and band."""
    from .textnum import mixed

    v = values.reshape(len(values), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), v.shape[:2])
    for j in range(ROWS):
        key = mixed(key * np.uint64(0xD6E8FEB86659FD93) + v[:, :, j])
    return key.view(np.int64)


def _keyed(batches):
    """(node, text) to (node, keys); texts without words have no keys."""
    import pyarrow as pa

    from .textnum import batches as parts
    from .textnum import column_bytes, forget, release

    forget()
    for batch in batches:
        texts = column_bytes(batch["txt"])
        for a, b in parts(texts):
            values, _, off = signatures(texts[a:b])
            some = np.flatnonzero(np.diff(off))
            keys = band_keys(values[some])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS), pa.int32()), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([batch["node"].slice(a, b - a).take(pa.array(some)), lists], ["node", "keys"])
    release()


def similar_pairs(left: np.ndarray, right: np.ndarray | None, values: np.ndarray, sets: list[np.ndarray], least: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (i, j), i in ``left`` and j in ``right`` (without ``right``: i before j in ``left``), of similarity THRESHOLD or more."""
    found_i, found_j = [], []
    for at in range(0, len(left), 256):
        rows = left[at : at + 256]
        i, j = np.meshgrid(rows, left if right is None else right, indexing="ij")
        i, j = i.ravel(), j.ravel()
        if right is None:
            i, j = i[(up := i < j)], j[up]
        agree = np.zeros(len(i), np.int32)
        for n in range(0, HASHES, STEP):
            for s in range(0, len(i), 1 << 16):
                part = slice(s, s + (1 << 16))
                agree[part] += (values[i[part], n : n + STEP] == values[j[part], n : n + STEP]).sum(1, dtype=np.int32)
            on = agree >= least[n + STEP]
            i, j, agree = i[on], j[on], agree[on]
            if not len(i):
                break
        found_i.append(i)
        found_j.append(j)
    i, j = np.concatenate(found_i), np.concatenate(found_j)
    if not len(i):
        return i, j
    both = common_sizes(i, j, sets)
    sizes = np.fromiter((len(s) for s in sets), np.int64, len(sets))
    on = both * 5 >= 4 * (sizes[i] + sizes[j] - both)  # THRESHOLD as a fraction, without rounding
    return i[on], j[on]


def common_sizes(i: np.ndarray, j: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """Elements that sets i and j share, exactly."""
    if len(i) <= 48:
        return np.fromiter((len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i, j, strict=True)), np.int64, len(i))
    used = np.unique(np.concatenate((i, j)))
    place = np.zeros(len(sets), np.int64)
    place[used] = np.arange(len(used))
    owner = np.repeat(np.arange(len(used)), [len(sets[u]) for u in used])
    _, column, often = np.unique(np.concatenate([sets[u] for u in used]), return_inverse=True, return_counts=True)
    shared = often[column] > 1
    owner, column = owner[shared], column[shared]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    total = np.zeros((len(used), len(used)), np.float32)  # whole numbers below 2^24 are exact
    width = 4096
    names, column = np.unique(column, return_inverse=True)
    for c in range(0, len(names), width):
        a, b = np.searchsorted(column, (c, c + width))
        block = np.zeros((len(used), width), np.float32)
        block[owner[a:b], column[a:b] - c] = 1
        total += block @ block.T
    return total[place[i], place[j]].astype(np.int64)


def judge_unit(texts: list[bytes], first: np.ndarray, second: np.ndarray, same: bool, least: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Links found of each text, and for each the least text (by place) it is joined to in this unit."""
    values, hashes, off = signatures(texts)
    sets = [np.unique(hashes[off[t] : off[t + 1]]) for t in range(len(texts))]
    i, j = similar_pairs(first, None if same else second, values, sets, least)
    links = np.bincount(i, minlength=len(texts)) + np.bincount(j, minlength=len(texts))
    low = np.arange(len(texts))
    while True:
        was = low.copy()
        np.minimum.at(low, i, low[j])
        np.minimum.at(low, j, low[i])
        low = low[low]
        if (low == was).all():
            return links, low


def _judged(batches):
    """Rows (comp, a, b, block, node, txt) sorted by comp, a, b to (node, links, low); a unit may span batches."""
    import pyarrow as pa

    from .textnum import column_bytes, forget, release

    forget()
    least = least_agreeing()
    unit, nodes, blocks, texts = None, [], [], []

    def result():
        block = np.array(blocks)
        first, second = np.flatnonzero(block == unit[1]), np.flatnonzero(block == unit[2])
        links, low = judge_unit(texts, first, second, unit[1] == unit[2], least)
        ids = np.array(nodes, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(links.astype(np.int64)), pa.array(ids[low])], ["node", "links", "low"])

    for batch in batches:
        for key, block, node, txt in zip(zip(*(batch[c].to_pylist() for c in ("comp", "a", "b")), strict=True), batch["block"].to_pylist(), batch["node"].to_pylist(), column_bytes(batch["txt"]), strict=True):
            if key != unit:
                if len(nodes) > 1:
                    yield result()
                unit, nodes, blocks, texts = key, [], [], []
            nodes.append(node)
            blocks.append(block)
            texts.append(txt)
    if len(nodes) > 1:
        yield result()
    release()


def stars(keyed: DataFrame) -> DataFrame:
    """(a, b): each text of a band key tied to the key's least text."""
    keys = keyed.select("node", F.explode("keys").alias("key"))
    lows = keys.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("key", "low")
    return salted(keys, lows, ["key"], "inner", F.col("node")).where("node <> low").select(F.col("low").alias("a"), F.col("node").alias("b")).distinct()


def linked(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, links) and (node, comp) of the texts that have links; node is the text's hash. ``docs``: node and txt."""
    ship(docs.sparkSession)
    bound_batches(docs.sparkSession)
    keyed = keep(docs.mapInArrow(_keyed, "node long, keys array<long>"), "keys")
    sets = components(keep(stars(keyed), "stars"))
    many = bloom_words(sets.count())
    bloom = bloom_of(sets.select("node"), F.xxhash64("node"), many)
    some = in_bloom(docs, F.xxhash64("node"), bloom, many).where("maybe").groupBy("node").agg(F.first("txt").alias("txt"))
    placed = some.join(sets, "node")
    sizes = placed.groupBy("comp").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("txt")).alias("bytes"))
    sizes = keep(sizes.where("n > 1").select("comp", F.ceil(F.greatest(F.col("n") / BLOCK_TEXTS, F.col("bytes") / BLOCK_BYTES)).alias("blocks")), "sizes")
    dealt = salted(placed, sizes, ["comp"], "inner", F.col("node")).withColumn("block", F.pmod(F.xxhash64("node", F.lit("block")), F.col("blocks")))
    units = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select("comp", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "block", "node", "txt")
    spread = units.repartition(F.col("comp"), F.col("a"), F.col("b")).sortWithinPartitions("comp", "a", "b", "node")
    told = keep(spread.mapInArrow(_judged, "node long, links long, low long"), "links")
    links = told.groupBy("node").agg(F.sum("links").alias("links")).where("links > 0")
    return links, components(told.where("node <> low").select(F.col("low").alias("a"), F.col("node").alias("b")))


def _told(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows as (doc_id, node), and of each text: node, low (its least doc_id), class_id, winner (the class's text that has it), n_links, n_copies."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("txt")).withColumn("node", F.xxhash64("txt"))
    links, comps = linked(rows.select("node", "txt"))
    per_text = rows.select("node", "doc_id").groupBy("node").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("n_copies"))
    per_text = per_text.join(comps, "node", "left").join(links, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    first = F.min(F.struct(F.col("low").isNull().alias("none"), "low", "node"))
    per_class = per_text.groupBy("comp").agg(first.alias("first")).select("comp", F.col("first.low").alias("class_id"), F.col("first.node").alias("winner"))
    told = salted(per_text, per_class, ["comp"], "left", F.col("node")).select("node", "low", "class_id", "winner", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), "n_copies")
    return rows.select("doc_id", "node"), keep(told, "texts")


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (least doc_id of its class), n_links (other texts of similarity 0.8 or more), n_copies (rows of the same text) of each row."""
    rows, told = _told(docs)
    return salted(rows, told, ["node"], "left", F.col("doc_id")).select("doc_id", "class_id", "n_links", "n_copies")


def dedup(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns: of each class the document with the least doc_id.

    Only rows that may have to go shuffle; the rest pass straight through.
    """
    narrow, told = _told(docs)
    stays = (F.col("node") == F.col("winner")) & F.col("doc_id").eqNullSafe(F.col("low"))
    some = told.where("n_copies > 1 or node <> winner")
    gone = keep(salted(narrow, some, ["node"], "inner", F.col("doc_id")).where(~stays).select("doc_id", "node").distinct(), "gone")
    words = bloom_words(gone.count())
    bloom = bloom_of(gone, F.xxhash64("doc_id", "node"), words)
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(text_of()).alias("own"))
    marked = in_bloom(rows, F.xxhash64("id", "own"), bloom, words)
    left = marked.where("maybe").join(gone, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("own") == F.col("node")), "left_anti")
    return marked.where("not maybe").select("row.*").unionByName(left.select("row.*"))
