"""Hard negatives by bit-sliced integer products.

Components are whole numbers in two's complement. A task holds a block of anchors and streams rows
past it; of each tile of rows it multiplies bit-planes from the most significant one on. After
plane k what the planes below can still add lies between 2**k - 1 times the anchor's negative and
its positive components, so each product is known within an interval that halves with every
plane. A pair whose interval can't reach a window any more, or lies below the k-th best that is
certain, is dropped; the others go on, at first as whole matrices, then, once few are left, pair by pair.
The last plane makes the interval a single number, so results are exact.

An anchor's positives are found first, among the rows of its label; their scores set the windows of
the negatives. Anchors are dealt to blocks and rows to stripes; a task meets one block and one stripe and
leaves each anchor's best, which Spark ranks. A label that holds most rows is as many tasks as any rows.

Defined cases: rows without label, vector or vec_id take no part, nor those with a component that
is null, not finite, or beyond 2**24 after scaling (products of such don't fit 64 bits); of rows that share
vec_id the one with the least label and vector counts; ties go to the smaller vec_id; a shorter
vector counts as padded with zeros; an anchor without positives, or without rows in a window, has no rows;
an empty table gives none; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keep, ship

#: What is asked for each anchor, and the window of a negative's score in hundredths of the positive's.
POSITIVES, NEGATIVES, LOW, HIGH = 5, 10, 30, 90
#: A component x becomes floor(SCALE * x).
SCALE = 256
#: Anchors in a block; rows in a stripe at most, and at least where tasks are few.
ANCHOR_BLOCK, STRIPE_ROWS, LEAST_STRIPE = 4096, 1 << 20, 2048
#: Pairs in a tile: rows times anchors.
TILE = 1 << 20
#: Planes in the first product, and the share of pairs below which they are taken one by one.
FIRST_PLANES, SPARSE = 4, 0.1
_BOUND = 1 << 24
_LEAST, _MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def usable(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, q) of the rows that take part; q are the components as whole numbers."""
    x = F.col("embedding")
    fits = F.forall(x, lambda c: F.coalesce((c.cast("double") * scale >= -_BOUND) & (c.cast("double") * scale < _BOUND + 1), F.lit(False)))  # NaN sorts above all
    q = F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("int"))
    some = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & fits)
    one = some.select(F.col("vec_id").cast("long").alias("vec_id"), F.struct(F.col("label").cast("long").alias("label"), q.alias("q")).alias("r"))
    return one.groupBy("vec_id").agg(F.min("r").alias("r")).select("vec_id", "r.label", "r.q")


def matrix(lists) -> np.ndarray:
    """An Arrow list array as a matrix of long; shorter lists are padded."""
    flat, ends = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    size = np.diff(ends)
    width = int(size.max()) if len(size) else 0
    if (size == width).all():
        return flat.reshape(len(size), width).astype(np.int64)
    out = np.zeros((len(size), width), np.int64)
    out[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(ends[:-1] - ends[0], size)] = flat
    return out


def _as_wide(x: np.ndarray, width: int) -> np.ndarray:
    return x if x.shape[1] == width else np.pad(x, ((0, 0), (0, width - x.shape[1])))


class Best:
    """The first ``k`` rows of each anchor whose score lies in [low, high], by falling score and rising id."""

    def __init__(self, k: int, low: np.ndarray, high: np.ndarray):
        self.k, self.low, self.high = k, low, high
        self.least = np.full(len(low), _LEAST)  # the k-th best so far, where there are k
        self.anchor, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, anchor: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        fits = (score >= self.low[anchor]) & (score <= self.high[anchor]) & (score >= self.least[anchor])
        if not fits.any():
            return
        a, s, i = (np.concatenate([x, y[fits]]) for x, y in ((self.anchor, anchor), (self.score, score), (self.id, ids)))
        order = np.lexsort((i, -s, a))
        a, s, i = a[order], s[order], i[order]
        begin = np.searchsorted(a, a)  # where each row's anchor begins
        rank = np.arange(len(a)) - begin
        stays = rank < self.k
        full = rank == self.k - 1
        self.least[a[full]] = s[full]
        self.anchor, self.score, self.id = a[stays], s[stays], i[stays]


def tile(anchors: np.ndarray, rows: np.ndarray, ids: np.ndarray, eligible: np.ndarray, best: list[Best]) -> int:
    """Add the eligible pairs that may be among the best; ``eligible``: anchors by rows. Returns how many pairs were taken to the last plane."""
    width = max(anchors.shape[1], rows.shape[1])
    anchors, rows = _as_wide(anchors, width).astype(np.float64), _as_wide(rows, width)
    up, down = np.maximum(anchors, 0).sum(axis=1).astype(np.int64), np.minimum(anchors, 0).sum(axis=1).astype(np.int64)
    bits = int(np.abs(rows).max()).bit_length() if rows.size else 0
    k = max(0, bits - FIRST_PLANES)
    score = (anchors @ (rows >> k).astype(np.float64).T).astype(np.int64) << k  # the planes from the sign down to k
    alive, sure = eligible, [b.least for b in best]
    while True:
        slack = (1 << k) - 1
        low, high = score + slack * down[:, None], score + slack * up[:, None]
        reach = np.zeros(alive.shape, bool)
        for n, b in enumerate(best):
            if alive.shape[1] > b.k and k:  # pairs that are certain to lie in the window
                certain = np.where(alive & (low >= b.low[:, None]) & (high <= b.high[:, None]), low, _LEAST)
                sure[n] = np.maximum(sure[n], -np.partition(-certain.clip(_LEAST + 1), b.k - 1, axis=1)[:, b.k - 1])
            reach |= (high >= np.maximum(b.low, sure[n])[:, None]) & (low <= b.high[:, None])
        alive = alive & reach
        if not k or alive.sum() < SPARSE * alive.size:
            break
        k -= 1
        score += (anchors @ ((rows >> k) & 1).astype(np.float64).T).astype(np.int64) << k
    a, r = np.nonzero(alive)
    value = score[a, r]
    while k and len(a):
        k -= 1
        plane = ((rows >> k) & 1).astype(np.float64)
        for at in range(0, len(a), 1 << 15):
            part = slice(at, at + (1 << 15))
            value[part] += np.einsum("nd,nd->n", anchors[a[part]], plane[r[part]]).astype(np.int64) << k
        slack = (1 << k) - 1
        low, high = value + slack * down[a], value + slack * up[a]
        stays = np.zeros(len(a), bool)
        for n, b in enumerate(best):
            stays |= (high >= np.maximum(b.low, sure[n])[a]) & (low <= b.high[a])
        a, r, value = a[stays], r[stays], value[stays]
    for b in best:
        b.add(a, value, ids[r])
    return len(a)


def _stripes(rows: Column, blocks: Column, tasks: int) -> Column:
    """Stripes for so many rows and blocks of anchors: none longer than STRIPE_ROWS, and enough of them for the tasks unless they get short."""
    for_tasks = F.least(F.ceil(rows / LEAST_STRIPE), F.ceil(F.lit(tasks) / blocks))
    return F.greatest(F.ceil(rows / STRIPE_ROWS), for_tasks, F.lit(1)).cast("int")


def _met(anchors: DataFrame, rows: DataFrame, cell: str | None, run, schema: str) -> DataFrame:
    """``run`` over the sorted rows of each block and stripe, the block's anchors first. Both hold the columns blocks and stripes."""
    dealt = lambda c, parts: F.pmod(F.xxhash64("vec_id", F.lit(c)), F.col(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    a = anchors.withColumn("block", dealt("block", "blocks")).withColumn("stripe", every("stripes"))
    r = rows.withColumn("stripe", dealt("stripe", "stripes")).withColumn("block", every("blocks"))
    cells, none = ["cell", "block", "stripe"], F.lit(None).cast("array<long>")
    own = (F.col(cell) if cell else F.lit(0)).cast("long").alias("cell")
    both = a.select(own, "block", "stripe", F.lit(0).alias("kind"), "vec_id", "label", "q", "ids", "scores").union(r.select(own, "block", "stripe", F.lit(1).alias("kind"), "vec_id", "label", "q", none, none))
    return both.repartition(*cells).sortWithinPartitions(*cells, "kind", "vec_id").mapInArrow(run, schema)


def _groups(batches, begin, push, end):
    """Feed runs of one cell to the callbacks: anchors (all of a cell's at once), rows (a batch at a time), the end."""
    import pyarrow as pa

    now, anchors, open_ = None, [], False
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch[c].to_numpy() for c in ("cell", "block", "stripe", "kind")], axis=1)
        edges = np.concatenate(([0], np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1, [len(key)]))
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            cell, kind = tuple(key[lo, :3]), key[lo, 3]
            part = batch.slice(lo, hi - lo)
            if cell != now:
                if open_:
                    yield from end()
                now, anchors, open_ = cell, [], False
            if kind == 0:
                anchors.append(part)
                continue
            if anchors:
                begin(pa.Table.from_batches(anchors).combine_chunks().to_batches()[0])
                anchors, open_ = [], True
            if open_:
                push(part)
    if open_:
        yield from end()


class _Task:
    def __init__(self, windows, same: bool, k: int):
        self.windows, self.same, self.k = windows, same, k

    def begin(self, batch) -> None:
        self.batch, self.ids = batch, batch["vec_id"].to_numpy()
        self.q, self.label = matrix(batch["q"]), batch["label"].to_numpy()
        self.best = self.windows(batch, self.k)

    def push(self, batch) -> None:
        q, ids, label = matrix(batch["q"]), batch["vec_id"].to_numpy(), batch["label"].to_numpy()
        step = max(64, TILE // len(self.ids))
        for at in range(0, len(ids), step):
            part = slice(at, at + step)
            alike = self.label[:, None] == label[None, part]
            tile(self.q, q[part], ids[part], alike & (self.ids[:, None] != ids[None, part]) if self.same else ~alike, self.best)


def _everything(batch, k: int) -> list[Best]:
    n = batch.num_rows
    return [Best(k, np.full(n, _LEAST), np.full(n, _MOST))]


def mine(rows: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the anchors among ``rows`` (vec_id, embedding, label).

    A negative is a row of another label with low * positive <= 100 * negative <= high * positive.
    """
    import pyarrow as pa

    spark = rows.sparkSession
    ship(spark)
    rows = keep(usable(rows), "rows")
    none = F.lit(None).cast("array<long>")
    anchors = rows.where(anchor)
    tasks = 2 * spark.sparkContext.defaultParallelism

    def first(batches):
        task = _Task(_everything, True, positives)

        def end():
            (b,) = task.best
            yield pa.RecordBatch.from_arrays([pa.array(task.ids[b.anchor]), pa.array(b.id), pa.array(b.score)], ["anchor_id", "positive_id", "positive_score"])

        return _groups(batches, task.begin, task.push, end)

    n = rows.groupBy("label").agg(F.count_if(anchor).alias("n_anchors"), F.count(F.lit(1)).alias("n_rows")).where("n_anchors > 0")
    n = keep(n.withColumn("blocks", F.ceil(F.col("n_anchors") / ANCHOR_BLOCK).cast("int")).select("label", "blocks", _stripes(F.col("n_rows"), F.col("blocks"), tasks).alias("stripes")), "labels")
    found = _met(anchors.select("*", none.alias("ids"), none.alias("scores")).join(n, "label"), rows.join(n, "label"), "label", first, "anchor_id long, positive_id long, positive_score long")
    order = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    ranked = found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= positives)
    own = ranked.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("n", "positive_id", "positive_score"))).alias("p"))
    told = keep(anchors.join(own.withColumnRenamed("anchor_id", "vec_id"), "vec_id").select("vec_id", "label", "q", F.col("p.positive_id").alias("ids"), F.col("p.positive_score").alias("scores")), "anchors")

    def windows(batch, k: int) -> list[Best]:
        scores = matrix(batch["scores"])
        there = np.arange(scores.shape[1]) < np.diff(batch["scores"].offsets.to_numpy())[:, None]
        least, most = -(-low * scores // 100), high * scores // 100
        return [Best(k, np.where(t, a, _MOST), np.where(t, b, _LEAST)) for t, a, b in zip(there.T, least.T, most.T, strict=True)]

    def second(batches):
        task = _Task(windows, False, negatives)

        def end():
            ids, scores = matrix(task.batch["ids"]), matrix(task.batch["scores"])
            for n, b in enumerate(task.best):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (task.ids[b.anchor], ids[b.anchor, n], b.id, scores[b.anchor, n], b.score)], ["anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"])

        return _groups(batches, task.begin, task.push, end)

    blocks = F.lit(max(1, -(-told.count() // ANCHOR_BLOCK)))  # counts come from the files' footers
    sized = lambda df: df.withColumn("blocks", blocks).withColumn("stripes", _stripes(F.lit(rows.count()), blocks, tasks))
    near = _met(sized(told), sized(rows), None, second, "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long")
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
