"""Mixing sources to target weights by temperature.

Token shares p of the sources are raised to an exponent a and normalised to weights; a is bisected
until the weights reach a target entropy, or until no source is repeated more than a limit allows
within the budget. The weights are then realised as budgeted block permutations: documents are dealt
by hash into blocks, each epoch orders a source's blocks by another hash, whole blocks are taken up
to the source's quota, and only the one block that crosses it is ordered row by row.

Defined cases: null source is a source of its own, null or empty text has no tokens and comes once
with each epoch of its block; equal rows and ties each count and share a block; very long texts count
whole and may overshoot a quota by themselves; a source without any token is left out of the
weights and its rows come once; an empty table gives no rows; other columns are left alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_kept, keep, text_of, words_of

#: A block holds about so many tokens; more documents make more blocks, never larger ones.
BLOCK_TOKENS = 1 << 20
#: Passes over a source in a budget as large as the corpus.
MAX_REPEATS = 2.0
STEPS = 60
#: Exponents that one job sums when there are too many sources for the driver.
GRID = 31


def weights(tokens: list[int], a: float) -> list[float]:
    """Shares raised to ``a``, normalised; 1 leaves the shares, 0 makes them equal."""
    top = max(tokens)
    raw = [(t / top) ** a for t in tokens]
    total = sum(raw)
    return [x / total for x in raw]


def entropy(w: list[float]) -> float:
    return -sum(x * math.log(x) for x in w if x > 0)


def exponent(tokens: list[int], budget: float, max_repeats: float | None = MAX_REPEATS, target_entropy: float | None = None) -> float:
    """The exponent in [0, 1] that reaches ``target_entropy``, else the least that repeats no source over ``max_repeats``.

    Entropy falls and the largest repetition falls as the exponent grows, so each is bisected.
    """
    if not tokens:
        return 1.0
    if target_entropy is not None:
        high = lambda a: entropy(weights(tokens, a)) > target_entropy
    else:
        high = lambda a: max(w * budget / t for w, t in zip(weights(tokens, a), tokens, strict=True)) > max_repeats
    low, top = 0.0, 1.0
    if not high(low):
        return low
    for _ in range(STEPS):
        mid = (low + top) / 2
        low, top = (mid, top) if high(mid) else (low, mid)
    return top


def _draw(*what: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), *what)


def counted(docs: DataFrame) -> DataFrame:
    """(src, fine, n): source, a hash of id and text, and words of each row. Texts are parted into words here and, for the blocks that are cut, once more."""
    rows = docs.select(F.col("source").cast("string").alias("src"), F.col("doc_id").alias("id"), text_of().alias("txt"))
    return rows.select("src", F.xxhash64("id", "txt").alias("fine"), F.size(words_of(F.col("txt"))).alias("n"))


def shares(counts: DataFrame) -> DataFrame:
    """(source, tokens, rows) of what ``counted`` gives, partly summed before the shuffle."""
    return counts.groupBy(F.col("src").alias("source")).agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("rows"))


def wide_exponent(per_source: DataFrame, top: int, least: int, budget: float, max_repeats: float | None = MAX_REPEATS, target_entropy: float | None = None) -> float:
    """``exponent`` for more sources than the driver should hold: each job sums GRID exponents at once, so a few jobs narrow it to STEPS bits."""
    low, high = 0.0, 1.0
    first = True
    for _ in range(math.ceil(STEPS / math.log2(GRID + 1))):
        grid = [low] * first + [low + (high - low) * k / (GRID + 1) for k in range(1, GRID + 1)]
        raw = [F.pow(F.col("tokens") / F.lit(top), F.lit(a)) for a in grid]
        row = per_source.agg(*[f.alias(f"{n}{k}") for k, x in enumerate(raw) for n, f in (("s", F.sum(x)), ("l", F.sum(x * F.ln(x))))]).first()
        # of weights x / s the entropy is ln(s) - sum(x ln x) / s, and the least source is repeated most
        over = [(math.log(row[f"s{k}"]) - row[f"l{k}"] / row[f"s{k}"] > target_entropy) if target_entropy is not None else ((least / top) ** a / row[f"s{k}"] * budget / least > max_repeats) for k, a in enumerate(grid)]
        if first and not over[0]:
            return low
        first = False
        low = max([low, *(a for a, o in zip(grid, over, strict=True) if o)])
        high = min([high, *(a for a, o in zip(grid, over, strict=True) if not o and a > low)])
    return high


def quotas(counts: DataFrame, budget: int | None = None, max_repeats: float = MAX_REPEATS, target_entropy: float | None = None, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(source, tokens, weight, quota, blocks): one row per source that has tokens, from what ``counted`` gives.

    Up to MAX_BROADCAST_SOURCES token counts come to the driver; beyond, the exponent is found by sums over the table.
    """
    per_source = keep(shares(counts).where("tokens > 0").select("source", "tokens"), "shares")
    whole = per_source.agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("all"), F.max("tokens").alias("top"), F.min("tokens").alias("least")).first()
    total = whole["all"] or 0
    budget = total if budget is None else budget
    if whole["n"] <= MAX_BROADCAST_SOURCES:
        a = exponent([r[0] for r in per_source.select("tokens").collect()], budget, max_repeats, target_entropy)
    else:
        a = wide_exponent(per_source, whole["top"], whole["least"], budget, max_repeats, target_entropy)
    raw = F.pow(F.col("tokens") / F.lit(whole["top"] or 1), F.lit(a))
    norm = per_source.agg(F.sum(raw).alias("s")).first()["s"] or 1.0
    weight = raw / F.lit(norm)
    return per_source.select("source", "tokens", weight.alias("weight"), F.floor(weight * F.lit(budget)).cast("long").alias("quota"), F.greatest(F.lit(1).cast("long"), F.ceil(F.col("tokens") / F.lit(block_tokens)).cast("long")).alias("blocks"))


def drawn(docs: DataFrame, seed: int = 0, **how) -> DataFrame:
    """(row, source, weight, epoch): one row per draw. A source's draws end with the document that crosses its quota."""
    counts = keep(counted(docs), "counts")
    plan = keep(quotas(counts, **how), "quotas")
    blocks = _placed(counts, plan, seed).where("over > 0").groupBy("source", "block", "at", "over").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("source").orderBy("at", "block").rowsBetween(Window.unboundedPreceding, -1)
    crossed = blocks.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0))).where("before < over and before + n >= over")
    cuts = keep(crossed.select(F.col("source").alias("src2"), F.col("at").alias("cut_at"), F.col("block").alias("cut_block"), (F.col("over") - F.col("before")).alias("room")), "cuts")
    drop_kept(counts)
    rows = docs.select(F.struct("*").alias("row"), F.col("source").cast("string").alias("src"), text_of().alias("txt"), F.col("doc_id").alias("id"))
    rows = _placed(rows.withColumn("fine", F.xxhash64("id", "txt")), plan, seed).join(_hint(cuts), F.col("source").eqNullSafe(F.col("src2")), "left")
    place = F.struct("at", "block")
    rows = rows.withColumn("side", F.when(F.col("cut_at").isNull(), 1).when(place < F.struct(F.col("cut_at").alias("at"), F.col("cut_block").alias("block")), -1).when((F.col("at") == F.col("cut_at")) & (F.col("block") == F.col("cut_block")), 0).otherwise(1))
    whole = rows.where("side <> 0").withColumn("times", F.when(F.col("tokens").isNull(), 1).otherwise(F.col("full") + F.when(F.col("side") < 0, 1).otherwise(0)))
    # one block per source is cut, by a running sum within it
    w = Window.partitionBy("source", "block").orderBy(_draw(F.col("fine"), F.col("full"), seed=seed + 2), "id").rowsBetween(Window.unboundedPreceding, -1)
    some = rows.where("side = 0").withColumn("ahead", F.coalesce(F.sum(F.size(words_of(F.col("txt")))).over(w), F.lit(0)))
    some = some.withColumn("times", F.col("full") + F.when(F.col("ahead") < F.col("room"), 1).otherwise(0)).drop("ahead")
    out = whole.select("row", "src", "weight", "times").unionByName(some.select("row", "src", "weight", "times")).where("times > 0")
    return out.select("row", F.col("src").alias("source"), "weight", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times").cast("long"))).alias("epoch"))


#: A table with one row per source is broadcast up to so many rows; past that Spark chooses, with its skew handling.
MAX_BROADCAST_SOURCES = 100_000


def _hint(per_source: DataFrame) -> DataFrame:
    return F.broadcast(per_source) if per_source.count() <= MAX_BROADCAST_SOURCES else per_source


def _with_sources(rows: DataFrame, plan: DataFrame) -> DataFrame:
    return rows.join(_hint(plan), F.col("src").eqNullSafe(F.col("source")), "left")


def _placed(rows: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """Rows (src, fine) with their source's plan, block and its place. Full epochs need no order; the last takes blocks in a drawn order up to what is left of the quota."""
    rows = _with_sources(rows, plan).withColumn("block", F.pmod(_draw(F.col("fine"), seed=seed), F.col("blocks")))
    return rows.withColumn("full", F.expr("quota div tokens")).withColumn("over", F.col("quota") % F.col("tokens")).withColumn("at", _draw(F.col("source"), F.col("block"), F.col("full"), seed=seed + 1))


def apply(docs: DataFrame, **how) -> DataFrame:
    """The rows drawn, with the columns of ``docs``; rows drawn twice come twice."""
    return drawn(docs, **how).select("row.*")
