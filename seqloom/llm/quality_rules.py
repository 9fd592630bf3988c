"""Quality rules as a short-circuit cascade.

A sample tells each rule's cost (seconds) and selectivity (share rejected); the rules then run in
the order of rejection per cost and stop at the first that rejects. The order changes only the
work, never the verdict: a row is rejected if any rule rejects it.

Defined cases: null and empty texts have no words and are rejected as too short; every row is
judged by itself, whatever its other columns, so repeated rows and ties get equal verdicts and null
doc_ids stay; a very long text is judged whole (only the timing sample leaves those of over
SAMPLE_BYTES out); an empty table gives no rows; columns of clashing names are left alone.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, let, text_of, words_of

WINDOW = 8
#: Rows, and bytes of each at most, on which costs and selectivities are estimated; they only set the order.
SAMPLE_ROWS, SAMPLE_BYTES = 300, 1 << 18
SYMBOLS_RE = "[#*$%&|<>]"
CAPITALS_RE = "[A-ZÀ-ÖØ-Þ]"


def window_hashes(words: Column) -> Column:
    """A hash of each window of 8 words: of neighbouring words first, then of neighbouring pairs, then of fours, so that no word is hashed more than once. The array must have 8 words."""
    def joined(hashes: Column, step: int) -> Column:
        return let(hashes, lambda a: F.transform(F.slice(a, F.lit(1), F.size(a) - step), lambda x, i: F.xxhash64(x, F.get(a, i + step))))

    return joined(joined(joined(F.transform(words, lambda x: F.xxhash64(x)), 1), 2), 4)


def n_repeat_words(words: Column) -> Column:
    """Words that lie in a window of 8 words met twice or more in the text."""
    def places(hashes: Column) -> Column:
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return let(pairs, lambda s: F.array_sort(F.transform(F.filter(F.transform(s, lambda x, j: F.struct(
            x["i"].alias("i"),
            (((j > 0) & (F.get(s, j - 1)["h"] == x["h"])) | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False))).alias("twice"))),
            lambda y: y["twice"]), lambda y: y["i"])))

    def covered(starts: Column) -> Column:
        zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
        return F.aggregate(starts, zero, lambda a, i: F.struct((a["n"] + i + WINDOW - F.greatest(a["end"], i)).cast("long").alias("n"), (i + WINDOW).alias("end")), lambda a: a["n"])

    none = F.lit(0).cast("long")
    return let(words, lambda w: F.when(F.size(w) <= WINDOW, none).otherwise(let(
        window_hashes(w),
        lambda hs: F.when(F.size(F.array_distinct(hs)) == F.size(hs), none).otherwise(covered(places(hs))))))


def lines_of(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")


#: The figures the rules use, from a text and its words.
FIGURES: dict[str, Callable[[Column, Column], Column]] = {
    "n_words": lambda t, w: F.size(w).cast("long"),
    "word_chars": lambda t, w: F.length(F.array_join(w, "")).cast("long"),
    "n_symbols": lambda t, w: F.regexp_count(t, F.lit(SYMBOLS_RE)).cast("long"),
    "n_dup_lines": lambda t, w: let(lines_of(t), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
    "n_lines": lambda t, w: F.size(lines_of(t)).cast("long"),
    "n_capitals": lambda t, w: F.regexp_count(t, F.lit(CAPITALS_RE)).cast("long"),
    "n_echo_words": lambda t, w: F.size(F.filter(F.sequence(F.lit(1), F.size(w)), lambda i: F.get(w, i) == F.get(w, i - 1))).cast("long"),
    "n_repeat_words": lambda t, w: n_repeat_words(w),
}

#: Each rule: the figures it needs and when it rejects. The first two are the base rules.
RULES: dict[str, tuple[tuple[str, ...], Callable]] = {
    "short": (("n_words",), lambda v: v["n_words"] < 20),
    "repeats": (("n_words", "n_repeat_words"), lambda v: 100 * v["n_repeat_words"] > 30 * v["n_words"]),
    "symbols": (("n_words", "n_symbols"), lambda v: 100 * v["n_symbols"] > 30 * v["n_words"]),
    "word_length": (("n_words", "word_chars"), lambda v: (v["word_chars"] > 15 * v["n_words"]) | (v["word_chars"] < 2 * v["n_words"])),
    "same_lines": (("n_dup_lines", "n_lines"), lambda v: (v["n_dup_lines"] >= 3) & (100 * v["n_dup_lines"] > 30 * v["n_lines"])),
    "echoes": (("n_words", "n_echo_words"), lambda v: 100 * v["n_echo_words"] > 30 * v["n_words"]),
    "capitals": (("word_chars", "n_capitals"), lambda v: 100 * v["n_capitals"] > 30 * v["word_chars"]),
}
BASE = ("short", "repeats")

#: What the report tells of every row; its cascade takes these as known and works the other figures out only where a rule is reached.
TOLD = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: How often the sample is repeated in a timed job, so that its start weighs less; the time of a job without rules is taken off as well.
REPEATS = 4


def _prepared(docs: DataFrame) -> DataFrame:
    return docs.select(F.struct("*").alias("row"), text_of().alias("txt")).withColumn("words", words_of(F.col("txt")))


def _rejects(rule: str, words: Column, known: tuple[str, ...] = ()) -> Column:
    """The rule as one expression over txt, ``words`` and the columns ``known``."""
    needs, when = RULES[rule]
    fresh = {n: FIGURES[n](F.col("txt"), words) for n in needs if n not in known}
    if known:  # what is left is used once by its rule, and not at all where the rule is decided without it
        return when({n: F.col(n) for n in needs if n in known} | fresh)
    return let(F.struct(*[x.alias(n) for n, x in fresh.items()]), when)


def _timed(sample: DataFrame, hit: Column) -> tuple[float, int]:
    """Seconds of the quicker of two runs (the first also compiles), and the rows hit."""
    seconds = []
    for _ in range(2):
        began = time.monotonic()
        n = sample.agg(F.count_if(hit).alias("n")).first()["n"]
        seconds.append(time.monotonic() - began)
    return min(seconds), n


def plan(docs: DataFrame, rules: tuple[str, ...] = tuple(RULES), known: tuple[str, ...] = ()) -> list[tuple[str, float, float]]:
    """(rule, cost in seconds, share rejected), by rejection per cost; ties and an empty sample keep the given order.

    The sample is the first SAMPLE_ROWS rows that come, so that nothing else is read for it: it sets the
    order only, and no verdict depends on the order. ``known``: figures that cost nothing more.
    """
    # taken by the driver, which stops at the first partitions that have enough: a limit would shuffle so many rows of every partition
    taken = docs.select(text_of().alias("txt")).where(F.octet_length("txt") <= SAMPLE_BYTES).take(SAMPLE_ROWS)
    sample = docs.sparkSession.createDataFrame(taken, "txt string").select("txt", F.explode(F.sequence(F.lit(1), F.lit(REPEATS)))).repartition(1)
    sample = sample.select("txt", words_of(F.col("txt")).alias("words"))
    sample = sample.select("*", *[FIGURES[n](F.col("txt"), F.col("words")).alias(n) for n in known]).persist()
    try:
        rows = sample.count()
        found = []
        if rows:
            idle, _ = _timed(sample, F.length("txt") < 0)
            for rule in rules:
                seconds, hit = _timed(sample, _rejects(rule, F.col("words"), known))
                found.append((rule, max(seconds - idle, 1e-6), hit / rows))
    finally:
        sample.unpersist()
    return sorted(found or [(r, 1.0, 0.0) for r in rules], key=lambda x: -x[2] / x[1])


def cascade(order: list[str], words: Column, known: tuple[str, ...] = ()) -> Column:
    """The name of the first rule in ``order`` that rejects, else null; later rules aren't evaluated."""
    out = None
    for rule in order:
        hit = _rejects(rule, words, known)
        out = F.when(hit, rule) if out is None else out.when(hit, rule)
    return out


def apply(docs: DataFrame, rules: tuple[str, ...] = tuple(RULES)) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with their columns."""
    order = [r for r, _, _ in plan(docs, rules)]
    # the words are parted once for all rules
    return _prepared(docs).where(let(F.col("words"), lambda w: cascade(order, w)).isNull()).select("row.*")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, the figures TOLD, base_failed and kept of each row.

    Rows that fail the base rules go no further; the others run through the cascade of the remaining
    rules, which works out what it needs beyond TOLD only at the rules that a row reaches.
    """
    order = [r for r, _, _ in plan(docs, tuple(r for r in RULES if r not in BASE), TOLD)]
    rows = docs.select("doc_id", text_of().alias("txt")).withColumn("words", words_of(F.col("txt")))
    rows = rows.select("doc_id", "txt", "words", *[FIGURES[n](F.col("txt"), F.col("words")).alias(n) for n in TOLD])
    rows = rows.withColumn("base_failed", cascade(list(BASE), F.col("words"), TOLD).isNotNull())
    return rows.withColumn("kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(cascade(order, F.col("words"), TOLD).isNull())).drop("txt", "words")
