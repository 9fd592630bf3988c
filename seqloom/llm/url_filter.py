"""URL filters: rules first, then a character language-model ratio.

The URLs that a rule allows or blocks train two smoothed variable-order Markov models over
characters; a URL without a rule is judged by the difference of its log-likelihoods per character
against a threshold calibrated on rule-judged URLs held out from training.

Counts are exact and live in a table, however many runs of characters there are. What a character
adds to the difference depends on the last ORDER characters only, so it is worked out once for each
distinct window and joined to the URLs' windows.

Defined cases: a null url, or one without ``://``, has an empty host and path and no rule; it is
judged on the end mark alone; repeated urls and ties get equal verdicts, null page_ids stay; very long
urls are judged whole; without training URLs both models are uniform and everything is allowed; an
empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keep, salted

#: (host, path, verdict): fixed values of the query's contract.
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
ORDER = 5
#: Weight of the next shorter context, in characters seen.
PRIOR = 2.0
#: Characters that the shortest context takes as equally likely.
ALPHABET = 256
#: A fifth of the rule-judged URLs calibrates; the threshold lets so many of its allowed URLs fall below.
HELD_OUT, MISSED = 5, 0.02
#: Differences are held in whole millionths, so that sums don't depend on their order.
UNIT = 1_000_000
#: Values of windows are broadcast up to so many; more are joined by shuffle, with a common window dealt to many tasks.
MAX_BROADCAST_WINDOWS = 200_000
#: Width of the cells in which a quantile's place is found before its values are ordered.
CELL = 4096


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(host, capitals, capitals.lower()), F.lit("")), F.coalesce(path, F.lit(""))


def judged_by_rules(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, ruled: the longest rule that fits, else null."""
    host, path = split_url(F.col("url").cast("string"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule = verdict = None
    for h, p, v in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        fits = ((F.col("host") == h) | F.endswith("host", F.lit("." + h))) & F.startswith("path", F.lit(p))
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    return rows.withColumn("rule", rule).withColumn("ruled", verdict)


def marked() -> Column:
    """The characters that the models read: host and path, lower case, with an end mark."""
    return F.concat(F.lower(F.concat("host", "path")), F.lit("\n"))


def hashed(text: Column, digits: int) -> Column:
    """The first hex digits of the MD5: a hash that SQL engines share."""
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")


def windows(s: Column) -> Column:
    """For each place in ``s`` the last ORDER characters that end there, or as many as there are."""
    return F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.substring(s, F.greatest(i - (ORDER - 1), F.lit(1)), F.least(i, F.lit(ORDER))))


def counts(rows: DataFrame) -> DataFrame:
    """(run, allow, block): how often each run of 1 to ORDER characters occurs in each class; the empty run has all characters. ``rows``: ruled and s.

    Windows are counted first, with map-side combining; their suffixes are the runs.
    """
    n = lambda v: F.sum(F.when(F.col("ruled") == v, F.lit(1)).otherwise(F.lit(0))).alias(v)
    seen = rows.select("ruled", F.explode(windows(F.col("s"))).alias("w")).groupBy("w").agg(n("allow"), n("block"))
    runs = F.transform(F.sequence(F.lit(0), F.length("w")), lambda k: F.substring(F.col("w"), F.length("w") - k + 1, k))
    return seen.select(F.explode(runs).alias("run"), "allow", "block").groupBy("run").agg(F.sum("allow").alias("allow"), F.sum("block").alias("block"))


def values(seen: DataFrame, model: DataFrame) -> DataFrame:
    """(w, value): what the last character of each window adds to the log-likelihood under allow less that under block, in whole UNITs.

    A run's probability is its count and PRIOR times that of the next shorter run, over its context's
    count and PRIOR; the context of a run is the run without its last character.
    """
    w = F.col("w")
    lengths = F.sequence(F.lit(1), F.length(w))
    asked = F.flatten(F.transform(lengths, lambda k: F.array(
        F.struct(k.alias("k"), F.lit(True).alias("own"), F.substring(w, F.length(w) - k + 1, k).alias("run")),
        F.struct(k.alias("k"), F.lit(False).alias("own"), F.substring(w, F.length(w) - k + 1, k - 1).alias("run")))))
    found = salted(seen.select("w", F.inline(asked)), model, ["run"], "left", F.col("w"))
    # at most ORDER entries for each window and kind
    n = lambda v, own: F.transform(F.array_sort(F.collect_list(F.when(F.col("own") == own, F.struct("k", F.coalesce(v, F.lit(0)).alias("n"))))), lambda x: x["n"])
    told = found.groupBy("w").agg(*[n(v, own).alias(f"{v}_{kind}") for v in ("allow", "block") for kind, own in (("runs", True), ("contexts", False))])

    def log(v: str) -> Column:
        step = lambda p, x: (x["n"] + PRIOR * p) / (x["m"] + PRIOR)
        pairs = F.arrays_zip(F.col(f"{v}_runs").alias("n"), F.col(f"{v}_contexts").alias("m"))
        return F.ln(F.aggregate(pairs, F.lit(1.0 / ALPHABET), step))

    return told.select("w", F.round(UNIT * (log("allow") - log("block"))).cast("long").alias("value"))


def difference(rows: DataFrame, model: DataFrame) -> DataFrame:
    """(id, difference): log-likelihood under allow less that under block, per character of s, in UNITs. ``rows``: a written table with a unique id and s."""
    each = rows.select("id", F.explode(windows(F.col("s"))).alias("w"))
    told = keep(values(each.select("w").distinct(), model), "url-values")
    found = each.join(F.broadcast(told), "w") if told.count() <= MAX_BROADCAST_WINDOWS else salted(each, told, ["w"], "inner", F.col("id"))
    return found.groupBy("id").agg((F.sum("value") / F.count(F.lit(1))).alias("difference"))


def low_quantile(scores: DataFrame, q: float) -> float | None:
    """The least value of column ``v`` (whole numbers) that the share ``q`` of rows doesn't exceed; None without rows.

    Values are counted; the cell that holds the place is found first, so that no task orders more than CELL values.
    """
    each = keep(scores.groupBy("v").agg(F.count(F.lit(1)).alias("n")).withColumn("cell", F.floor(F.col("v") / CELL)), "calibration")
    upto = lambda by: F.sum("n").over(Window.orderBy(by))
    by_cell = each.groupBy("cell").agg(F.sum("n").alias("n")).withColumn("end", upto("cell")).withColumn("all", F.sum("n").over(Window.partitionBy()))
    place = by_cell.where(F.col("end") >= q * F.col("all")).orderBy("cell").select("cell", (F.col("end") - F.col("n")).alias("before"), "all").first()
    if place is None:
        return None
    inside = each.where(F.col("cell") == place["cell"]).withColumn("end", upto("v"))
    return float(inside.where(F.col("end") + place["before"] >= q * place["all"]).orderBy("v").first()["v"])


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and score (log-likelihood difference per character, null where a rule judges)."""
    rows = judged_by_rules(pages, rules).withColumn("s", marked())
    fold = hashed(F.concat("s", F.lit("fold")), 8) % HELD_OUT
    model = keep(counts(rows.where("ruled is not null").where(fold != 0)), "url-model")
    # what has to be scored, under ids that stay: the URLs without a rule and the allowed ones that calibrate
    todo = keep(rows.where(F.col("ruled").isNull() | ((fold == 0) & (F.col("ruled") == "allow"))).withColumn("id", F.monotonically_increasing_id()), "urls")
    scored = keep(difference(todo, model), "url-scores")
    calibration = todo.where("ruled is not null").select("id").join(scored, "id").select(F.round("difference").alias("v"))
    low = low_quantile(calibration, MISSED)
    free = todo.where("ruled is null").join(scored, "id").withColumn("score", F.col("difference") / UNIT)
    verdict = F.when(F.col("score") >= (low or 0.0) / UNIT, "allow").otherwise("block")
    told = free.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")
    return told.unionByName(rows.where("ruled is not null").select("page_id", "host", "path", "rule", F.col("ruled").alias("verdict"), F.lit(None).cast("double").alias("score")))
