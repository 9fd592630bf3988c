"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

Lexicons are the words whose document frequency in toxic labelled texts stands out. The features of
a text are lexicon densities, how close second-person words are, capitals, punctuation and
obfuscation. Lexicons and trees are learned from two thirds of a bounded sample of labelled training
rows, the calibration from the last third, which neither has seen. Labels, lang, source and doc_id are never features, and only rows
whose crc32(doc_id) mod 5 is not 0 are learned from. Every text is scored whole.

Defined cases: null text counts as empty and is scored as such; null doc_id counts as held out;
labels that are null are left out, contradicting ones count as toxic; repeated rows and ties get equal
scores; very long texts are scored whole, one at a time; without labels of both kinds every score is the share of toxic labels; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, text_of

#: About so many labelled rows are learned from, drawn by hash; more labels don't grow the fit.
MAX_FIT_ROWS = 20_000
#: Words in a lexicon at most, by significance.
MAX_LEXICON = 2_000
HELD_OUT, FOLDS = 5, 3
#: Second-person words, fixed values: English, German, French, Spanish.
SECOND_PERSON = "you your yours yourself du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos ti tus usted ustedes"
NEAR = 5
FEATURES = ("strong_per_100", "strong_log", "weak_per_100", "near_you_share", "you_per_100", "capitals_share", "caps_words_share", "exclamations_per_100", "punctuation_share", "obfuscated_per_100", "hidden_log", "runs_per_100", "words_log")
TREES, DEPTH, RATE, BINS, LEAST_WEIGHT = 60, 3, 0.15, 32, 2.0

_CODES = np.arange(256)
_UPPER = (_CODES >= 65) & (_CODES <= 90)
_LETTER = _UPPER | ((_CODES >= 97) & (_CODES <= 122)) | (_CODES >= 128)
_PUNCT = (_CODES > 32) & (_CODES < 127) & ~_LETTER & ~((_CODES >= 48) & (_CODES <= 57))
_LOWER = _CODES.astype(np.uint8)
_LOWER[65:91] += 32
#: Characters that stand for a letter inside a word.
_STANDS_FOR = _LOWER.copy()
for _a, _b in zip(b"013457@$!", b"oieastasi", strict=True):
    _STANDS_FOR[_a] = _b
_STANDS = np.isin(_CODES, list(b"013457@$!*#%&+"))


def _per_text(flags: np.ndarray, starts: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0], np.cumsum(flags)))
    return sums[starts[1:]] - sums[starts[:-1]]


def _spans(flag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.flatnonzero(np.diff(np.concatenate(([False], flag, [False]))))
    return edges[0::2], edges[1::2]


def word_hashes(words: list[str]) -> np.ndarray:
    from .textnum import hash_spans

    raw = [w.encode() for w in words]
    buf = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    ends = np.cumsum([len(r) + 1 for r in raw]) - 1
    return np.sort(hash_spans(buf, ends - np.array([len(r) for r in raw]), ends)) if raw else np.zeros(0, np.uint64)


def _among(hashes: np.ndarray, lexicon: np.ndarray) -> np.ndarray:
    if not len(lexicon):
        return np.zeros(len(hashes), bool)
    at = np.minimum(np.searchsorted(lexicon, hashes), len(lexicon) - 1)
    return lexicon[at] == hashes


def features(texts: list[bytes], strong: np.ndarray, weak: np.ndarray, second: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each text; the lexicons are sorted word hashes."""
    from .textnum import BLANK, hash_spans

    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    bounds = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
    letter = _LETTER[raw]
    starts, ends = _spans(letter)
    hashes = hash_spans(_LOWER[raw], starts, ends)
    of_text = np.searchsorted(starts, bounds)
    words = np.maximum(np.diff(of_text), 1)
    is_strong, is_weak, is_you = _among(hashes, strong), _among(hashes, weak), _among(hashes, second)
    n_strong, n_weak, n_you = (_per_text(x, of_text) for x in (is_strong, is_weak, is_you))
    # a lexicon word is near a second-person word if the running count of those differs within NEAR words around it, in its own text
    counts = np.concatenate(([0], np.cumsum(is_you)))
    text = np.repeat(np.arange(len(texts)), np.diff(of_text))
    at = np.arange(len(hashes))
    lo, hi = np.maximum(at - NEAR, of_text[text]), np.minimum(at + NEAR + 1, of_text[text + 1])
    n_near = _per_text(is_strong & (counts[hi] > counts[lo]), of_text)
    upper = _UPPER[raw]
    n_letters = np.maximum(_per_text(letter, bounds), 1)
    ups = np.concatenate(([0], np.cumsum(upper)))
    caps = (ups[ends] - ups[starts] == ends - starts) & (ends - starts > 1)
    inner = np.zeros(len(raw), bool)
    inner[1:-1] = _STANDS[raw[1:-1]] & letter[:-2] & letter[2:]
    # words with what stands for letters put back and other marks inside them dropped
    back = np.where(inner, _STANDS_FOR[raw], _LOWER[raw])
    keep = BLANK[raw] | letter | (inner & _LETTER[back])
    plain = back[keep]
    hs, he = _spans(~BLANK[plain])
    moved = np.concatenate(([0], np.cumsum(keep)))[bounds]
    hidden = _per_text(_among(hash_spans(plain, hs, he), strong), np.searchsorted(hs, moved))
    run = np.zeros(len(raw), bool)
    if len(raw) > 2:
        run[2:] = letter[2:] & (raw[2:] == raw[1:-1]) & (raw[1:-1] == raw[:-2])
    chars = np.maximum(np.diff(bounds) - 1, 1)
    return np.column_stack([
        100 * n_strong / words, np.log1p(n_strong), 100 * n_weak / words, n_near / np.maximum(n_strong, 1), 100 * n_you / words,
        _per_text(upper, bounds) / n_letters, _per_text(caps, of_text) / words, 100 * _per_text(raw == 33, bounds) / words,
        _per_text(_PUNCT[raw], bounds) / chars, 100 * _per_text(inner, bounds) / words, np.log1p(np.maximum(hidden - n_strong, 0)),
        100 * _per_text(run, bounds) / words, np.log1p(np.diff(of_text)),
    ])


class Trees:
    """Boosted regression trees for the logistic loss, on binned features."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        binned = self._binned(x)
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        total = np.full(len(y), self.base)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-total))
            tree, leaf = self._grow(binned, y - p, p * (1 - p))
            self.trees.append(tree)
            total += tree[2][leaf]

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(self.cuts)])

    def _grow(self, b: np.ndarray, grad: np.ndarray, hess: np.ndarray):
        """A full tree of DEPTH levels: feature and bin by inner node, value by leaf. A node that can't gain sends all to the left."""
        feature, cut = np.zeros((1 << DEPTH) - 1, int), np.full((1 << DEPTH) - 1, BINS + 1)
        node = np.zeros(len(b), int)
        for level in range(DEPTH):
            width, first = 1 << level, (1 << level) - 1
            best = np.full(width, 1e-6)
            for f in range(b.shape[1]):
                key = node * (BINS + 1) + b[:, f]
                g, h = (np.bincount(key, w, width * (BINS + 1)).reshape(width, -1).cumsum(1) for w in (grad, hess))
                gl, hl, gt, ht = g[:, :-1], h[:, :-1], g[:, -1:], h[:, -1:]
                gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
                gain[(hl < LEAST_WEIGHT / 4) | (ht - hl < LEAST_WEIGHT / 4)] = 0
                at = gain.argmax(1)
                up = gain[np.arange(width), at] > best
                best[up] = gain[np.arange(width), at][up]
                feature[first : first + width][up] = f
                cut[first : first + width][up] = at[up]
            node = 2 * node + (b[np.arange(len(b)), feature[first + node]] > cut[first + node])
        g, h = np.bincount(node, grad, 1 << DEPTH), np.bincount(node, hess, 1 << DEPTH)
        return (feature, cut, RATE * g / (h + 1)), node

    def margin(self, x: np.ndarray) -> np.ndarray:
        b = self._binned(x)
        rows = np.arange(len(b))
        total = np.full(len(b), self.base)
        for feature, cut, value in self.trees:
            node = np.zeros(len(b), int)
            for level in range(DEPTH):
                at = (1 << level) - 1 + node
                node = 2 * node + (b[rows, feature[at]] > cut[at])
            total += value[node]
        return total


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: the points of the least-squares rising fit of ``y`` over ``x``."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # mean, weight, first x, last x
    for a, b in zip(x[order], y[order], strict=True):
        blocks.append([b, 1.0, a, a])
        while len(blocks) > 1 and (blocks[-2][0] >= blocks[-1][0] or blocks[-2][3] == blocks[-1][2]):
            m, w, _, last = blocks.pop()
            top = blocks[-1]
            top[0] = (top[0] * top[1] + m * w) / (top[1] + w)
            top[1] += w
            top[3] = last
    return np.array([e for b in blocks for e in (b[2], b[3])]), np.array([b[0] for b in blocks for _ in range(2)])


class Model:
    def __init__(self, strong: np.ndarray, weak: np.ndarray, x: np.ndarray, y: np.ndarray, fold: np.ndarray):
        self.strong, self.weak, self.second = strong, weak, word_hashes(SECOND_PERSON.split())
        self.trees = None
        self.share = float(y.mean()) if len(y) else 0.0
        grow = fold != 0
        if all(0 < s.sum() < len(s) for s in (y[grow], y[~grow])):
            self.trees = Trees(x[grow], y[grow])
            self.points = isotonic(self.trees.margin(x[~grow]), y[~grow])

    def score(self, texts: list[bytes]) -> np.ndarray:
        """0 to 1 for each text; a small share of the uncalibrated score keeps the order within a calibrated step."""
        if self.trees is None:
            return np.full(len(texts), self.share)
        margin = self.trees.margin(features(texts, self.strong, self.weak, self.second))
        return 0.99 * np.interp(margin, *self.points) + 0.01 / (1 + np.exp(-margin))


def _crc(doc_id: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))


def lexicons(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes that mark toxic texts strongly and weakly. ``rows``: y and txt, a bounded sample."""
    totals = rows.agg(F.sum("y").alias("t"), F.count(F.lit(1)).alias("n")).first()
    toxic, clean = totals["t"] or 0, totals["n"] - (totals["t"] or 0)
    words = F.array_distinct(F.split(F.lower("txt"), r"[^a-z\x{80}-\x{10FFFF}]+"))
    seen = rows.select("y", F.explode(words).alias("w")).where("w <> ''").groupBy("w").agg(F.sum("y").alias("t"), F.sum(1 - F.col("y")).alias("c")).where(f"t >= {max(3, toxic // 200)}")
    odds = F.ln((F.col("t") + 0.5) / (toxic + 1) / ((F.col("c") + 0.5) / (clean + 1)))
    seen = seen.withColumn("odds", odds).withColumn("z", F.col("odds") / F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("c") + 0.5)))
    found = seen.where("z >= 3 and odds >= ln(3.0)").orderBy(F.desc("z"), "w").limit(MAX_LEXICON).collect()
    return word_hashes([r["w"] for r in found if r["odds"] >= np.log(8)]), word_hashes([r["w"] for r in found if r["odds"] < np.log(8)])


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn from labelled rows outside the held-out fifth."""
    known = labels.where("toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("y")).where(_crc() % HELD_OUT != 0)
    n = known.count()
    share = min(1.0, MAX_FIT_ROWS / max(n, 1))
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)) + (share == 1)).withColumnRenamed("doc_id", "id")
    fold = F.pmod(F.xxhash64("id", F.lit("fold")), F.lit(FOLDS)).cast("int")  # fold 0 calibrates
    rows = docs.select("doc_id", text_of().alias("txt")).join(F.broadcast(chosen.withColumn("fold", fold)), F.col("doc_id") == F.col("id")).select("doc_id", "fold", "y", "txt")
    ship(docs.sparkSession)
    rows = rows.persist()
    try:
        strong, weak = lexicons(rows.where("fold <> 0").select("y", "txt"))
        second = word_hashes(SECOND_PERSON.split())

        def run(batches):
            import pyarrow as pa

            from .textnum import batches as parts
            from .textnum import column_bytes

            for batch in batches:
                texts = column_bytes(batch["txt"])
                for a, b in parts(texts):
                    x = features(texts[a:b], strong, weak, second)
                    yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(a, b - a), batch["fold"].slice(a, b - a), batch["y"].slice(a, b - a), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "fold", "y", "x"])

        told = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "fold", "y", "txt").mapInArrow(run, "doc_id long, fold int, y int, x array<double>").orderBy("doc_id", "y", "x").toPandas()  # bounded by MAX_FIT_ROWS
    finally:
        rows.unpersist()
    x = np.array(told["x"].tolist(), float).reshape(len(told), len(FEATURES))
    return Model(strong, weak, x, told["y"].to_numpy(float), told["fold"].to_numpy(int))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of each row."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # lexicons and trees of bounded size

    def run(batches):
        import pyarrow as pa

        from .textnum import batches as parts
        from .textnum import column_bytes

        for batch in batches:
            texts = column_bytes(batch["txt"])
            scores = np.concatenate([shared.value.score(texts[a:b]) for a, b in parts(texts)] or [np.zeros(0)])
            scores = np.clip(scores, 0, 1)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (_crc() % HELD_OUT == 0).alias("held_out"), text_of().alias("txt"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
