"""Quality classifier: interpolated modified Kneser-Ney over bytes, thresholds by language.

A model of order ORDER is trained on trusted text (rows labelled quality 1). Counts of byte runs are
tables; continuation counts, discounts and back-off weights come from group-bys and joins of those
tables, sharded by run. Every run and every context of a look-up share the byte before the last one,
so the model is cut by that byte into shards, which tasks write as files of sorted runs into the
shared folder. A document's perplexity comes from joining the distinct runs of its text with those
files, which each task maps into memory: a join that moves neither documents nor the model, since the
runs of all texts would be some twenty times the texts.
Of the trusted rows one half, by a hash of the id, trains; the other half, which the model hasn't seen, sets
the quantiles, so every trusted row
counts. A document is rejected if its perplexity is above the quantile of its language by more than its
length allows.

Defined cases: null text counts as empty and has only the end mark; null or rare languages take the
quantile over all; repeated rows and ties get equal results, null doc_ids stay; very long texts are
read whole; without trusted rows the model is uniform and everything is kept; an empty table gives no
rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bloom_of, bloom_words, in_bloom, keep, shared_dir, ship, text_of

ORDER = 5
#: None: all trusted rows take part, one half trains. A caller who wants a smaller model can set a number; then half of about so many rows train, and all others set the quantiles.
MAX_TRUSTED_ROWS: int | None = None
QUANTILE = 0.995
#: A short text's mean scatters more: so many bits over the root of its bytes are let pass above the quantile.
ALLOWANCE = 4.0
#: A language has its own quantile from so many trusted rows on.
LEAST_ROWS = 30
#: Cells of a bit in the histogram that finds a quantile's place; the quantile itself is exact.
CELLS = 1 << 14
SHARD_ROWS = 4_000_000
#: Bytes that don't occur in text: before the first and after the last.
START, END = 0, 1
CHUNK = 1 << 20


def runs(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the ORDER bytes that end at each byte of each text, the end mark included, and where each text's begin."""
    pad = bytes([START]) * (ORDER - 1)
    raw = np.frombuffer(b"".join(pad + t.replace(b"\0", b" ").replace(b"\1", b" ") + bytes([END]) for t in texts), np.uint8).astype(np.uint64)
    code = np.zeros(len(raw) - ORDER + 1, np.uint64)
    for k in range(ORDER):
        code = (code << np.uint64(8)) | raw[k : len(raw) - ORDER + 1 + k]
    lengths = np.array([len(t) + 1 for t in texts])
    starts = np.concatenate(([0], np.cumsum(lengths + ORDER - 1)))[:-1]
    at = np.arange(lengths.sum()) + np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)))[:-1], lengths)
    return code[at], np.concatenate(([0], np.cumsum(lengths)))


def _pieces(text: bytes) -> list[bytes]:
    return [text[i : i + CHUNK] for i in range(0, max(len(text), 1), CHUNK)]


def count_runs(trusted: DataFrame) -> DataFrame:
    """(code, n) over column txt."""
    ship(trusted.sparkSession)

    def run(batches):
        import pyarrow as pa

        from .textnum import batches as parts
        from .textnum import column_bytes

        for batch in batches:
            texts = column_bytes(batch["txt"])
            for a, b in parts(texts):
                code, n = np.unique(runs(texts[a:b])[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(code.astype(np.int64)), pa.array(n)], ["code", "n"])

    return trusted.select("txt").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def estimate(top: DataFrame) -> DataFrame:
    """(k, code, logp, backoff): natural logs of P(last byte | bytes before) and of the weight of a context of k bytes, either may be null.

    ``top``: counts of the longest runs. Lower orders count the distinct bytes before a run.
    """
    tables = {ORDER: top}
    for k in range(ORDER - 1, 0, -1):
        tables[k] = keep(tables[k + 1].groupBy(F.expr(f"code & {256**k - 1}L").alias("code")).agg(F.count(F.lit(1)).alias("n")), f"runs{k}")
    lower, out = None, []
    for k in range(1, ORDER + 1):
        t = tables[k]
        seen = {r["n"]: r["m"] for r in t.where("n <= 4").groupBy("n").agg(F.count(F.lit(1)).alias("m")).collect()}
        n1, n2, n3, n4 = (max(seen.get(i, 0), 1) for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2)
        cut = [min(max(d, 0.05), i - 0.05) for i, d in enumerate((1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3), 1)]
        discount = F.when(F.col("n") == 1, cut[0]).when(F.col("n") == 2, cut[1]).otherwise(cut[2])
        t = t.withColumn("context", F.expr("code div 256"))
        contexts = t.groupBy("context").agg(F.sum("n").alias("total"), F.sum(discount).alias("freed"))
        rows = t.join(contexts, "context").withColumn("own", (F.col("n") - discount) / F.col("total")).withColumn("weight", F.col("freed") / F.col("total"))
        if lower is None:
            rows = rows.withColumn("p", F.col("own") + F.col("weight") / 256)
        else:
            rows = rows.withColumn("suffix", F.expr(f"code & {256 ** (k - 1) - 1}L")).join(lower.select(F.col("code").alias("suffix"), F.col("p").alias("q")), "suffix").withColumn("p", F.col("own") + F.col("weight") * F.col("q"))
        lower = keep(rows.select("code", "p"), f"p{k}")
        out.append(lower.select(F.lit(k).alias("k"), "code", F.ln("p").alias("logp"), F.lit(None).cast("double").alias("backoff")))
        out.append(contexts.select(F.lit(k - 1).alias("k"), F.col("context").alias("code"), F.lit(None).cast("double").alias("logp"), F.ln(F.col("freed") / F.col("total")).alias("backoff")))
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more)
    return whole.groupBy("k", "code").agg(F.max("logp").alias("logp"), F.max("backoff").alias("backoff"))


class Shard:
    """A part of the model: a file of sorted arrays by order, mapped when first asked. ``before``: the bytes before the last that it answers for, None for all."""

    def __init__(self, uri: str | None, before: set[int] | None):
        self.uri = uri
        self.before = None if before is None else np.isin(np.arange(256), list(before))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("runs", "contexts")}

    def _open(self) -> None:
        import pyarrow as pa
        import pyarrow.fs as fs

        none = (np.zeros(0, np.uint64), np.zeros(0))
        tables = [none] * (2 * ORDER + 2)
        if self.uri is not None:
            files, path = fs.FileSystem.from_uri(self.uri)
            source = pa.memory_map(path) if isinstance(files, fs.LocalFileSystem) else pa.BufferReader(files.open_input_file(path).read())
            reader = pa.ipc.open_file(source)
            tables = [tuple(c.to_numpy() for c in reader.get_batch(i).columns) for i in range(reader.num_record_batches)]
        self.runs, self.contexts = dict(enumerate(tables[: ORDER + 1])), dict(enumerate(tables[ORDER + 1 :]))

    @staticmethod
    def _find(table: tuple[np.ndarray, np.ndarray], codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys, values = table
        if not len(keys):
            return np.zeros(len(codes), bool), np.zeros(len(codes))
        at = np.minimum(np.searchsorted(keys, codes), len(keys) - 1)
        hit = keys[at] == codes
        return hit, np.where(hit, values[at], 0.0)

    def logp(self, codes: np.ndarray) -> np.ndarray:
        """Natural log of the probability of each code's last byte after the others; 0 for codes of other shards."""
        if not hasattr(self, "runs"):
            self._open()
        out = np.zeros(len(codes))
        todo = np.arange(len(codes))
        if self.before is not None:
            todo = todo[self.before[((codes >> np.uint64(8)) & np.uint64(255)).astype(int)]]
        for k in range(ORDER, 0, -1):
            mask = np.uint64(256**k - 1)
            hit, value = self._find(self.runs[k], codes[todo] & mask)
            out[todo[hit]] += value[hit]
            todo = todo[~hit]
            if not len(todo):
                return out
            out[todo] += self._find(self.contexts[k - 1], (codes[todo] & mask) >> np.uint64(8))[1]
        out[todo] -= np.log(256)
        return out


def _file(at: str):
    """A shard's rows (k, code, logp, backoff) to its file: for runs, then contexts, one batch of sorted codes and values for each order."""
    def write(table):
        import pyarrow as pa
        import pyarrow.fs as fs

        shard = table["shard"][0].as_py()
        k, code = table["k"].to_numpy(), table["code"].to_numpy().astype(np.uint64)
        files, path = fs.FileSystem.from_uri(f"{at}/{shard:05d}-{uuid.uuid4().hex[:8]}")  # each attempt writes a file of its own
        files.create_dir(path.rsplit("/", 1)[0], recursive=True)
        with files.open_output_stream(path) as out, pa.ipc.new_file(out, pa.schema([("code", pa.uint64()), ("value", pa.float64())])) as into:
            for name in ("logp", "backoff"):
                values = table[name].to_numpy()
                for order in range(ORDER + 1):
                    on = (k == order) & ~np.isnan(values)
                    by = np.argsort(code[on])
                    into.write_batch(pa.RecordBatch.from_arrays([pa.array(code[on][by]), pa.array(values[on][by])], ["code", "value"]))
        return pa.table({"shard": pa.array([shard], pa.int32()), "name": [path.rsplit("/", 1)[1]]})

    return write


def shards(model: DataFrame, most: int = SHARD_ROWS) -> list[Shard]:
    """The model cut by the byte before the last of a run (the last of a context) into files of at most ``most`` rows, or single bytes; tasks write them, the driver has their names."""
    spark = model.sparkSession
    ship(spark)
    last = F.when(F.col("logp").isNotNull() & (F.col("k") > 1), F.expr("(code div 256) & 255"))
    model = keep(model.withColumn("run_byte", last).withColumn("context_byte", F.when(F.col("backoff").isNotNull() & (F.col("k") > 0), F.expr("code & 255"))), "kn")
    n = model.count()
    if not n:
        return [Shard(None, None)]
    groups: list[set[int]] = [set()]
    if n > most:
        sizes = {b: 0 for b in range(256)}
        for column in ("run_byte", "context_byte"):
            for r in model.where(f"{column} is not null").groupBy(column).count().collect():  # 256 rows at most
                sizes[r[0]] += r["count"]
        full = 0
        for b, size in sizes.items():
            if groups[-1] and full + size > most:
                groups.append(set())
                full = 0
            groups[-1].add(b)
            full += size
    place = F.array(*[F.lit(next((g for g, bytes_ in enumerate(groups) if b in bytes_), 0)) for b in range(256)])
    of = lambda c: F.get(place, F.col(c).cast("int"))
    every = F.sequence(F.lit(0), F.lit(len(groups) - 1))
    own = F.when((F.col("k") <= 1) | F.lit(len(groups) == 1), every).otherwise(F.array_distinct(F.array_compact(F.array(of("run_byte"), of("context_byte")))))
    at = f"{shared_dir(spark)}/seqloom-kn-{uuid.uuid4().hex}"
    rows = model.select("k", "code", "logp", "backoff", F.explode(own).alias("shard")).repartition(len(groups), "shard")
    names = {r["shard"]: r["name"] for r in rows.groupBy("shard").applyInArrow(_file(at), "shard int, name string").collect()}
    return [Shard(f"{at}/{names[g]}" if g in names else None, None if len(groups) == 1 else bytes_) for g, bytes_ in enumerate(groups)]


def log_perplexity(docs: DataFrame, model: list[Shard]) -> DataFrame:
    """The columns of ``docs`` but txt, with bytes (end mark included) and bits: minus the log2 probability per byte.

    Each task joins the distinct runs of its texts to the shards' sorted runs, in one pass over the documents; rows aren't moved.
    """
    ship(docs.sparkSession)
    names = [c for c in docs.columns if c != "txt"]
    schema = docs.select(*names).schema.add("bytes", "long").add("nats", "double")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # names of files, not their content

    def run(batches):
        import pyarrow as pa

        from .textnum import batches as parts
        from .textnum import column_bytes, release

        for batch in batches:
            texts = column_bytes(batch["txt"])
            sums = []
            for a, b in parts(texts):
                code, starts = runs(texts[a:b])
                some, place = np.unique(code, return_inverse=True)
                sums.append(np.add.reduceat(sum(s.logp(some) for s in shared.value)[place], starts[:-1]))
            lengths = np.array([len(t) + 1 for t in texts], np.int64)
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), pa.array(lengths), pa.array(-np.concatenate(sums or [np.zeros(0)]))], [*names, "bytes", "nats"])
        release()

    return docs.mapInArrow(run, schema).withColumn("bits", F.col("nats") / F.col("bytes") / np.log(2)).drop("nats")


def quantiles(values: DataFrame, by: str, value: str, q: float) -> DataFrame:
    """(by, limit, n): the exact quantile of each group, interpolated between neighbours, and the group's rows.

    A histogram of CELLS cells to the unit finds the cells that hold the two neighbours; only their values are
    ordered, equal ones as one row, so no task sees a whole group.
    """
    cells = values.withColumn("cell", F.floor(F.col(value) * CELLS))
    histogram = keep(cells.groupBy(by, "cell").agg(F.count(F.lit(1)).alias("m")), "histogram")
    upto = Window.partitionBy(by).orderBy("cell")
    place = histogram.withColumn("end", F.sum("m").over(upto)).withColumn("n", F.sum("m").over(Window.partitionBy(by)))
    at = (F.col("n") - 1) * F.lit(q)
    low, high = F.floor(at), F.ceil(at)
    inside = lambda rank: (rank >= F.col("end") - F.col("m")) & (rank < F.col("end"))
    place = place.where(inside(low) | inside(high)).select(F.col(by).alias("b"), F.col("cell").alias("c"), (F.col("end") - F.col("m")).alias("start"), "n")
    near = cells.join(place, F.col(by).eqNullSafe(F.col("b")) & (F.col("cell") == F.col("c"))).groupBy(by, "c", "start", "n", value).agg(F.count(F.lit(1)).alias("m"))
    near = near.withColumn("end", F.col("start") + F.sum("m").over(Window.partitionBy(by, "c").orderBy(value)))
    ends = near.groupBy(by, "n").agg(F.max(F.when(inside(low), F.col(value))).alias("low"), F.max(F.when(inside(high), F.col(value))).alias("high"))
    return ends.select(by, (F.col("low") + (F.col("high") - F.col("low")) * (at - low)).alias("limit"), "n")


def trusted_rows(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose doc_id is among ``ids`` (id): a Bloom filter of the ids, broadcast, drops nearly all others before any text moves; the join decides."""
    words = bloom_words(ids.count())
    likely = in_bloom(rows, F.xxhash64("doc_id"), bloom_of(ids, F.xxhash64("id"), words), words).where("maybe").select(*rows.columns)
    return likely.join(ids, F.col("doc_id") == F.col("id"), "left_semi")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, lang, bytes, bits per byte, perplexity, limit (of bits) and kept of each row."""
    ship(docs.sparkSession)
    good = keep(labels.where("quality = 1").select(F.col("doc_id").alias("id")).distinct(), "good")
    draw = F.pmod(F.xxhash64("id", F.lit("trusted")), F.lit(1 << 20))
    trains = draw % 2 == 0
    if MAX_TRUSTED_ROWS is not None:
        trains &= draw < int(min(1.0, MAX_TRUSTED_ROWS / max(good.count(), 1)) * (1 << 20))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), text_of().alias("txt"))
    model = shards(estimate(keep(count_runs(trusted_rows(rows, good.where(trains))), "runs")))
    told = keep(log_perplexity(rows, model), "told")
    unseen = keep(told.join(good.where(~trains), F.col("doc_id") == F.col("id"), "left_semi").select("lang", "bits"), "calibration")
    every = quantiles(unseen.withColumn("all", F.lit(True)), "all", "bits", QUANTILE).first()
    by_lang = keep(quantiles(unseen.where("lang is not null"), "lang", "bits", QUANTILE).where(F.col("n") >= LEAST_ROWS).select(F.col("lang").alias("l"), F.col("limit")), "limits")
    told = told.join(by_lang, F.col("lang") == F.col("l"), "left").drop("l")
    told = told.withColumn("limit", F.coalesce("limit", F.lit(every and every["limit"]).cast("double")))
    return told.select("doc_id", "lang", "bytes", "bits", F.pow(F.lit(2.0), "bits").alias("perplexity"), "limit", F.coalesce(F.col("bits") <= F.col("limit") + ALLOWANCE / F.sqrt("bytes"), F.lit(True)).alias("kept"))
