"""Line dedup: hashes in ranges, sorted by document and position, streamed once, and bitmaps of what stays.

Each line's key (blanks stripped at both ends, A-Z in lower case) becomes a 128-bit hash. The rows
(hash, document, position) are dealt to ranges of (hash, document) and sorted by hash, document and
position, so a line that a third of all documents hold is cut over as many ranges as it needs. A
task streams its range: the first occurrence in each document counts, lines of a key met in enough
documents are told on as soon as it has been met in so many, and those of rarer keys are forgotten. Only
the first and last key of a range may go on elsewhere; their counts, two for each range, are added up
and sent back. What leaves the stage is, of each document that loses lines, a compressed bitmap.

Defined cases: null and empty texts are one empty line, whose key is too short to be dropped; a
document is one doc_id with one text, so rows that repeat both count once and lose the same lines,
and a null doc_id is like any other; the last line may be empty; a text whose lines all go becomes empty; a
very long text is split in the task that reads it; an empty table gives no rows; extra columns stay as
they are, whatever their names, in ``apply`` and are ignored elsewhere.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, ship

#: What is stripped from a line's ends.
BLANK = b" \t\n\x0b\x0c\r"
#: A key is dropped if so many documents hold it, unless it is shorter than so many code points.
MIN_DOCS, MIN_CHARS = 10, 1
#: Lines in a range; more lines make more ranges.
RANGE_LINES = 500_000
#: Rows of a batch that a task hands on.
BATCH = 50_000


def _with_key(docs: DataFrame) -> DataFrame:
    """docs with __id and __sum, which together name a document."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.withColumn("__id", F.col("doc_id").cast("long")).withColumn("__sum", F.xxhash64(text)).withColumn("__text", text.cast("binary"))


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """(high, low, id, sum, pos): a row for each line whose key is long enough."""
    import pyarrow as pa

    ship(docs.sparkSession)

    def run(batches):
        import xxhash

        def result(hashes, ids, sums, pos):
            both = np.frombuffer(b"".join(hashes), ">u8").astype(np.uint64).view(np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(ids, pa.int64()), pa.array(sums, pa.int64()), pa.array(pos, pa.int32())], ["high", "low", "id", "sum", "pos"])

        hashes, ids, sums, pos = [], [], [], []
        for batch in batches:
            for i, s, x in zip(batch["__id"].to_pylist(), batch["__sum"].to_pylist(), batch["__text"], strict=True):
                for at, line in enumerate(x.as_py().lower().split(b"\n")):  # of bytes only A-Z have a lower case
                    key = line.strip(BLANK)
                    if key and (min_chars <= 1 or len(key.decode("utf-8", "replace")) >= min_chars):
                        hashes.append(xxhash.xxh3_128_digest(key))
                        ids.append(i)
                        sums.append(s)
                        pos.append(at)
                        if len(ids) >= BATCH:
                            yield result(hashes, ids, sums, pos)
                            hashes, ids, sums, pos = [], [], [], []
        if ids:
            yield result(hashes, ids, sums, pos)

    return _with_key(docs).select("__id", "__sum", "__text").mapInArrow(run, "high long, low long, id long, sum long, pos int")


class _Stream:
    """Reads one range in order. ``push`` returns the rows that are told on: (at, n), where n is 0 for lines that
    go and -1 where the key may go on in another range."""

    def __init__(self, least: int):
        self.least = least
        self.first = None  # the first key of the range
        self.key = None  # the key that is being read
        self.docs = 0  # documents met with it
        self.doc = None  # the last of them
        self.held = []  # its lines, as long as it isn't known to go: those of fewer than ``least`` documents

    def push(self, key: np.ndarray, doc: np.ndarray, pos: np.ndarray):
        """key, doc: (n, 2) and (n, 3) arrays, sorted. Yields (doc, pos) of lines that go."""
        new_key = np.ones(len(key), bool)
        new_key[1:] = (key[1:] != key[:-1]).any(axis=1)
        new_key[0] = self.key is None or tuple(key[0]) != self.key
        new_doc = new_key.copy()
        new_doc[1:] |= (doc[1:] != doc[:-1]).any(axis=1)
        new_doc[0] |= self.doc is None or tuple(doc[0]) != self.doc
        if self.first is None:
            self.first = tuple(key[0])
        begin = np.flatnonzero(new_key)
        head = int(begin[0]) if len(begin) else len(key)  # rows that still belong to the key of before
        if head:
            yield from self._more(doc[:head], pos[:head], int(new_doc[:head].sum()))
        if not len(begin):
            self.doc = tuple(doc[-1])
            return
        edges = self.close()
        if edges is not None:
            yield edges
        last = int(begin[-1])
        docs = np.add.reduceat(new_doc[:last].astype(np.int64), begin[:-1]) if len(begin) > 1 else np.zeros(0, np.int64)
        inner = begin[:-1]
        if len(inner):
            size = np.diff(begin)
            gone = docs >= self.least
            if tuple(key[inner[0]]) == self.first:  # it may have begun in the range before
                n = int(size[0])
                at = int(inner[0])
                yield "edge", self.first, int(docs[0]), doc[at : at + n], pos[at : at + n]
                gone[0] = False
            rows = np.repeat(gone, size)
            yield "gone", doc[head:last][rows], pos[head:last][rows]
        self.key, self.docs, self.held = tuple(key[last]), 0, []
        yield from self._more(doc[last:], pos[last:], int(new_doc[last:].sum()))
        self.doc = tuple(doc[-1])

    def _more(self, doc, pos, fresh: int):
        """More lines of the key that is being read."""
        self.docs += fresh
        if self.docs < self.least:
            self.held.append((doc.copy(), pos.copy()))
            return
        for d, p in self.held:
            yield "gone", d, p
        self.held = []
        yield "gone", doc, pos

    def close(self, end: bool = False):
        """What is to be told of the key that was read last; only the first and the last of a range may go on elsewhere."""
        if self.key is None or not (end or self.key == self.first):
            return None
        d = np.concatenate([x for x, _ in self.held]) if self.held else np.zeros((0, 3), np.int64)
        p = np.concatenate([x for _, x in self.held]) if self.held else np.zeros(0, np.int32)
        return "edge", self.key, self.docs, d, p


def dropped(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """(id, sum, pos): the lines that go, each once."""
    import pyarrow as pa

    lines = keep(_lines(docs, min_chars), "lines")
    ranges = max(lines.sparkSession._jvm.org.apache.spark.sql.internal.SQLConf.get().numShufflePartitions(), -(-lines.count() // RANGE_LINES))
    names = ["high", "low", "docs", "id", "sum", "pos"]

    def run(batches):
        stream = _Stream(min_docs)

        def told(what):
            """Lines that go have no key; lines of a key at the border have it; so has a row without position that counts its documents."""
            if what[0] == "gone":
                _, doc, pos = what
                key, docs = None, None
            else:
                _, key, docs, doc, pos = what
                doc, pos = np.concatenate([doc, np.zeros((1, 3), np.int64)]), np.append(pos, -1)
            n = len(pos)
            column = lambda v, kind: pa.nulls(n, kind) if v is None else pa.array(np.full(n, v), kind)
            high, low = key or (None, None)
            counts = pa.nulls(n, pa.int64()) if docs is None else pa.array([None] * (n - 1) + [docs], pa.int64())
            ids = pa.array(doc[:, 1], pa.int64(), mask=doc[:, 0] == 1)
            return pa.RecordBatch.from_arrays([column(high, pa.int64()), column(low, pa.int64()), counts, ids, pa.array(doc[:, 2], pa.int64()), pa.array(pos, pa.int32())], names)

        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch["high"].to_numpy(), batch["low"].to_numpy()], axis=1)
            missing = batch["id"].is_null().to_numpy(zero_copy_only=False)
            doc = np.stack([missing.astype(np.int64), batch["id"].fill_null(0).to_numpy(), batch["sum"].to_numpy()], axis=1)
            for what in stream.push(key, doc, batch["pos"].to_numpy()):
                if what[0] == "edge" or len(what[1]):
                    yield told(what)
        last = stream.close(end=True)
        if last is not None:
            yield told(last)

    ordered = lines.repartitionByRange(ranges, "high", "low", "id", "sum").sortWithinPartitions("high", "low", "id", "sum", "pos")
    found = keep(ordered.mapInArrow(run, "high long, low long, docs long, id long, sum long, pos int"), "found")
    gone = found.where("high IS NULL").select("id", "sum", "pos")
    # two rows for each range at most, so few that they are broadcast
    border = found.where("high IS NOT NULL AND pos = -1").groupBy("high", "low").agg(F.sum("docs").alias("n")).where(F.col("n") >= min_docs).select("high", "low")
    late = found.where("high IS NOT NULL AND pos >= 0").join(F.broadcast(border), ["high", "low"], "left_semi").select("id", "sum", "pos")
    return gone.unionByName(late)


def packed(n_lines: int, gone: np.ndarray) -> bytes:
    """The compressed bitmap of a text's lines: bit i, from the highest of each byte, is set if line i stays."""
    bits = np.ones(n_lines, np.uint8)
    bits[gone] = 0
    return zlib.compress(np.packbits(bits).tobytes(), 6)


def unpacked(bitmap: bytes, n_lines: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8))[:n_lines].astype(bool)


def bitmaps(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """(id, sum, n_dropped, last, keep) of each document that loses lines; ``keep`` covers the lines up to ``last``, the last that goes; those after it stay."""
    import pyarrow as pa

    lost = dropped(docs, min_docs, min_chars).groupBy("id", "sum").agg(F.collect_set("pos").alias("gone"))  # at most a document's lines

    def run(batches):
        for batch in batches:
            gone = [np.array(x.as_py()) for x in batch["gone"]]
            last = [int(g.max()) for g in gone]
            yield pa.RecordBatch.from_arrays([batch["id"], batch["sum"], pa.array(map(len, gone), pa.int64()), pa.array(last, pa.int64()), pa.array([packed(n + 1, g) for n, g in zip(last, gone, strict=True)], pa.binary())], ["id", "sum", "n_dropped", "last", "keep"])

    return lost.mapInArrow(run, "id long, sum long, n_dropped long, last long, keep binary")


def kept_lines(raw: bytes, bitmap: bytes | None, last: int | None) -> tuple[int, bytes]:
    """How many lines a text has, and the text of those that stay."""
    lines = raw.split(b"\n")
    if bitmap is None:
        return len(lines), raw
    stays = unpacked(bitmap, last + 1)
    return len(lines), b"\n".join([x for x, s in zip(lines, stays.tolist(), strict=False) if s] + lines[last + 1 :])


def _joined(docs: DataFrame, of: DataFrame) -> DataFrame:
    maps = of.withColumnsRenamed({"id": "__own", "sum": "__s", "n_dropped": "__n", "last": "__last", "keep": "__keep"})
    rows = _with_key(docs)
    return rows.join(maps, F.col("__id").eqNullSafe(F.col("__own")) & (F.col("__sum") == F.col("__s")), "left")


def label(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_sha256 of each row."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            said = [kept_lines(x.as_py(), k.as_py(), n.as_py()) for x, k, n in zip(batch["__text"], batch["__keep"], batch["__last"], strict=True)]
            yield pa.RecordBatch.from_arrays([batch["__id"], pa.array([n for n, _ in said], pa.int64()), batch["__n"].fill_null(0), pa.array([hashlib.sha256(t).hexdigest() for _, t in said])], ["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    joined = _joined(docs.select("doc_id", "text"), bitmaps(docs, min_docs, min_chars)).select("__id", "__text", "__n", "__last", "__keep")
    return joined.mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def apply(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with the dropped lines gone from text; all columns stay. Texts that lose nothing, null ones too, are left alone."""
    lines = F.split(F.col("text"), "\n", -1)
    gone = dropped(docs, min_docs, min_chars).groupBy("id", "sum").agg(F.collect_set("pos").alias("__gone")).withColumnsRenamed({"id": "__own", "sum": "__s"})
    rows = _with_key(docs).drop("__text")
    stays = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__gone"))
    text = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(stays, lambda i: lines[i]), "\n"))
    return rows.join(gone, F.col("__id").eqNullSafe(F.col("__own")) & (F.col("__sum") == F.col("__s")), "left").withColumn("text", text).select(*[F.col(f"`{c}`") for c in docs.columns])
