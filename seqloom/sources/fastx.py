"""FASTA and FASTQ read in byte ranges: a large file is many tasks, and no file is ever one value.

Spark's text source cuts files into blocks and gives each task the lines of its blocks in order. A first
pass sums each block up without knowing where in a record it begins: for FASTQ, of each of the
four lines that it could begin with, which line follows its last and how many records begin (blank lines
between records don't count, so the sum isn't a division); for FASTA how many headers it has. Sums
chain along a file, so every block's first line and record number are known, whatever the
qualities look like. The second pass parses whole records; lines of records that a border cuts come
from the first pass, which keeps the few that can be, and meet by record number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import blocks, ship, spelled, written

FASTX = "file string, sequence_index long, read_id string, comment string, sequence string, qual array<short>"
#: Blocks whose sums are broadcast (some 100 bytes each); beyond that lines and sums are joined by a shuffle.
MAX_BROADCAST_BLOCKS = 100_000
#: Lines that are Python values at once.
_LINES = 512
#: Records, or bytes of sequence, after which a batch is handed on.
_ROWS, _BYTES = 10_000, 16 << 20

_SUMS = "file string, block long, n_lines long, ends array<int>, begun array<long>, line long, text string"
_STARTS = "file string, block long, state int, record long, end_state int, end_record long, n_lines long"


def kinds(spark: SparkSession, files: list[str]) -> dict[str, str]:
    """``@`` or ``>`` for each file, from its first bytes; ``.gz`` is unpacked. A blank file counts as FASTQ without records."""
    import zlib

    out = {}
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for file in files:
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(file))
        stream = path.getFileSystem(conf).open(path)
        try:
            raw = bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(jvm.org.apache.commons.io.input.BoundedInputStream(stream, 1 << 16)))
        finally:
            stream.close()
        if file.endswith(".gz"):
            raw = zlib.decompressobj(47).decompress(raw)
        mark = raw.lstrip()[:1].decode("latin-1")
        if mark and mark not in "@>":
            raise ValueError(f"{file}: neither FASTA nor FASTQ")
        out[spelled(file)] = mark or "@"
    return out


def _runs(batches) -> Iterator[tuple]:
    """(file, block, extra columns, lines) of each stretch of one block within a batch, of _LINES lines at most."""
    for batch in batches:
        if not batch.num_rows:
            continue
        n = batch.num_rows
        file, block = batch["file"], batch["block"].to_numpy()
        other = np.flatnonzero(block[1:] != block[:-1]) + 1
        if file[0].as_py() != file[n - 1].as_py():  # blocks of two files may begin at the same byte
            names = file.to_numpy(zero_copy_only=False)
            other = np.union1d(other, np.flatnonzero(names[1:] != names[:-1]) + 1)
        edges = sorted({*range(0, n, _LINES), *other.tolist(), n})
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            part = batch.slice(lo, hi - lo)
            yield part["file"][0].as_py(), int(block[lo]), part, part["value"].to_pylist()


class _Fastq:
    """Sums of one block: from each first line, 0 (header) to 3 (qualities), the line that follows and the records begun."""

    def __init__(self):
        self.n, self.ends, self.begun, self.head, self.tail = 0, [0, 1, 2, 3], [0, 0, 0, 0], [], []

    def add(self, lines: list[str]) -> None:
        blank = [k for k, x in enumerate(lines) if not x]
        for s in range(4):
            state, begun, at = self.ends[s], self.begun[s], 0
            for k in [*blank, len(lines)]:  # a stretch without blanks, then a blank line, which counts unless a header is due
                begun += (k - at + (state - 1) % 4) // 4 if k > at else 0
                state = (state + k - at) % 4
                if k < len(lines) and state:
                    state = (state + 1) % 4
                at = k + 1
            self.ends[s], self.begun[s] = state, begun
        self.head += [(self.n + k, x) for k, x in enumerate(lines[: max(0, 3 - self.n)])]
        self.tail = (self.tail + [(self.n + k, x) for k, x in enumerate(lines)][-3:])[-3:]
        self.n += len(lines)

    def rows(self) -> Iterator[tuple]:
        yield self.n, self.ends, self.begun, None, None
        for k, x in dict(self.head + self.tail).items():
            yield None, None, None, k, x


class _Fasta:
    """Headers of one block; the text before the first and, with its header, from the last one on."""

    def __init__(self):
        self.n, self.head, self.last, self.body = 0, [], None, []

    def add(self, lines: list[str]) -> None:
        for x in lines:
            if x[:1] == ">":
                self.n += 1
                self.last, self.body = x, []
            elif self.n:
                self.body.append(x)
            else:
                self.head.append(x)

    def rows(self) -> Iterator[tuple]:
        yield 0, [0], [self.n], None, None
        if self.head:
            yield None, None, None, 0, "".join(self.head)
        if self.last is not None:
            yield None, None, None, 1, self.last
            yield None, None, None, 2, "".join(self.body)


def _sums(lines: DataFrame, kind: dict[str, str]) -> DataFrame:
    """A row for each block, and rows of the lines at its borders."""
    import pyarrow as pa

    def run(batches):
        now, block = None, None
        types = [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.int64(), pa.string()]
        names = ["file", "block", "n_lines", "ends", "begun", "line", "text"]

        def told():
            rows = [(*now, *r) for r in block.rows()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        for file, at, _, values in _runs(batches):
            if (file, at) != now:
                if block is not None:
                    yield told()
                now, block = (file, at), _Fastq() if kind[file] == "@" else _Fasta()
            block.add(values)
        if block is not None:
            yield told()

    return lines.mapInArrow(run, _SUMS)


def _starts(sums: DataFrame) -> DataFrame:
    """Of each block the line of a record that it begins with and the records begun before it; a file's blocks, not its lines, meet in one task."""
    import pyarrow as pa

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        state, record, rows = 0, 0, []
        for file, block, n, ends, begun in zip(*(table[c].to_pylist() for c in ("file", "block", "n_lines", "ends", "begun")), strict=True):
            rows.append((file, block, state, record, ends[state], record + begun[state], n))
            state, record = ends[state], record + begun[state]
        types = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["file", "block", "state", "record", "end_state", "end_record", "n_lines"])

    return sums.where("ends IS NOT NULL").select("file", "block", "n_lines", "ends", "begun").groupBy("file").applyInArrow(run, _STARTS)


def _batch(rows: list[tuple], offset: int):
    """Record batch of (file, index, header, sequence, quality text or None)."""
    import pyarrow as pa

    file, index, head, seq, qual = zip(*rows, strict=True)
    names = [h[1:].partition(" ") for h in head]
    raw = [(q or "").encode("latin-1", "replace") for q in qual]
    values = np.frombuffer(b"".join(raw), np.uint8).astype(np.int16) - np.int16(offset)
    ends = np.concatenate(([0], np.cumsum([len(q) for q in raw]))).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(values), mask=pa.array([q is None for q in qual]))
    return pa.RecordBatch.from_arrays([pa.array(file), pa.array(index, pa.int64()), pa.array([n for n, _, _ in names]), pa.array([c or None for _, _, c in names], pa.string()), pa.array(seq, pa.string()), lists], ["file", "sequence_index", "read_id", "comment", "sequence", "qual"])


def _checked(record: list[str], n: int) -> tuple[str, str, str]:
    """Header, sequence and qualities of the lines of a FASTQ record; lines that are missing are empty."""
    head, seq, plus, qual = [*record, "", "", ""][:4]
    if head[:1] != "@" or plus[:1] != "+" or len(seq) != len(qual):
        raise ValueError(f"record {n}: not FASTQ")
    return head, seq, qual


def _whole(lines: DataFrame, starts: DataFrame, kind: dict[str, str], offset: int) -> DataFrame:
    """The records that lie within one block."""
    few = starts.count() <= MAX_BROADCAST_BLOCKS
    starts = starts.select("file", "block", "state", "record")
    if few:
        given = lines.join(F.broadcast(starts), ["file", "block"])
    else:
        given = lines.withColumn("row", F.monotonically_increasing_id()).join(starts, ["file", "block"]).sortWithinPartitions("file", "block", "row").drop("row")

    def run(batches):
        now, open_, skip, n = None, [], 0, 0  # open_: lines of the record that is being read
        rows, size = [], 0
        for file, at, part, values in _runs(batches):
            if (file, at) != now:
                now, n, open_ = (file, at), part["record"][0].as_py(), None
                skip = (4 - part["state"][0].as_py()) % 4
            if kind[file] == "@":
                if skip:
                    take = min(skip, len(values))
                    skip, values = skip - take, values[take:]
                for x in values:
                    if not open_:
                        if not x:
                            continue
                        n, open_ = n + 1, [x]
                        continue
                    open_.append(x)
                    if len(open_) == 4:
                        head, seq, qual = _checked(open_, n)
                        rows.append((file, n, head, seq, qual))
                        size, open_ = size + 2 * len(seq), None
                        if len(rows) >= _ROWS or size >= _BYTES:
                            yield _batch(rows, offset)
                            rows, size = [], 0
            else:
                for x in values:
                    if x[:1] == ">":
                        if open_:  # whole: a header of the same block came before and one follows
                            seq = "".join(open_[1:])
                            rows.append((file, n, open_[0], seq, None))
                            size += len(seq)
                            if len(rows) >= _ROWS or size >= _BYTES:
                                yield _batch(rows, offset)
                                rows, size = [], 0
                        n, open_ = n + 1, [x]
                    elif open_:
                        open_.append(x)
        if rows:
            yield _batch(rows, offset)

    return given.select("file", "block", "state", "record", "value").mapInArrow(run, FASTX)


def _cut(sums: DataFrame, starts: DataFrame, kind: dict[str, str], offset: int) -> DataFrame:
    """The records that borders cut, put together from their lines."""
    import pyarrow as pa

    fastq = F.col("file").isin([f for f, k in kind.items() if k == "@"])
    lines = sums.where("line IS NOT NULL").select("file", "block", "line", "text").join(starts, ["file", "block"])
    head = F.col("line") < (4 - F.col("state")) % 4
    tail = (F.col("line") >= F.col("n_lines") - F.col("end_state")) & ((F.col("state") == 0) | (F.col("state") + F.col("n_lines") > 4))
    of_fastq = lines.where(fastq).withColumn("record", F.when(head, F.col("record")).when(tail, F.col("end_record"))).where("record IS NOT NULL")
    of_fasta = lines.where(~fastq).withColumn("record", F.when(F.col("line") == 0, F.col("record")).otherwise(F.col("end_record")))
    pieces = of_fastq.select("file", "record", "block", "line", "text", F.lit(True).alias("fastq")).union(of_fasta.select("file", "record", "block", "line", "text", F.lit(False).alias("fastq")))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("block", "ascending"), ("line", "ascending")])
        text, n, file = table["text"].to_pylist(), table["record"][0].as_py(), table["file"][0].as_py()
        head, seq, qual = _checked(text, n) if table["fastq"][0].as_py() else (text[0], "".join(text[1:]), None)
        return pa.Table.from_batches([_batch([(file, n, head, seq, qual)], offset)])

    return pieces.groupBy("file", "record").applyInArrow(run, FASTX)


def fastx(spark: SparkSession, *paths: str, offset: int = 33, chained: bool = False) -> DataFrame:
    """FASTX columns, one row per record, numbered from 1 in each file. Files are read in byte ranges; a ``.gz`` file is one task, line by line.

    ``chained``: all files are one text in the order of their names, with one numbering; ``file`` is the first one.
    """
    ship(spark)
    lines, files = blocks(spark, list(paths), chained=chained)
    kind = kinds(spark, files)
    sums = written(_sums(lines, kind), "fastx")
    starts = written(_starts(sums), "starts")
    return _whole(lines, starts, kind, offset).unionByName(_cut(sums, starts, kind, offset))


def fastx_pair(spark: SparkSession, one: str, two: str | None = None, offset: int = 33) -> DataFrame:
    """sequence_index, read_id, comment, sequence1, qual1, sequence2, qual2; without a second file the mates are null.

    The n-th file of ``one`` by name goes with the n-th of ``two``, and records meet by number. Mates whose names differ (but for a
    last /1 and /2), and a record without mate, fail the job.
    """
    a = fastx(spark, one, offset=offset)
    if two is None:
        return a.select("sequence_index", "read_id", "comment", F.col("sequence").alias("sequence1"), F.col("qual").alias("qual1"), F.lit(None).cast("string").alias("sequence2"), F.lit(None).cast("array<short>").alias("qual2"))
    files = [sorted(map(spelled, spark.read.text(p).inputFiles())) for p in (one, two)]
    if len(files[0]) != len(files[1]):
        raise ValueError(f"{len(files[0])} files of first mates, {len(files[1])} of second ones")
    numbered = lambda df, names: df.withColumn("file", F.array_position(F.array(*map(F.lit, names)), F.col("file")))
    bare = lambda c: F.regexp_replace(c, "/[12]$", "")
    b = numbered(fastx(spark, two, offset=offset), files[1]).select("file", "sequence_index", F.col("read_id").alias("mate"), F.col("sequence").alias("sequence2"), F.col("qual").alias("qual2"))
    both = numbered(a, files[0]).withColumnsRenamed({"sequence": "sequence1", "qual": "qual1"}).join(b, ["file", "sequence_index"], "full")
    alike = bare("read_id").eqNullSafe(bare("mate"))
    said = F.raise_error(F.format_string("record %d: mates %s and %s", "sequence_index", "read_id", "mate"))
    return both.select("sequence_index", F.when(alike, F.col("read_id")).otherwise(said).alias("read_id"), "comment", "sequence1", "qual1", "sequence2", "qual2")
