"""Arrow streams as a source of many partitions, and a Parquet sink whose tasks report what they wrote.

Both are Python data sources: Spark plans a task for each stream or partition, runs failed ones again, and commits once.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import re
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..session import ship

#: Rows of a row group, and the bytes at which it is closed sooner: a thousand million letters in chunks of 64 KB.
ROW_GROUP_ROWS, ROW_GROUP_BYTES = 16_384, 1 << 30
#: Most rows that a stream's batch is handed on with.
BATCH_ROWS = 10_000
#: How a stream of the IPC format ends.
END_OF_STREAM = b"\xff\xff\xff\xff\x00\x00\x00\x00"


def opened(uri: str):
    """(file system, path) of Arrow for a URI or a local path."""
    from pyarrow import fs

    if "://" in uri:
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), re.sub("^file:", "", uri)


# source ------------------------------------------------------------------------------------------


@dataclass
class Stream(InputPartition):
    """A file of the IPC stream format, or a Flight server's address with a ticket (base64)."""

    location: str
    ticket: str | None = None


@dataclass
class _Streams(DataSourceReader):
    streams: list[Stream]
    kind: object
    rows: int

    def partitions(self) -> list[Stream]:
        return self.streams

    def read(self, partition: Stream) -> Iterator:
        from pyspark.sql.pandas.types import to_arrow_schema

        wanted = to_arrow_schema(self.kind)
        for batch in _batches(partition):
            fitted = _fitted(batch, wanted, partition.location)
            for first in range(0, fitted.num_rows, self.rows):
                yield fitted.slice(first, self.rows)


def _batches(stream: Stream) -> Iterator:
    """Batch by batch. A file that was cut off is an error even where the cut falls between two batches."""
    import pyarrow as pa

    if stream.ticket is not None:
        from pyarrow import flight

        with flight.connect(stream.location) as client:
            for chunk in client.do_get(flight.Ticket(base64.b64decode(stream.ticket))):
                yield chunk.data
        return
    files, path = opened(stream.location)
    with files.open_input_file(path) as f:
        size = f.size()
        if size < len(END_OF_STREAM) or f.read_at(len(END_OF_STREAM), size - len(END_OF_STREAM)) != END_OF_STREAM:
            raise OSError(f"{stream.location}: the stream has no end")
        f.seek(0)
        with pa.ipc.open_stream(f) as reader:
            yield from reader


def _fitted(batch, wanted, location: str):
    """The wanted columns in their order. Missing columns and other types fail; wide and narrow text and the zones of instants are one type. More columns may come."""
    import pyarrow as pa

    def same(a, b) -> bool:
        text, raw = (pa.string(), pa.large_string()), (pa.binary(), pa.large_binary())
        return a == b or (a in text and b in text) or (a in raw and b in raw) or (pa.types.is_timestamp(a) and pa.types.is_timestamp(b) and (a.tz is None) == (b.tz is None))

    columns = []
    for f in wanted:
        at = batch.schema.get_all_field_indices(f.name)
        if len(at) != 1:
            raise ValueError(f"{location}: {'no' if not at else 'more than one'} column {f.name}")
        column = batch.column(at[0])
        if not same(column.type, f.type):
            raise ValueError(f"{location}: column {f.name} is {column.type}, not {f.type}")
        columns.append(column.cast(f.type))
    return pa.RecordBatch.from_arrays(columns, schema=wanted)


class ArrowStreams(DataSource):
    """Each stream is a partition. Options: ``streams`` (JSON list of [location, ticket or null]) and ``rows``."""

    @classmethod
    def name(cls) -> str:
        return "arrow_streams"

    def reader(self, schema) -> _Streams:
        return _Streams([Stream(*s) for s in json.loads(self.options["streams"])], schema, int(self.options.get("rows", BATCH_ROWS)))


def arrow_streams(spark: SparkSession, ddl: str, path: str | None = None, tickets: Sequence[tuple[str, bytes]] = (), rows: int = BATCH_ROWS) -> DataFrame:
    """The batches of all streams under the folder ``path`` (files ``*.arrows``) or behind Flight ``tickets`` (server, ticket), as one relation.

    A task holds one batch at a time and hands on at most ``rows`` rows of it, so memory is that of the widest batch. A
    stream that lacks a column of ``ddl``, has another type, breaks off or can't be reached fails the job; a task that is run again opens its stream again. An empty folder gives no rows, a missing one an error.
    """
    if (path is None) == (not tickets):
        raise ValueError("either a folder or tickets")
    if path is not None:
        from pyarrow import fs

        files, at = opened(path)
        scheme = path[: len(path) - len(at)] if path.endswith(at) else ""
        streams = sorted([scheme + f.path, None] for f in files.get_file_info(fs.FileSelector(at)) if f.is_file and f.path.endswith(".arrows"))
    else:
        streams = [[where, base64.b64encode(ticket).decode()] for where, ticket in tickets]
    if not streams:
        return spark.createDataFrame([], ddl)
    ship(spark)
    spark.dataSource.register(ArrowStreams)
    return spark.read.format("arrow_streams").schema(ddl).option("streams", json.dumps(streams)).option("rows", rows).load()


def write_streams(df: DataFrame, path: str) -> int:
    """Each partition as a stream file under ``path``, which ``arrow_streams`` reads again; rows written. A partition that is run again replaces its file, and files appear whole."""
    ship(df.sparkSession)

    def put(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        task = TaskContext.get()
        files, at = opened(path)
        files.create_dir(at, recursive=True)
        name, n, writer = f"{at}/part-{task.partitionId():06d}.arrows", 0, None
        part = f"{name}.{task.taskAttemptId()}"
        for batch in batches:
            if writer is None:
                out = files.open_output_stream(part)
                writer = pa.ipc.new_stream(out, batch.schema)
            writer.write_batch(batch)
            n += batch.num_rows
        if writer is not None:
            writer.close()
            out.close()
            files.move(part, name)
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    return df.mapInArrow(put, "n long").agg({"n": "sum"}).first()[0] or 0


# sink --------------------------------------------------------------------------------------------


class _Counted(io.RawIOBase):
    """Hashes and counts what passes."""

    def __init__(self, out):
        self.out, self.sha, self.bytes = out, hashlib.sha256(), 0

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        view = memoryview(data)
        self.sha.update(view)
        self.out.write(view)
        self.bytes += view.nbytes
        return view.nbytes


@dataclass
class Written(WriterCommitMessage):
    """What a task wrote; no file if it had no rows."""

    file: str | None = None
    rows: int = 0
    bytes: int = 0
    sha256: str = ""


@dataclass
class _Parquet(DataSourceArrowWriter):
    path: str
    kind: object
    rows: int
    limit: int
    job: str = field(default_factory=lambda: uuid.uuid4().hex)

    @property
    def _staged(self) -> str:
        return f"{self.path}.staged-{self.job}"

    def write(self, iterator: Iterator) -> Written:
        return self._file((b for b in iterator if b.num_rows))

    def _file(self, batches: Iterator, schema=None) -> Written:
        import pyarrow as pa
        import pyarrow.parquet as pq

        files, at = opened(self._staged)
        files.create_dir(at, recursive=True)
        name, writer, held, size, n = f"part-{uuid.uuid4().hex}.parquet", None, [], 0, 0
        out = counted = None

        def flush() -> None:
            writer.write_table(pa.Table.from_batches(held), row_group_size=self.rows)
            held.clear()

        try:
            if schema is not None:
                out = files.open_output_stream(f"{at}/{name}")
                counted = _Counted(out)
                pq.ParquetWriter(pa.PythonFile(counted, "w"), schema, compression="zstd").close()
            for batch in batches:
                if writer is None:
                    out = files.open_output_stream(f"{at}/{name}")
                    counted = _Counted(out)
                    writer = pq.ParquetWriter(pa.PythonFile(counted, "w"), batch.schema, compression="zstd")
                first, width = 0, max(1, batch.nbytes // batch.num_rows)
                while first < batch.num_rows:  # a group is closed when it is full, so a batch may be parted
                    part = batch.slice(first, min(self.rows - sum(b.num_rows for b in held), max(1, (self.limit - size) // width)))
                    held.append(part)
                    first, size, n = first + part.num_rows, size + width * part.num_rows, n + part.num_rows
                    if sum(b.num_rows for b in held) == self.rows or size + width > self.limit:
                        flush()
                        size = 0
            if held:
                flush()
            if writer is not None:
                writer.close()
            if out is None:
                return Written()
            out.close()
            return Written(name, n, counted.bytes, counted.sha.hexdigest())
        except BaseException:
            if out is not None:
                out.close()
                files.delete_file(f"{at}/{name}")
            raise

    def commit(self, messages: list[Written | None]) -> None:
        """The files that tasks reported, and no others, become ``path`` by one rename."""
        from pyarrow import fs
        from pyspark.sql.pandas.types import to_arrow_schema

        done = [m for m in messages if m is not None and m.file]
        if not done:
            done = [self._file(iter(()), to_arrow_schema(self.kind))]
        files, at = opened(self._staged)
        listed = {m.file for m in done}
        for f in files.get_file_info(fs.FileSelector(at)):
            if f.base_name not in listed:  # of attempts that didn't count
                files.delete_file(f.path)
        receipt = {"row_count": sum(m.rows for m in done), "bytes": sum(m.bytes for m in done), "sha256": hashlib.sha256("".join(sorted(m.sha256 for m in done)).encode()).hexdigest(), "files": [[m.file, m.rows, m.bytes, m.sha256] for m in done]}
        with files.open_output_stream(f"{at}/_receipt") as out:
            out.write(json.dumps(receipt).encode())
        to = opened(self.path)[1]
        if files.get_file_info(to).type != fs.FileType.NotFound:
            files.delete_dir(at)
            raise FileExistsError(f"{self.path} is there already")
        files.move(at, to)

    def abort(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        files, at = opened(self._staged)
        if files.get_file_info(at).type != fs.FileType.NotFound:
            files.delete_dir(at)


class ReportedParquet(DataSource):
    """Options: ``path``, ``rows`` and ``limit`` of a row group."""

    @classmethod
    def name(cls) -> str:
        return "reported_parquet"

    def writer(self, schema, overwrite: bool) -> _Parquet:
        return _Parquet(self.options["path"].rstrip("/"), schema, int(self.options["rows"]), int(self.options["limit"]))


def reported(df: DataFrame, path: str, rows: int = ROW_GROUP_ROWS, limit: int = ROW_GROUP_BYTES) -> dict:
    """Write ``df`` as Parquet and return row_count, bytes and sha256 (the digest of the files' sorted digests), counted while writing: nothing is read again.

    Row groups hold exactly ``rows`` rows but the last of a file, or those that reach ``limit`` bytes sooner; a task buffers one. The
    receipt, with a line for each file, stays beside the files and is read again by ``receipt``. ``path`` must not
    exist; it appears whole by a rename, and nothing is left of a job that failed.
    """
    from pyarrow import fs

    files, at = opened(path.rstrip("/"))
    if files.get_file_info(at).type != fs.FileType.NotFound:
        raise FileExistsError(f"{path} is there already")
    ship(df.sparkSession)
    df.sparkSession.dataSource.register(ReportedParquet)
    df.write.format("reported_parquet").option("path", path).option("rows", rows).option("limit", limit).mode("append").save()
    return receipt(path)


def receipt(path: str) -> dict:
    """What was counted when ``path`` was written, with a (name, rows, bytes, sha256) for each file."""
    files, at = opened(path.rstrip("/"))
    with files.open_input_stream(f"{at}/_receipt") as f:
        return json.loads(f.read())
