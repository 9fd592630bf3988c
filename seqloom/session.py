"""What executors need from a session."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ship(spark: SparkSession) -> None:
    """Give the executors' Python this package, once per session; on a cluster it isn't installed there."""
    sc = spark.sparkContext
    if getattr(sc, "_seqloom_shipped", False):
        return
    package = Path(__file__).resolve().parent
    whole = Path(SparkFiles.getRootDirectory()) / f"seqloom-{uuid.uuid4().hex[:8]}.zip"
    with zipfile.ZipFile(whole, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(str(whole))
    sc._seqloom_shipped = True


#: Bytes of rows that go to Python at once, where nothing else is set: Spark's own bound lets 10,000 texts or 64 MB through,
#: which both the executor's buffers (twice that while they grow) and the worker hold for each core.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of BATCH_BYTES in this session, unless it says otherwise; no result depends on it."""
    if BATCH not in spark.conf.getAll:
        spark.conf.set(BATCH, str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Only a local master, where all is one machine, gets a folder of its own if that is unset."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is unset: it must name a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="seqloom-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def written(df: DataFrame, what: str = "t") -> DataFrame:
    """``df`` written to the shared folder and read again: cuts lineage, outlives executors, and fixes what a second run might deal otherwise."""
    at = f"{shared_dir(df.sparkSession)}/seqloom-{what}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def spelled(uri: str) -> str:
    """A file's URI as ``_metadata.file_path`` spells it; ``inputFiles()`` and the file system write file:/// for file:/."""
    return re.sub("^([A-Za-z0-9+.-]+):///", r"\1:/", uri)


def blocks(spark: SparkSession, paths: list[str], separator: str | None = None, chained: bool = False) -> tuple[DataFrame, list[str]]:
    """(file, block, value): the records of text files with their file and the byte at which their block begins; and the files.

    ``chained``: the files follow each other by name, as the parts of one write do, and are one text under the first one's
    name, whose bytes go on from file to file.
    """
    reader = spark.read if separator is None else spark.read.option("lineSep", separator)
    rows = reader.text(paths).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    files = rows.inputFiles()
    if not chained:
        return rows, files
    conf, before, at = spark._jsc.hadoopConfiguration(), 0, []
    for file in sorted(files):
        path = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(file))
        size = path.getFileSystem(conf).getFileStatus(path).getLen()
        if size:
            at.append((spelled(file), before))
            before += size
    if not at:
        return rows, files
    starts = spark.createDataFrame(at, "file string, before long")  # a row per file
    moved = rows.join(F.broadcast(starts), "file").select(F.lit(at[0][0]).alias("file"), (F.col("block") + F.col("before")).alias("block"), "value")
    return moved, [f for f in files if spelled(f) == at[0][0]]
