"""Files that arrive, taken in batch by batch; repeating a batch leaves the same rows."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The state store that keeps keys on the executors' disks and hands on only what a batch changed.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def read_files(spark: SparkSession, path: str, ddl: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(ddl).option("maxFilesPerTrigger", files_per_batch).parquet(path)


@contextmanager
def _settings(spark: SparkSession, wanted: dict[str, str]):
    """Settings that a query takes over when it starts."""
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def ingest(stream: DataFrame, out: str, checkpoint: str, keys: list[str], at: str | None = None, expiry: str | None = None):
    """Rows under ``out``, one of each key, however often it comes and whichever batch is run again.

    The keys that were taken in are state of the stream, so a batch costs what it brings and reads nothing
    of ``out``. With ``at`` and ``expiry`` a key is forgotten once the greatest ``at`` is further on than ``expiry`` after
    it (it may then come again, and rows that are themselves so late are left out); without them it is kept for ever. Each batch overwrites a directory of its own, so that one which was cut off between
    writing and committing replaces itself. Of rows with equal keys in one batch any one is taken.
    """
    if (at is None) != (expiry is None):
        raise ValueError("a time column and an expiry go together")
    fresh = stream.dropDuplicates(keys) if at is None else stream.withWatermark(at, expiry).dropDuplicatesWithinWatermark(keys)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    with _settings(stream.sparkSession, STATE_STORE):
        return fresh.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, at: str, by: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Rows by window and key; rows later than ``late`` are no longer waited for."""
    return stream.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select("w.start", "w.end", by, "n")


def finished_windows(counts: DataFrame, out: str, checkpoint: str):
    """Writes each window once, when no more rows are waited for; what is still open stays in the state for the next run."""
    with _settings(counts.sparkSession, STATE_STORE):
        return counts.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
