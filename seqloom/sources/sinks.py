"""Sinks: Parquet layouts, text formats, reports, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a row group, and of one that holds long chunks.
ROW_GROUP, CHUNK_ROW_GROUP = 64 << 20, 16 << 20
#: Bytes of values, as counted, that one task of a sorted write takes.
PART_BYTES = 64 << 20


def ranged(df: DataFrame, *keys: str, least: int = 1) -> DataFrame:
    """``df`` in disjoint ranges of ``keys``, each sorted: as many as give a task some PART_BYTES, whatever the size of the table, and ``least`` of them at least.

    The values are counted before they are dealt out (8 bytes each, and the bytes of texts), as the ranges are sampled anyway.
    """
    texts = [f.name for f in df.schema.fields if f.dataType.typeName() in ("string", "binary")]
    lists = [f.name for f in df.schema.fields if f.dataType.typeName() in ("array", "map")]
    size = F.lit(8 * len(df.columns))
    for c in texts:
        size = size + F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0))
    for c in lists:
        size = size + 8 * F.coalesce(F.greatest(F.size(F.col(f"`{c}`")), F.lit(0)), F.lit(0))
    total = df.agg(F.sum(size.cast("long"))).first()[0] or 0
    return df.repartitionByRange(max(least, 1 + total // PART_BYTES), *keys).sortWithinPartitions(*keys)


def parquet(df: DataFrame, path: str, sort: list[str] = (), parts: int | None = None, chunked: bool = False, transient: bool = False, mode: str = "error") -> None:
    """Final files are zstd, transient ones snappy. With ``sort`` the files hold disjoint ranges, sorted within, so statistics prune; ``parts`` of them at least."""
    if sort:
        df = ranged(df, *sort, least=parts or 1)
    writer = df.write.mode(mode).option("compression", "snappy" if transient else "zstd").option("parquet.block.size", CHUNK_ROW_GROUP if chunked else ROW_GROUP)
    writer.parquet(path)


def quality_text(qual: Column, offset: int = 33) -> Column:
    return F.array_join(F.transform(qual, lambda q: F.char((q + offset).cast("long"))), "")


def fastq(df: DataFrame, path: str, mate: int = 1, gzip: bool = False) -> None:
    """Four lines a record; records without that mate are left out. Qualities that are null, or not as many as bases, fail the job."""
    seq, qual = F.col(f"sequence{mate}"), F.col(f"qual{mate}")
    bad = F.raise_error(F.concat(F.lit("qualities don't fit the sequence of "), F.coalesce("read_id", F.lit("a read without read_id"))))
    text = F.when(qual.isNotNull() & (F.size(qual) == F.length(seq)) & F.col("read_id").isNotNull(), quality_text(qual)).otherwise(bad)
    rows = df.where(seq.isNotNull()).select(F.concat(F.lit("@"), "read_id", F.lit("\n"), seq, F.lit("\n+\n"), text).alias("value"))
    rows.write.option("compression", "gzip" if gzip else "none").text(path)


def fastq_pair(df: DataFrame, path: str, gzip: bool = False) -> None:
    """Both mates, each where ``{ORIENTATION}`` in ``path`` reads R1 or R2; without second mates there is no R2."""
    if "{ORIENTATION}" not in path:
        raise ValueError("the path needs {ORIENTATION}")
    fastq(df, path.replace("{ORIENTATION}", "R1"), 1, gzip)
    if not df.where("sequence2 is not null").isEmpty():
        fastq(df, path.replace("{ORIENTATION}", "R2"), 2, gzip)


def fasta(df: DataFrame, path: str, name: str = "accession", gzip: bool = False) -> None:
    """Columns feature_idx, sequence and ``name``; a record without a name is called feature_<index>. A null sequence fails the job."""
    bases = F.coalesce("sequence", F.raise_error(F.concat(F.lit("no sequence: feature "), F.coalesce(F.col("feature_idx").cast("string"), F.lit("without index")))))
    record = F.concat(F.lit(">"), F.coalesce(F.col(name), F.concat(F.lit("feature_"), F.col("feature_idx").cast("string"))), F.lit("\n"), bases)
    df.select(record.alias("value")).write.option("compression", "gzip" if gzip else "none").text(path)


def sam(df: DataFrame, path: str) -> None:
    """Tab-separated alignment lines in reference and position order; the header is a table of its own, ``sam_header``."""
    cols = [F.coalesce(F.col(c).cast("string"), F.lit(d)) for c, d in (("read_id", "*"), ("flags", "0"), ("reference", "*"), ("position", "0"), ("mapq", "255"), ("cigar", "*"), ("mate_reference", "*"), ("mate_position", "0"), ("template_length", "0"), ("sequence", "*"), ("quality", "*"))]
    df.repartitionByRange("reference", "position").sortWithinPartitions("reference", "position").select(F.concat_ws("\t", *cols).alias("value")).write.text(path)


def json_report(df: DataFrame) -> DataFrame:
    """One JSON document for each row."""
    return df.select(F.to_json(F.struct("*")).alias("report"))


def export(df: DataFrame, path: str) -> bool:
    """Write unless there is nothing to write; whether something was written. The commit renames, so no reader sees half of it."""
    if df.isEmpty():
        return False
    parquet(df, path)
    return True


def upload(df: DataFrame, path: str, by: list[str]) -> DataFrame:
    """Write and return rows, bytes of text and a digest that doesn't depend on the order of rows: the sum of row hashes."""
    parquet(df, path, sort=by)
    back = df.sparkSession.read.parquet(path)
    return back.agg(F.count(F.lit(1)).alias("row_count"), F.sum(F.xxhash64(*back.columns).cast("decimal(38,0)")).cast("string").alias("digest"))


def multi_part(df: DataFrame, path: str, key: str, cost: str, budget: int) -> None:
    """A folder part=n for each part of keys that stays within ``budget``; the keys of a part follow each other."""
    from ..operators.planning import parts_by_budget

    parts = parts_by_budget(df.select(key, cost), key, cost, budget)
    df.join(parts, key).repartition("part").sortWithinPartitions("part", key).write.partitionBy("part").option("compression", "zstd").parquet(path)


def sam_header(lengths: DataFrame) -> DataFrame:
    """Header lines of SAM from (reference, length), in name order after the first line."""
    line = F.concat_ws("\t", F.lit("@SQ"), F.concat(F.lit("SN:"), "reference"), F.concat(F.lit("LN:"), F.col("length").cast("string")))
    first = lengths.sparkSession.createDataFrame([(0, "", "@HD\tVN:1.6\tSO:coordinate")], "k int, reference string, value string")
    return first.unionByName(lengths.select(F.lit(1).alias("k"), "reference", line.alias("value"))).orderBy("k", "reference").select("value")


def export_sample(tables, prep_sample_idx: int, path: str) -> int:
    """The reads of one sample, in the seven columns of a read, under ``path``; how many. It is written beside ``path`` and renamed, so ``path`` is whole or absent; without reads nothing is left."""
    from ..operators.slices import READ_COLUMNS

    if ".." in path.split("/"):
        raise ValueError("a path may not climb")
    df = tables("read").where(F.col("prep_sample_idx") == prep_sample_idx).select(*READ_COLUMNS)
    spark = df.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path
    files = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    parquet(df, path + ".partial", mode="overwrite")
    n = spark.read.parquet(path + ".partial").count()
    files.delete(at(path), True)
    if n:
        if not files.rename(at(path + ".partial"), at(path)):
            raise OSError(f"{path}: could not be published")
    else:
        files.delete(at(path + ".partial"), True)
    return n


def receipt(spark: SparkSession, path: str) -> DataFrame:
    """row_count, bytes and sha256 of what was uploaded to ``path``: the digest of the sorted digests of its files, which are hashed apart."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select("length", F.sha2("content", 256).alias("h"))
    total = files.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"), F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("sha256"))  # a digest per file
    rows = spark.read.parquet(path).agg(F.count(F.lit(1)).alias("row_count"))
    return rows.crossJoin(total)  # one row by one row
