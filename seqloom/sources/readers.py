"""Readers: Parquet with a fixed schema, and the text formats of sequence data."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import schema
from ..functions.sequence import reverse_complement
from .fastx import FASTX, fastx, fastx_pair  # noqa: F401 - readers like the others
from .newick import NEWICK, newick  # noqa: F401


def lake_table(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A table's Parquet under its declared schema; nothing is inferred."""
    return spark.read.schema(schema(table)).parquet(path)


def parquet(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.parquet(*paths)


def parquet_sizes(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """(file, rows, bytes once unpacked) of each file, from its footer alone; for sizing batches."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    out = []
    for file in spark.read.parquet(path).inputFiles():
        reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(file), conf))
        try:
            groups = list(reader.getFooter().getBlocks())
            out.append((file, sum(g.getRowCount() for g in groups), sum(g.getTotalByteSize() for g in groups)))
        finally:
            reader.close()
    return out


def column_names(df: DataFrame) -> list[str]:
    """A schema probe: no job runs."""
    return df.columns


def tsv(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=True, schema=ddl)


def binding(staged: str | DataFrame, spark: SparkSession | None = None) -> DataFrame:
    """Reads as one relation, whether they are staged as Parquet or come as a DataFrame."""
    return staged if isinstance(staged, DataFrame) else spark.read.parquet(staged)


def parse_fastx(lines: Iterable[str], offset: int = 33) -> Iterator[tuple]:
    """(sequence_index from 1, read_id, comment, sequence, qual or None) of FASTA or FASTQ lines, told by the first mark."""
    it = (line.rstrip("\r\n") for line in lines)
    head = next((x for x in it if x), None)
    n = 0
    while head:
        n += 1
        name, _, comment = head[1:].partition(" ")
        if head[0] == "@":
            seq, plus, qual = next(it, ""), next(it, ""), next(it, "")
            if plus[:1] != "+" or len(seq) != len(qual):
                raise ValueError(f"record {n}: not FASTQ")
            yield n, name, comment or None, seq, [ord(c) - offset for c in qual]
            head = next((x for x in it if x), None)
        elif head[0] == ">":
            parts, head = [], None
            for x in it:
                if x[:1] == ">":
                    head = x
                    break
                parts.append(x)
            yield n, name, comment or None, "".join(parts), None
        else:
            raise ValueError(f"record {n}: neither FASTA nor FASTQ")


def sam(spark: SparkSession, *paths: str) -> DataFrame:
    """Alignment lines of SAM text: half-open positions, tags by name."""
    lines = spark.read.text(list(paths)).where(~F.startswith("value", F.lit("@")) & (F.col("value") != ""))
    f = F.split("value", "\t")
    spans = F.regexp_extract_all(f[5], F.lit("([0-9]+)[MDN=X]"), F.lit(1))
    length = F.aggregate(spans, F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))
    tags = F.map_from_entries(F.transform(F.slice(f, 12, F.greatest(F.size(f) - 11, F.lit(0))), lambda t: F.struct(F.substring(t, 1, 2), F.substr(t, F.lit(6)))))
    return lines.select(
        f[0].alias("read_id"), f[1].cast("int").alias("flags"), F.nullif(f[2], F.lit("*")).alias("reference"), f[3].cast("long").alias("position"), (f[3].cast("long") + length).alias("stop_position"),
        f[4].cast("short").alias("mapq"), f[5].alias("cigar"), f[6].alias("mate_reference"), f[7].cast("long").alias("mate_position"), f[8].cast("long").alias("template_length"), F.nullif(f[9], F.lit("*")).alias("sequence"), F.nullif(f[10], F.lit("*")).alias("quality"), tags.alias("tags"))


def as_sequenced(rows: DataFrame) -> DataFrame:
    """Primary lines of ``sam`` with sequence and quality in the sequencer's direction: those of the reverse strand are turned back."""
    turned = F.col("flags").bitwiseAND(16) != 0
    primary = rows.where(F.col("flags").bitwiseAND(2304) == 0)
    return primary.withColumns({"sequence": F.when(turned, reverse_complement(F.col("sequence"))).otherwise(F.col("sequence")), "quality": F.when(turned, F.reverse("quality")).otherwise(F.col("quality"))})


def sam_reads(spark: SparkSession, *paths: str, unaligned: bool = False) -> DataFrame:
    """read_id, sequence1, qual1, sequence2, qual2 of the primary lines, as the sequencer gave them; mates are one row.

    A mate without the other, or two of a kind, fails the job. Single reads stay as they are, without a shuffle. With
    ``unaligned``, for reads that are taken in before they are aligned, an aligned line and a repeated read_id fail it too.
    """
    bit = lambda n: F.col("flags").bitwiseAND(n) != 0
    name = F.when(~bit(4), F.raise_error(F.concat(F.lit("aligned line of "), "read_id"))).otherwise(F.col("read_id")) if unaligned else F.col("read_id")
    mate = F.when(bit(1) & bit(128), 2).when(bit(1) & bit(64), 1).otherwise(0)
    qual = F.transform(F.split("quality", ""), lambda c: (F.ascii(c) - 33).cast("short"))
    lines = as_sequenced(sam(spark, *paths)).select(name.alias("read_id"), mate.alias("mate"), "sequence", qual.alias("qual"))
    pick = lambda second, c: F.max(F.when((F.col("mate") == 2) == second, F.struct(c))).getField(c)
    if unaligned:
        grouped, rest = lines, None
    else:
        alone = F.col("mate") == 0
        grouped, rest = lines.where(~alone), lines.where(alone).select("read_id", F.col("sequence").alias("sequence1"), F.col("qual").alias("qual1"), F.lit(None).cast("string").alias("sequence2"), F.lit(None).cast("array<short>").alias("qual2"))
    own = grouped.groupBy("read_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("mate") == 1).alias("first"), F.count_if(F.col("mate") == 2).alias("second"),
        pick(False, "sequence").alias("sequence1"), pick(False, "qual").alias("qual1"), pick(True, "sequence").alias("sequence2"), pick(True, "qual").alias("qual2"))
    fits = (F.col("first") == F.col("second")) & ((F.col("n") == 1) & (F.col("first") == 0) | (F.col("n") == 2) & (F.col("first") == 1))
    checked = F.when(fits, F.col("read_id")).otherwise(F.raise_error(F.format_string("%s: %d lines, %d first and %d second mates", "read_id", "n", "first", "second")))
    out = own.select(checked.alias("read_id"), "sequence1", "qual1", "sequence2", "qual2")
    return out if rest is None else rest.union(out)


def gff(spark: SparkSession, *paths: str, decode: bool = False) -> DataFrame:
    """Features of GFF3: position to stop_position half-open, attributes as a map.

    An attribute that comes again adds its values after a comma, which is how GFF3 writes several. ``decode`` turns %XX
    in names and values into characters. A feature without all of the first eight columns fails the job.

    Lines are read apart, so a large file is many tasks: those with tabs that don't begin with ``#`` or ``>`` are features, so directives and a FASTA part are none.
    """
    rows = spark.read.text(list(paths)).select(F.rtrim("value", F.lit("\r")).alias("l")).where("instr(l, '\t') > 0 and not startswith(l, '#') and not startswith(l, '>')")
    f = F.split(F.when(F.size(F.split("l", "\t")) >= 8, F.col("l")).otherwise(F.raise_error(F.concat(F.lit("not a whole feature: "), "l"))), "\t")
    some = lambda c: F.nullif(c, F.lit("."))
    entries = F.filter(F.split(F.coalesce(F.get(f, F.lit(8)), F.lit("")), ";"), lambda x: F.instr(x, "=") > 0)
    plain = lambda x: F.coalesce(F.try_url_decode(F.replace(x, F.lit("+"), F.lit("%2B"))), x) if decode else x  # noqa: E731  a plus stands for itself
    of = lambda x: F.struct(F.substring_index(x, "=", 1).alias("k"), F.regexp_replace(x, "^[^=]*=", "").alias("v"))
    parts = F.transform(entries, of)
    names = F.array_distinct(F.transform(parts, lambda p: p["k"]))
    joined = lambda k: F.array_join(F.transform(F.filter(parts, lambda p: p["k"] == k), lambda p: p["v"]), ",")
    attributes = F.map_from_entries(F.transform(names, lambda k: F.struct(plain(k), plain(joined(k)))))
    return rows.select(
        f[0].alias("seqid"), f[1].alias("source"), f[2].alias("type"), f[3].cast("long").alias("position"), (f[4].cast("long") + 1).alias("stop_position"),
        some(f[5]).cast("double").alias("score"), some(f[6]).alias("strand"), some(f[7]).cast("short").alias("phase"), attributes.alias("attributes"))


def parse_newick(text: str) -> list[tuple]:
    """Rows of NEWICK, nodes numbered in the order in which they are met; the root's parent is None. ``{n}`` after a branch is its edge."""
    rows: list[list] = []
    stack: list[int] = []

    def node() -> int:
        rows.append([len(rows), None, None, None, stack[-1] if stack else None, True])
        if stack:
            rows[stack[-1]][5] = False
        return len(rows) - 1

    i, current = 0, node()
    while i < len(text):
        c = text[i]
        if c == "(":
            stack.append(current)
            current = node()
        elif c == ",":
            current = node()
        elif c == ")":
            current = stack.pop()
        elif c == ";":
            break
        elif c == "'":
            j, name = i + 1, []
            while text[j] != "'" or text[j + 1 : j + 2] == "'":
                name.append(text[j])
                j += 2 if text[j] == "'" else 1
            rows[current][1] = "".join(name)
            i = j
        elif c in ":{[":
            j = i + 1
            stop = {":": "(),;{[", "{": "}", "[": "]"}[c]
            while j < len(text) and text[j] not in stop:
                j += 1
            value = text[i + 1 : j].strip()
            if c == ":":
                rows[current][2] = float(value)
                j -= 1
            elif c == "{":
                rows[current][3] = int(value)
            i = j
        elif not c.isspace():
            j = i
            while j < len(text) and text[j] not in "(),:;{[":
                j += 1
            rows[current][1] = text[i:j].strip()
            i = j - 1
        i += 1
    return [tuple(r) for r in rows]


def jplace(spark: SparkSession, *paths: str) -> DataFrame:
    """fragment, edge_num, likelihood, like_weight_ratio, distal_length, pendant_length: a row for each placement and name; fields are placed by the file's own list."""
    spec = "fields array<string>, placements array<struct<p:array<array<double>>,n:array<string>,nm:array<array<string>>>>"
    rows = spark.read.json(list(paths), schema=spec, multiLine=True).select("fields", F.explode("placements").alias("x"))
    names = F.coalesce("x.n", F.transform("x.nm", lambda m: m[0]))
    each = rows.select("fields", F.explode(names).alias("fragment"), "x.p").select("fields", "fragment", F.explode("p").alias("v"))
    take = lambda n: F.element_at("v", F.array_position("fields", n).cast("int"))
    return each.select("fragment", take("edge_num").cast("int").alias("edge_num"), *[take(n).alias(n) for n in ("likelihood", "like_weight_ratio", "distal_length", "pendant_length")])


def blob(chunks: DataFrame, by: list[str] = ()) -> DataFrame:
    """by, data: the chunks joined in index order."""
    if not {"chunk_index", "chunk_data"} <= set(chunks.columns):
        raise ValueError("not a chunked upload")
    return reassembled(chunks, list(by)).withColumnRenamed("sequence", "data")


def reassembled(chunks: DataFrame, by: list[str]) -> DataFrame:
    """by, sequence: each is one value, so its chunks meet in one task."""
    return chunks.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_data"))), lambda x: x["chunk_data"]), "").alias("sequence"))


def manifest(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Records of many FASTA files; an empty sequence, or a read_id in two records, is refused with examples."""
    rows = fastx(spark, *paths)
    empty = rows.where("sequence is null or sequence = ''").select("file", "read_id").limit(5).collect()
    if empty:
        raise ValueError(f"empty sequences: {[tuple(r) for r in empty]}")
    twice = rows.groupBy("read_id").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("file")), ", ").alias("files")).where("n > 1").limit(5).collect()
    if twice:
        raise ValueError(f"repeated read_id: {[(r['read_id'], r['files']) for r in twice]}")
    return rows
