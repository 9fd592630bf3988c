"""FASTA and FASTQ in byte ranges against the sequential parse."""

import gzip
import io
import random

import pytest

from seqloom.sources import fastx, readers


def fastq_text(rng, n, blanks):
    """Qualities that begin with marks, empty reads, repeated names after the plus."""
    out = []
    for i in range(n):
        size = rng.choice([0, 1, 5, 40, 300])
        qual = "".join(rng.choice("@+>I#") for _ in range(size))
        out.append(f"@r{i}{' c d' if i % 3 == 0 else ''}\n{''.join(rng.choice('ACGT') for _ in range(size))}\n+{'@x' if i % 5 == 0 else ''}\n{qual}\n")
        if blanks and rng.random() < 0.2:
            out.append("\n" * rng.randint(1, 5))
    return "".join(out)


def fasta_text(rng, n):
    return "".join(f">s{i} x\n" + "".join("".join(rng.choice("ACGT") for _ in range(rng.choice([0, 10, 60]))) + "\n" for _ in range(rng.choice([0, 1, 3, 50]))) for i in range(n))


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    rng = random.Random(3)
    at = tmp_path_factory.mktemp("fx %41")
    texts = {
        "a.fastq": fastq_text(rng, 120, False), "b.fastq": "\n\n" + fastq_text(rng, 100, True), "c.fastq": fastq_text(rng, 60, True).replace("\n", "\r\n"), "d.fasta": fasta_text(rng, 60), "e.fa": ">only\n" + "ACGT" * 5000 + "\n",
        "f.fasta": fasta_text(rng, 20).rstrip("\n"), "g.fastq": "", "h.fastq": "@x\n\n+\n", "i.fastq": "@x\nA\n+\nI",
    }
    for name, text in texts.items():
        (at / name).write_text(text, newline="")
    texts["z.fastq.gz"] = texts["a.fastq"]
    (at / "z.fastq.gz").write_bytes(gzip.compress(texts["a.fastq"].encode()))
    return at, texts


@pytest.mark.parametrize(("split", "few"), [(1500, 10**6), (2500, 0), (10**8, 10**6)])
def test_ranges_equal_the_sequential_parse(spark, files, monkeypatch, split, few):
    at, texts = files
    monkeypatch.setattr(fastx, "MAX_BROADCAST_BLOCKS", few)
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        got = {}
        for r in readers.fastx(spark, str(at)).collect():
            got.setdefault(r["file"].rsplit("/", 1)[1], []).append(tuple(r)[1:])
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    for name, text in texts.items():
        assert sorted(got.get(name, [])) == list(readers.parse_fastx(io.StringIO(text, newline=None))), name


@pytest.mark.parametrize("text", ["@a\nAC\n+\nI\n", "@a\nAC\n-\nII\n", "@a\nAC\n", "x\n", "@a\nA\n+\nI\nb\nA\n+\nI\n"])
def test_bad_records_fail(spark, tmp_path, text):
    (tmp_path / "x.fastq").write_text(text)
    with pytest.raises(Exception, match="FASTQ"):
        readers.fastx(spark, str(tmp_path / "x.fastq")).collect()


def test_mates(spark, tmp_path):
    def pair(one, two):
        for name, reads in (("1", one), ("2", two)):
            (tmp_path / f"{name}.fastq").write_text("".join(f"@{r}\nA\n+\nI\n" for r in reads))
        return readers.fastx_pair(spark, str(tmp_path / "1.fastq"), str(tmp_path / "2.fastq")).collect()

    assert [r["read_id"] for r in sorted(pair(["a/1", "b x"], ["a/2", "b y"]))] == ["a/1", "b"]
    for one, two in ((["a", "b"], ["x", "a"]), (["a", "b"], ["a"]), (["a"], ["a", "b"])):
        with pytest.raises(Exception, match="mates"):
            pair(one, two)
