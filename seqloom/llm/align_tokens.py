"""Cross-tokenizer alignment: token interval tables in DuckDB inside each task, pair counts merged in Spark.

A text is cut before each blank that follows a character other than white space. No entry of either
vocabulary spans such a place, so both tokenizers' tokens end there and the parts (chunks) can be
taken apart: a task tokenises each different chunk of a slice of its documents once. DuckDB then
holds the chunks' tokens as intervals of bytes: an equi-join on the ends gives the links, a window
sum over them numbers the groups, an ASOF join gives each token the group that it falls into, and
a range join the overlaps. A slice leaves its documents, with their links as numbers of pairs, and
how often it met each pair; Spark adds these up over all slices and hands every slice the totals of
its own pairs. Slices are bounded, so what a task holds is too, but for a single long text.

Defined cases: a null or empty text has no tokens, nor has one that holds U+2581 (the sign that the
second vocabulary has for a blank), bytes that aren't UTF-8 or anything else that a tokenizer doesn't
give back: its counts are 0 and its digest is ''. A null doc_id stays null; repeated rows each count;
pairs of equal count are all a second id's best; an empty table gives no rows; other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from itertools import chain, islice

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import PATTERN
from .common import drop_kept, keep, ship

#: A slice of documents ends once it has so many different chunks or so many in all.
SLICE_CHUNKS, SLICE_TOTAL = 200_000, 3_000_000
#: Chunks whose tokens DuckDB takes together.
ALIGN_CHUNKS = 25_000
_CUT = re.compile(r"(?<=\S) ")
_ODD = re.compile(r"\s ")

_SCHEMA = "slice string, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary, pair int, a int, b int, times long"

#: Links: tokens whose intervals end together. The running sum numbers them; it is also the number of the group that ends there.
_LINKS = """
    CREATE OR REPLACE TEMP TABLE links AS
    SELECT a.chunk, a.e, a.id AS a, b.id AS b, sum(1) OVER (PARTITION BY a.chunk ORDER BY a.e) AS grp
    FROM a JOIN b ON a.chunk = b.chunk AND a.e = b.e"""

#: A token belongs to the group of the first link that ends where it does or later.
_MEMBERS = """SELECT t.chunk, t.id, l.grp FROM {side} t ASOF JOIN links l ON t.chunk = l.chunk AND t.e <= l.e ORDER BY t.chunk, t.pos"""

_OVERLAPS = """SELECT a.chunk, a.pos AS a_pos, b.pos AS b_pos, a.id AS a, b.id AS b, a.s AS a_first, a.e AS a_end, b.s AS b_first, b.e AS b_end
    FROM a JOIN b ON a.chunk = b.chunk AND a.s < b.e AND b.s < a.e ORDER BY 1, 2, 3"""


class Tokenizers:
    """Both tokenizers, and the bytes that each of their ids stands for."""

    def __init__(self, ranks: bytes, pieces: bytes):
        import sentencepiece
        import tiktoken

        table = {base64.b64decode(w): int(i) for w, i in map(bytes.split, ranks.splitlines())}
        self.first = tiktoken.Encoding("first", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
        self.first_bytes = {i: w for w, i in table.items()}
        self.second = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        every = range(self.second.get_piece_size())
        names = [self.second.id_to_piece(i) for i in every]
        self.second_bytes = [bytes([int(names[i][3:5], 16)]) if self.second.is_byte(i) else names[i].replace("▁", " ").encode() for i in every]
        self.blank = self.second.piece_to_id("▁")
        if any(re.search("[^▁]▁", w) for w in names) or self.second.encode("a  b ")[-1] != self.blank:
            raise ValueError("the second vocabulary joins or drops blanks, so chunks can't be taken apart")

    def encode(self, chunks: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of blank + chunk; the second tokenizer adds the blank itself. Both are empty where the bytes don't come back."""
        first = [self.first.encode_ordinary(" " + c) for c in chunks]
        second = [ids or [self.blank] for ids in self.second.encode(chunks, num_threads=1)]  # it gives nothing for a last blank alone
        for k, c in enumerate(chunks):
            whole = (" " + c).encode()
            if b"".join(map(self.second_bytes.__getitem__, second[k])) != whole or b"".join(map(self.first_bytes.__getitem__, first[k])) != whole:
                first[k] = second[k] = []
        return first, second


_made: dict[int, Tokenizers] = {}


def _tokenizers(files: tuple[bytes, bytes]) -> Tokenizers:
    key = hash(files)
    if key not in _made:
        _made.clear()
        _made[key] = Tokenizers(*files)
    return _made[key]


def vocabularies() -> tuple[str, str]:
    """Paths of the two vocabularies that the query uses: the ranks of the byte-level one, the model of the other."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("piece_bpe_32k.model")


def text_of(raw: bytes | None) -> str | None:
    """The text of a row, or None if it can't have tokens."""
    if not raw:
        return None
    text = raw.decode("utf-8", "replace")
    if "▁" in text or ("�" in text and text.encode() != raw):
        return None
    return text


def chunks_of(text: str) -> list[str]:
    """The chunks of blank + text, each without its first blank."""
    if not _ODD.search(" " + text):
        return text.split(" ")
    parts = _CUT.split(" " + text)
    return [parts[0][1:], *parts[1:]]


def _intervals(ids: list[list[int]], sizes: np.ndarray, first: int):
    """Arrow table of the tokens of chunks: chunk, pos, id, and the bytes [s, e) they cover."""
    import pyarrow as pa

    counts = np.fromiter(map(len, ids), np.int64, len(ids))
    flat = np.array(list(chain.from_iterable(ids)), np.int32)
    width = sizes[flat]
    ends = np.cumsum(width)
    begin = np.concatenate(([0], np.cumsum(counts)[:-1])) if len(ids) else np.zeros(0, np.int64)
    offset = np.repeat(np.concatenate(([0], ends))[begin], counts)
    chunk = np.repeat(np.arange(first, first + len(ids), dtype=np.int64), counts)
    return pa.table({"chunk": chunk, "pos": np.arange(len(flat)) - np.repeat(begin, counts), "id": flat, "s": ends - width - offset, "e": ends - offset})


class Aligner:
    """DuckDB over the tokens of some chunks at a time."""

    def __init__(self, tokenizers: Tokenizers):
        import duckdb

        self.of = tokenizers
        self.db = duckdb.connect()
        self.db.execute("SET threads = 1")
        self.db.execute("SET temp_directory = ''")
        size = max(tokenizers.first_bytes) + 1
        self.first_sizes = np.array([len(tokenizers.first_bytes.get(i, b"")) for i in range(size)], np.int64)
        self.second_sizes = np.array([len(w) for w in tokenizers.second_bytes], np.int64)
        self.width = max(size, len(self.second_sizes))
        self.names = [f"{i}{mark}" for mark in ("", ";", "|", ",") for i in range(self.width)]

    def load(self, chunks: list[str], first: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Make the tables a, b and links; how many tokens each chunk has."""
        a, b = self.of.encode(chunks)
        self.db.register("a", _intervals(a, self.first_sizes, first))
        self.db.register("b", _intervals(b, self.second_sizes, first))
        self.db.execute(_LINKS)
        return np.fromiter(map(len, a), np.int64, len(a)), np.fromiter(map(len, b), np.int64, len(b))

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        got = self.db.sql("SELECT chunk, a, b FROM links ORDER BY chunk, grp").fetchnumpy()
        return got["chunk"], got["a"], got["b"]

    def groups(self, first: int, n: int) -> list[str]:
        """Of each of the chunks its groups, as ids of the first and the second tokenizer: ``a1,a2|b1;a3|b2``."""
        parts = [self.db.sql(_MEMBERS.format(side=side)).fetchnumpy() for side in "ab"]
        chunk, ids = (np.concatenate([np.asarray(x[c], np.int64) for x in parts]) for c in ("chunk", "id"))
        group = np.concatenate([np.asarray(x["grp"], np.int64) for x in parts])
        side = np.repeat([0, 1], [len(x["id"]) for x in parts])
        order = np.lexsort((side, group, chunk))  # stable, so tokens stay in order within a group and a side
        chunk, ids, group, side = chunk[order] - first, ids[order], group[order], side[order]
        mark = np.where(chunk[1:] != chunk[:-1], 0, np.where(group[1:] != group[:-1], 1, np.where(side[1:] != side[:-1], 2, 3)))
        said = list(map(self.names.__getitem__, (np.append(mark, 0) * self.width + ids).tolist()))
        at = np.searchsorted(chunk, np.arange(n + 1)).tolist()
        return ["".join(said[at[k] : at[k + 1]]) for k in range(n)]

    def overlaps(self):
        return self.db.sql(_OVERLAPS).to_arrow_table()


class _Numbers(dict):
    def __missing__(self, key):
        self[key] = n = len(self)
        return n


class _Slice:
    """Documents whose chunks are numbered together."""

    def __init__(self, aligner: Aligner):
        self.by = aligner
        self.number = _Numbers()
        self.docs: list[tuple[int | None, np.ndarray | None]] = []
        self.total = self.done = 0
        self.n_a, self.n_b, self.said, self.owner, self.a, self.b = [], [], [], [], [], []

    def add(self, doc_id: int | None, text: str | None) -> None:
        if text is None:
            self.docs.append((doc_id, None))
            return
        parts = chunks_of(text)
        self.docs.append((doc_id, np.fromiter(map(self.number.__getitem__, parts), np.int32, len(parts))))
        self.total += len(parts)
        if len(self.number) - self.done >= ALIGN_CHUNKS:
            self._align()

    def full(self) -> bool:
        return len(self.number) >= SLICE_CHUNKS or self.total >= SLICE_TOTAL

    def _align(self) -> None:
        """Align the chunks that came since the last time."""
        fresh = iter(list(islice(self.number, self.done, None)))
        while chunks := list(islice(fresh, ALIGN_CHUNKS)):
            n_a, n_b = self.by.load(chunks, self.done)
            owner, a, b = self.by.links()
            self.said += self.by.groups(self.done, len(chunks))
            for kept, new in ((self.n_a, n_a), (self.n_b, n_b), (self.owner, owner), (self.a, a), (self.b, b)):
                kept.append(new)
            self.done += len(chunks)

    def rows(self):
        """Record batches: a row for each document, and one for each different pair."""
        import pyarrow as pa

        self._align()
        whole = lambda parts, kind: np.concatenate([*parts, np.zeros(0, kind)]).astype(kind)
        n_a, n_b, owner = whole(self.n_a, np.int64), whole(self.n_b, np.int64), whole(self.owner, np.int64)
        key = whole(self.a, np.int64) << 32 | whole(self.b, np.int64)
        pairs, number = np.unique(key, return_inverse=True)
        number = number.astype(np.int32)
        n_links = np.bincount(owner, minlength=len(n_a))
        begin = np.concatenate(([0], np.cumsum(n_links)))[:-1] if len(n_a) else np.zeros(0, np.int64)
        met = np.zeros(len(n_a), np.int64)
        name = uuid.uuid4().hex
        out, schema = [], pa.schema([("slice", pa.string()), ("doc_id", pa.int64()), *[(c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")], ("groups_sha256", pa.string()), ("links", pa.binary()), ("pair", pa.int32()), ("a", pa.int32()), ("b", pa.int32()), ("times", pa.int64())])

        def batch():
            cols = [list(c) for c in zip(*out, strict=True)]
            arrays = [pa.array([name] * len(out)), *[pa.array(c, t) for c, t in zip(cols, schema.types[1:8], strict=True)], *[pa.nulls(len(out), t) for t in schema.types[8:]]]
            out.clear()
            return pa.RecordBatch.from_arrays(arrays, schema=schema)

        held = 0
        for doc_id, parts in self.docs:
            if parts is None or not n_a[parts].all():
                out.append((doc_id, 0, 0, 0, 0, "", b""))
            else:
                np.add.at(met, parts, 1)
                counts = n_links[parts]
                n = int(counts.sum())
                at = np.repeat(begin[parts] - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(n)
                digest = hashlib.sha256(";".join([self.said[i] for i in parts]).encode()).hexdigest()
                out.append((doc_id, int(n_a[parts].sum()), int(n_b[parts].sum()), n, n, digest, number[at].tobytes()))
                held += n
            if held >= 1 << 20 or len(out) >= 5000:
                held = 0
                yield batch()
        if out:
            yield batch()
        times = np.zeros(len(pairs), np.int64)
        np.add.at(times, number, met[owner])
        some = np.flatnonzero(times)
        for k in range(0, len(some), 50_000):
            i = some[k : k + 50_000]
            arrays = [pa.array([name] * len(i)), *[pa.nulls(len(i), t) for t in schema.types[1:8]], pa.array(i, pa.int32()), pa.array(pairs[i] >> 32, pa.int32()), pa.array(pairs[i] & 0xFFFFFFFF, pa.int32()), pa.array(times[i])]
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)


def _given(docs: DataFrame, vocabularies: tuple[str, str]):
    ship(docs.sparkSession)
    files = docs.sparkSession.sparkContext.broadcast(tuple(open(p, "rb").read() for p in vocabularies))  # two vocabularies, some MB
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text")), files


def sliced(docs: DataFrame, vocabularies: tuple[str, str]) -> DataFrame:
    """The slices: rows of documents (pair is null) and of the pairs that each slice met, written to the shared folder."""
    given, files = _given(docs, vocabularies)

    def run(batches):
        from .textnum import release

        aligner = Aligner(_tokenizers(files.value))
        now = _Slice(aligner)
        for batch in batches:
            for i, x in zip(batch["doc_id"], batch["text"], strict=True):
                now.add(i.as_py(), text_of(x.as_py()))
                if now.full():
                    yield from now.rows()
                    now = _Slice(aligner)
                    release()
        if now.docs:
            yield from now.rows()
        release()

    return keep(given.mapInArrow(run, _SCHEMA), "aligned")


def totals(slices: DataFrame) -> DataFrame:
    """a, b, n, best: how many links join the two ids in all documents, and whether no other id has more with b."""
    n = keep(slices.where("pair IS NOT NULL").groupBy("a", "b").agg(F.sum("times").alias("n")), "pairs")
    most = n.groupBy("b").agg(F.max("n").alias("most"))  # a row for each id of the second vocabulary at most, which bounds it
    return n.join(F.broadcast(most), "b").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


def label(docs: DataFrame, vocabularies: tuple[str, str]) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each row."""
    import pyarrow as pa

    slices = sliced(docs, vocabularies)
    known = slices.where("pair IS NOT NULL").select("slice", "pair", "a", "b").join(totals(slices), ["a", "b"]).select(F.col("slice").alias("of"), "pair", "n", "best")
    rows = slices.where("pair IS NULL").select("slice", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links")

    def run(own: pa.Table, of_pairs: pa.Table) -> pa.Table:
        pair = of_pairs["pair"].to_numpy()
        n, best = np.zeros(int(pair.max()) + 1 if len(pair) else 0, np.int64), np.zeros(int(pair.max()) + 1 if len(pair) else 0, np.int64)
        n[pair], best[pair] = of_pairs["n"].to_numpy(), of_pairs["best"].to_numpy(zero_copy_only=False)
        at = [np.frombuffer(x.as_py(), np.int32) for x in own["links"]]
        sums = [pa.array([int(v[i].sum()) for i in at], pa.int64()) for v in (best, n)]
        return pa.table([own[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")] + sums + [own["groups_sha256"]], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return rows.groupBy("slice").cogroup(known.groupBy("of")).applyInArrow(run, schema)


def pair_counts(docs: DataFrame, vocabularies: tuple[str, str]) -> DataFrame:
    """a, b, n, best over all documents: a table that maps ids of one vocabulary to the other."""
    return totals(sliced(docs, vocabularies))


def overlaps(docs: DataFrame, vocabularies: tuple[str, str]) -> DataFrame:
    """Every pair of tokens of a document that share bytes: places, ids and byte ranges in blank + text, with their numbers among the document's tokens."""
    import pyarrow as pa

    given, files = _given(docs, vocabularies)
    kind = ["a_pos", "b_pos", "a", "b", "a_first", "a_end", "b_first", "b_end"]

    def run(batches):
        aligner = Aligner(_tokenizers(files.value))
        for batch in batches:
            for i, x in zip(batch["doc_id"], batch["text"], strict=True):
                text = text_of(x.as_py())
                chunks = chunks_of(text) if text is not None else []
                base, done, parts = np.zeros(3, np.int64), 0, []
                while done < len(chunks):
                    some = chunks[done : done + ALIGN_CHUNKS]
                    n_a, n_b = aligner.load(some)
                    if not n_a.all():
                        parts = []
                        break
                    got = aligner.overlaps()
                    size = np.array([len(c.encode()) + 1 for c in some])
                    before = [np.concatenate(([0], np.cumsum(n)))[:-1] + at for n, at in zip((n_a, n_b, size), base, strict=True)]
                    chunk = got["chunk"].to_numpy()
                    shift = {"a_pos": 0, "b_pos": 1, "a_first": 2, "a_end": 2, "b_first": 2, "b_end": 2}
                    parts.append([got[c].to_numpy() + (before[shift[c]][chunk] if c in shift else 0) for c in kind])
                    base = base + [n_a.sum(), n_b.sum(), size.sum()]
                    done += len(some)
                for columns in parts:
                    for k in range(0, len(columns[0]), 100_000):
                        piece = [c[k : k + 100_000] for c in columns]
                        yield pa.RecordBatch.from_arrays([pa.array([i.as_py()] * len(piece[0]), pa.int64()), *[pa.array(c, pa.int64()) for c in piece]], ["doc_id", *kind])

    return given.mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in kind))
