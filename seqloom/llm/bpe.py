"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

The leaves hold, for each symbol, the rank of the pair it forms with the next; an inner node holds
the lower of its children, the left one on a tie. The root is therefore the leftmost pair of lowest
rank. A merge changes three leaves, each in logarithmic time, until no pair is left that merges.
Pieces recur, so each worker keeps the ids of pieces it has met, in two generations of bounded size.

Defined cases: null text counts as empty and has no ids; null doc_id stays null; repeated rows and
ties are each encoded; an empty table gives no rows; other columns, whatever their names, are
ignored. Texts are taken piece by piece, so very long ones need memory for their ids only.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain, islice

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, ship
from .textnum import caches

#: The pattern that parts a text before merging: a fixed value of the vocabulary's format.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces kept by a worker, in each of two generations: some 40 MB each, as a piece of over KEPT_LENGTH characters isn't kept.
KEPT_PIECES, KEPT_LENGTH = 100_000, 64
#: Rows are handed on once they hold so many ids.
BATCH_IDS = 1 << 18
#: Characters of texts whose new pieces are merged together; a longer text is taken alone, so many pieces at a time.
TOGETHER, TOGETHER_PIECES = 1 << 17, 1 << 18
#: Bytes of a piece whose tree is a row among others, and leaves of all rows at once; a longer piece has a tree of its own.
ROW_BYTES, ROW_LEAVES = 256, 1 << 14


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in the vocabulary: printable ones for themselves, the others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(256, 512))
    return {b: chr(b) if b in plain else chr(next(spare)) for b in range(256)}


def vocabulary() -> str:
    """Path of the byte-level vocabulary that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: A pair of ids is looked up as the first times PAIR plus the second.
PAIR = 1 << 24
_NONE = 1 << 62


def merged(symbols: list[int], pairs: dict[int, tuple[int, int]]) -> list[int]:
    """``symbols`` after all merges; ``pairs`` maps first * PAIR + second to (rank, id of the merged symbol)."""
    n = len(symbols)
    if n < 2:
        return symbols
    symbols = list(symbols)
    size = 1 << (n - 1).bit_length()
    shift = size.bit_length() - 1
    tree = [_NONE] * (2 * size)
    get = pairs.get
    for i in range(n - 1):
        p = get(symbols[i] * PAIR + symbols[i + 1])
        if p is not None:
            tree[size + i] = (p[0] << shift) + i  # rank first, then the place: the least is the leftmost of the lowest rank
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a <= b else b
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    root = tree[1]
    while root != _NONE:
        i = root & (size - 1)
        j = after[i]
        new = symbols[i] = pairs[symbols[i] * PAIR + symbols[j]][1]
        symbols[j] = -1
        k = after[i] = after[j]
        p = None
        if k < n:
            before[k] = i
            p = get(new * PAIR + symbols[k])
        changes = [(size + j, _NONE), (size + i, _NONE if p is None else (p[0] << shift) + i)]
        h = before[i]
        if h >= 0:
            p = get(symbols[h] * PAIR + new)
            changes.append((size + h, _NONE if p is None else (p[0] << shift) + h))
        for at, value in changes:
            if tree[at] == value:
                continue
            tree[at] = value
            while at > 1:  # up to the first node that keeps its value
                twin = tree[at ^ 1]
                if twin < value:
                    value = twin
                at >>= 1
                if tree[at] == value:
                    break
                tree[at] = value
        root = tree[1]
    return [s for s in symbols if s >= 0]


class Pairs:
    """The pairs that merge as sorted arrays: key, rank; and the merged symbol by rank."""

    def __init__(self, pairs: dict[int, tuple[int, int]]):
        self.keys = np.array(sorted(pairs), np.int64)
        self.ranks = np.array([pairs[k][0] for k in self.keys.tolist()], np.int64)
        self.made = np.zeros(int(self.ranks.max(initial=-1)) + 1, np.int64)
        self.made[self.ranks] = [pairs[k][1] for k in self.keys.tolist()]

    def leaves(self, first: np.ndarray, second: np.ndarray, place: np.ndarray, shift: int) -> np.ndarray:
        """The leaf of each pair: rank first, then the place; _NONE if the pair doesn't merge. ``second`` may be -1."""
        if not len(self.keys):
            return np.full(len(first), _NONE)
        wanted = first * PAIR + second
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, (self.ranks[at] << shift) + place, _NONE)


def merged_rows(pieces: list[bytes], byte_ids: np.ndarray, pairs: Pairs) -> list[tuple[int, ...]]:
    """What ``merged`` gives for each piece, of 1 to ROW_BYTES bytes."""
    out: list[tuple[int, ...]] = [()] * len(pieces)
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    shifts = np.frexp(np.maximum(lengths - 1, 0))[1]  # the bits of n - 1
    for shift in np.unique(shifts).tolist():
        of = np.flatnonzero(shifts == shift)
        for begin in range(0, len(of), step := ROW_LEAVES >> shift):
            rows = of[begin : begin + step]
            symbols, counts = _merge_rows(b"".join([pieces[r] for r in rows.tolist()]), lengths[rows], 1 << shift, byte_ids, pairs)
            at = 0
            for r, n in zip(rows.tolist(), counts, strict=True):
                out[r] = tuple(symbols[at : at + n])
                at += n
    return out


def _merge_rows(raw: bytes, lengths: np.ndarray, size: int, byte_ids: np.ndarray, pairs: Pairs) -> tuple[list[int], list[int]]:
    """The symbols left of pieces of at most ``size`` bytes, one piece after the other, and how many each has."""
    shift, n, wide = size.bit_length() - 1, len(lengths), size + 1  # a column more, for what comes after the last
    symbols = np.full((n, wide), -1, np.int64)
    symbols[np.arange(wide) < lengths[:, None]] = byte_ids[np.frombuffer(raw, np.uint8)]
    tree = np.full((n, 2 * size), _NONE)
    row, i = np.nonzero(symbols[:, 1:] >= 0)
    tree[row, size + i] = pairs.leaves(symbols[row, i], symbols[row, i + 1], i, shift)
    for level in range(shift - 1, -1, -1):
        tree[:, 1 << level : 2 << level] = tree[:, 2 << level : 4 << level].reshape(n, -1, 2).min(2)
    after = np.tile(np.arange(1, wide + 1), (n, 1))
    before = np.tile(np.arange(-1, size), (n, 1))
    nodes, flat, ahead, back = (a.reshape(-1) for a in (tree, symbols, after, before))
    live = np.flatnonzero(tree[:, 1] != _NONE)
    while len(live):
        root = nodes[live * (2 * size) + 1]
        row, i = live * wide, root & (size - 1)
        j = ahead[row + i]
        k, new = ahead[row + j], pairs.made[root >> shift]
        flat[row + i], flat[row + j] = new, -1
        ahead[row + i], back[row + k] = k, i
        right = pairs.leaves(new, flat[row + k], i, shift)
        h = back[row + i]
        some = h >= 0
        left = right.copy()
        left[some] = pairs.leaves(flat[row[some] + h[some]], new[some], h[some], shift)
        base = live * (2 * size)
        at = np.concatenate((j, i, np.where(some, h, i))) + size
        base = np.concatenate((base, base, base))
        nodes[base + at] = np.concatenate((np.full(len(live), _NONE), right, left))
        for _ in range(shift):
            at >>= 1
            under = base + 2 * at
            nodes[base + at] = np.minimum(nodes[under], nodes[under + 1])
        live = live[nodes[live * (2 * size) + 1] != _NONE]
    stays = symbols >= 0
    return symbols[stays].tolist(), stays.sum(1).tolist()


#: Of a piece: its ids, the ids joined by commas, and the bytes that they decode to.
Piece = tuple[tuple[int, ...], str, bytes]


class Codec:
    """A byte-level vocabulary in the tokenizers library's JSON format."""

    def __init__(self, spec: str):
        spec = json.loads(spec)
        vocab = spec["model"]["vocab"]
        letters = byte_letters()
        back = {c: b for b, c in letters.items()}
        self.byte_ids = [vocab[letters[b]] for b in range(256)]
        rules = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.pairs = {vocab[a] * PAIR + vocab[b]: (rank, vocab[a + b]) for rank, (a, b) in reversed([*enumerate(rules)])}
        self.rows, self.byte_rows = Pairs(self.pairs), np.array(self.byte_ids, np.int64)
        self.specials = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        self.bytes_of = {i: bytes(back[c] for c in word) for word, i in vocab.items() if word not in self.specials}
        self.bytes_of |= {i: word.encode() for word, i in self.specials.items()}
        self.name_of = {i: str(i) for i in self.bytes_of}
        self.apart = regex.compile("|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None
        self.split = regex.compile(PATTERN)
        self.fresh: dict[str, Piece] = {}
        self.old: dict[str, Piece] = {}

    def _met(self, pieces: set[str]) -> dict[str, Piece]:
        """What each piece becomes; those not met before are merged together."""
        fresh, old = self.fresh, self.old
        found = {p: fresh.get(p) or old.get(p) for p in pieces}
        new = [p for p, met in found.items() if met is None]
        raw = [p.encode() for p in new]
        short = [k for k, b in enumerate(raw) if len(b) <= ROW_BYTES]
        for k, ids in zip(short, merged_rows([raw[k] for k in short], self.byte_rows, self.rows), strict=True):
            found[new[k]] = self._piece(ids)
        for p, b in zip(new, raw, strict=True):
            if len(b) > ROW_BYTES:
                found[p] = self._piece(tuple(merged([self.byte_ids[x] for x in b], self.pairs)))
        kept = [p for p in found if len(p) <= KEPT_LENGTH and p not in fresh]
        if len(fresh) + len(kept) > KEPT_PIECES:
            self.old, self.fresh, kept = fresh, {}, kept[:KEPT_PIECES]
        self.fresh.update((p, found[p]) for p in kept)
        return found

    def _piece(self, ids: tuple[int, ...]) -> Piece:
        return ids, ",".join([self.name_of[i] for i in ids]), b"".join([self.bytes_of[i] for i in ids])

    def _pieces(self, text: str) -> Iterator[list[str]]:
        if len(text) <= TOGETHER:
            yield self.split.findall(text)
            return
        pieces = map(regex.Match.group, self.split.finditer(text))
        while some := list(islice(pieces, TOGETHER_PIECES)):
            yield some

    def _parts(self, text: str) -> Iterator[list[str] | int]:
        """Lists of pieces, and the ids of added tokens between them."""
        at = 0
        if self.apart is not None:
            for m in self.apart.finditer(text):
                yield from self._pieces(text[at : m.start()])
                yield self.specials[m.group()]
                at = m.end()
        yield from self._pieces(text[at:] if at else text)

    def _of(self, part: list[str] | int, met: dict[str, Piece] | None = None) -> list[Piece]:
        if isinstance(part, int):
            return [self._piece((part,))]
        return list(map((self._met(set(part)) if met is None else met).__getitem__, part))

    def pieces_each(self, texts: Iterable[str]) -> Iterator[Iterator[list[Piece]]]:
        """What the pieces of each text become, in lists, in the texts' order; each must be used up before the next. Some TOGETHER characters of texts are split and merged at a time."""

        def together():
            parts = [list(self._parts(t)) for t in held]
            met = self._met(set(chain.from_iterable(p for some in parts for p in some if isinstance(p, list))))
            for some in parts:
                yield (self._of(p, met) for p in some)

        held: list[str] = []
        size = 0
        for text in texts:
            if len(text) <= TOGETHER:
                held.append(text)
                size += len(text)
            if size >= TOGETHER or len(text) > TOGETHER:
                yield from together()
                held, size = [], 0
            if len(text) > TOGETHER:
                yield (self._of(p) for p in self._parts(text))
        yield from together()

    def encode_each(self, texts: Iterable[str]) -> Iterator[list[int]]:
        """Ids of each text; the strings of added tokens become their ids."""
        for lists in self.pieces_each(texts):
            yield [i for some in lists for piece in some for i in piece[0]]

    def encode(self, text: str) -> list[int]:
        return next(self.encode_each([text]))

    def written_each(self, texts: Iterable[str], with_ids: bool) -> Iterator[tuple[list[int], int, str, bytes]]:
        """Of each text: its ids (none unless asked for), their number, the ids joined by commas, and the bytes that they decode to."""
        for lists in self.pieces_each(texts):
            ids, names, raw = [], [], []
            for some in filter(None, lists):
                own, name, decoded = zip(*some, strict=True)
                if with_ids:
                    ids.extend(chain.from_iterable(own))
                names.append(",".join(name))
                raw.append(b"".join(decoded))
            written = ",".join(names)
            yield ids, written.count(",") + bool(written), written, b"".join(raw)

    def decode(self, ids: list[int]) -> str:
        """The text of ``ids``; bytes that aren't UTF-8 become U+FFFD, as the library has it."""
        of = self.bytes_of
        return b"".join([of[i] for i in ids if i in of]).decode("utf-8", "replace")


_codecs: dict[int, Codec] = {}
caches.append(_codecs)


def codec(spec: str) -> Codec:
    """One codec per worker and vocabulary."""
    key = hash(spec)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(spec)
    return _codecs[key]


def encode(docs: DataFrame, vocabulary: str, text: str = "text", with_ids: bool = True) -> DataFrame:
    """doc_id, ids (unless not asked for), n_tokens, ids_sha256 and decoded_sha256 of each row; ``vocabulary`` is the path of the JSON file."""
    import pyarrow as pa

    ship(docs.sparkSession)
    bound_batches(docs.sparkSession)
    spec = docs.sparkSession.sparkContext.broadcast(open(vocabulary, encoding="utf-8").read())  # one vocabulary, some MB
    schema = "doc_id long, " + "ids array<int>, " * with_ids + "n_tokens long, ids_sha256 string, decoded_sha256 string"

    def run(batches):
        import gc

        gc.disable()  # pieces hold no cycles, and looking for some among those kept costs a seventh of the time
        try:
            yield from encoded(batches)
        finally:
            gc.enable()

    def encoded(batches):
        from .textnum import release

        own = codec(spec.value)

        def result(batch, begin: int, counts: list[int], ids: array, digests: list[str], decoded: list[str]):
            arrays = [batch["doc_id"].slice(begin, len(counts))]
            if with_ids:
                arrays.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(np.frombuffer(ids, np.int32))))
            arrays += [pa.array(counts, pa.int64()), pa.array(digests), pa.array(decoded)]
            return pa.RecordBatch.from_arrays(arrays, ["doc_id", *["ids"] * with_ids, "n_tokens", "ids_sha256", "decoded_sha256"])

        for batch in batches:
            begin, total, counts, held, digests, decoded = 0, 0, [], array("i"), [], []
            for ids, n, written, raw in own.written_each((x.as_py() or "" for x in batch["text"]), with_ids):
                counts.append(n)
                digests.append(hashlib.sha256(written.encode()).hexdigest())
                decoded.append(hashlib.sha256(raw.decode("utf-8", "replace").encode()).hexdigest())
                held.extend(ids)
                total += n
                if total >= BATCH_IDS:
                    yield result(batch, begin, counts, held, digests, decoded)
                    begin, total, counts, held, digests, decoded = begin + len(counts), 0, [], array("i"), [], []
            if counts:
                yield result(batch, begin, counts, held, digests, decoded)
        release()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, schema)


def decode(rows: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id and text of each row of (doc_id, ids)."""
    import pyarrow as pa

    ship(rows.sparkSession)
    spec = rows.sparkSession.sparkContext.broadcast(open(vocabulary, encoding="utf-8").read())

    def run(batches):
        own = codec(spec.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([own.decode(x.as_py() or []) for x in batch["ids"]], pa.string())], ["doc_id", "text"])

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")
