"""LM scoring with an Elias-Fano n-gram trie of three levels.

Learning goes level by level. Each task counts its texts' word pairs in packed arrays and sends them
to the shard of the first word; a shard merges its arrays and writes one trie file into the shared
folder. A second pass looks the pairs up in those files and counts what follows the pairs met at
least TWICE; it goes to the shard of the pair again, which writes the third level.

A word that holds more than a FINE-th of a shard's part of all tokens is dealt out: its successors are
cut into slices of that size by their fingerprint, and each slice is a context of its own, with a hash
and so a shard of its own. Sums over the slices are the word's counts, so which words are dealt out
changes scores within a quantisation step at most; a sample of the texts tells. Each shard is one task.

Level 1 holds the words' hashes, counts and the pointers into level 2 (running sums, so both rise);
levels 2 and 3 hold, for each context, its successors as numbers relative to the context, scaled so
that they spread evenly over the level, and their quantised smoothed probabilities. All rising
sequences are Elias-Fano coded.

Scoring: workers map the files into memory and look up whole batches: the word, its successor within
the context of one word, and the next within the context of that pair. With t(h) distinct successors
of a context h, P(w | h) = c(hw) / (c(h) + t(h)) + t(h) / (c(h) + t(h)) * P(w | shorter h)
(Witten-Bell), and P(w) = (c(w) + 1) / (N + V + 1).

Where the shared folder isn't a file system, a worker copies a file to an unlinked local one first.

Defined cases: null text counts as empty and has only the end; null doc_id counts as not held out;
repeated rows and ties are each learned from and each scored; very long texts are taken whole; an empty table gives no rows, and without
training texts all words are unknown; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_kept, keep, shared_dir, ship, text_of

FOLDS, HELD_OUT = 7, 2
#: Hashes of the marks before and after a text.
START, END = np.uint64(0x5EED0000000000A1), np.uint64(0x5EED0000000000E2)
#: Successors are told apart by so many bits of their hash, within a context; the lower ones are packed as they are.
FINGERPRINT, LOW = 40, 28
#: Pairs met so often have successors in level 3.
TWICE = 2
#: A level-3 context is its shard and its place in level 2, in so many bits.
PLACE = 36
#: Log10 probabilities are quantised to steps of 1 / STEPS.
STEPS = 4096
#: What each quantised value stands for.
_POWERS = 10.0 ** (-np.arange(1 << 16).astype(float) / STEPS)
#: A shard learns from about so many bytes of text, so more text makes more shards, not larger ones.
SHARD_BYTES = 16 << 20
#: Part of the texts from which the words to deal out and the number of shards are told; no count depends on it.
SAMPLED = 1 / 64
#: Slices of a word for each shard's part of the tokens that it holds; well over 1, since what follows its pairs weighs more than its tokens do.
FINE = 8
#: Word pairs that a task sorts at once, and bytes of text that are looked up at once.
FLUSH, LOOKUP_BYTES = 1 << 21, 1 << 22


def chains(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts, each text's end included; those before them; offsets by text."""
    from .textnum import Words

    words = Words([t.lower() for t in texts])  # bytes.lower changes A-Z only
    n = len(texts)
    off = words.offsets + np.arange(n + 1)
    tokens = np.empty(len(words.hashes) + n, np.uint64)
    ends = off[1:] - 1
    own = np.ones(len(tokens), bool)
    own[ends] = False
    tokens[own] = words.hashes
    tokens[ends] = END
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[off[:-1]] = START
    return tokens, before, off


def _merged(first: np.ndarray, second: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted by first, then second, with the counts of equal pairs added."""
    order = np.lexsort((second, first))
    first, second, counts = first[order], second[order], counts[order]
    new = np.flatnonzero(np.concatenate(([True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])))) if len(first) else np.zeros(0, np.int64)
    return first[new], second[new], np.add.reduceat(counts, new) if len(new) else counts


def _pairs_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    tokens, before, _ = chains(texts)
    return before, tokens


class Slices:
    """The words that are dealt out, in order, and their numbers of slices."""

    def __init__(self, words: np.ndarray, numbers: np.ndarray):
        self.words, self.numbers = words, numbers

    def of(self, words: np.ndarray) -> np.ndarray:
        """The number of slices of each word, 1 if it isn't dealt out."""
        if not len(self.words):
            return np.ones(len(words), np.int64)
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return np.where(self.words[at] == words, self.numbers[at], 1)

    @staticmethod
    def which(numbers: np.ndarray, prints: np.ndarray) -> np.ndarray:
        """The slice a successor is in."""
        return ((prints >> np.uint64(FINGERPRINT - 32)) * numbers.astype(np.uint64) >> np.uint64(32)).astype(np.int64)

    @staticmethod
    def key(words: np.ndarray, slices: np.ndarray) -> np.ndarray:
        """The context of a word's slice; the first is the word itself."""
        from .textnum import mixed

        return np.where(slices > 0, mixed(words + slices.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), words)

    def placed(self, words: np.ndarray, prints: np.ndarray) -> np.ndarray:
        """The contexts that hold the successors ``prints`` of the words."""
        return self.key(words, self.which(self.of(words), prints)) if len(self.words) else words

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """All contexts of the words, and the words they are of."""
        owner = np.repeat(np.arange(len(self.words)), self.numbers)
        first = np.cumsum(self.numbers) - self.numbers
        return self.key(self.words[owner], np.arange(len(owner)) - first[owner]), self.words[owner]


def _told(batches):
    """(context, n): the words of the texts by how often another follows; context null: bytes of text."""
    import pyarrow as pa

    from .textnum import batches as parts
    from .textnum import column_bytes, release

    for batch in batches:
        texts = column_bytes(batch["txt"])
        for a, b in parts(texts, LOOKUP_BYTES):
            words, n = np.unique(chains(texts[a:b])[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([*words.view(np.int64).tolist(), None], pa.int64()), pa.array([*n.tolist(), sum(map(len, texts[a:b]))], pa.int64())], ["context", "n"])
    release()


def layout(docs: DataFrame) -> tuple[int, Slices]:
    """The number of shards, and the words that are dealt out: those with more than a FINE-th of a shard's part of the tokens, so fewer than FINE times the shards."""
    spark = docs.sparkSession
    part = docs.select("txt").sample(SAMPLED, seed=8) if SAMPLED < 1 else docs.select("txt")
    told = keep(part.mapInArrow(_told, "context long, n long").groupBy("context").agg(F.sum("n").alias("n")), "words")
    whole = told.agg(F.sum(F.when(F.col("context").isNull(), F.col("n"))).alias("bytes"), F.sum(F.when(F.col("context").isNotNull(), F.col("n"))).alias("tokens")).first()
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int((whole["bytes"] or 0) / SAMPLED) // SHARD_BYTES))
    found = told.where(F.col("context").isNotNull() & (F.col("n") * (FINE * shards) > F.lit(whole["tokens"] or 0))).collect()
    drop_kept(told)
    words = np.array([r["context"] for r in found], np.int64).view(np.uint64)
    numbers = np.array([-(-r["n"] * FINE * shards // whole["tokens"]) for r in found], np.int64)
    order = np.argsort(words)
    return shards, Slices(words[order], numbers[order])


def _blocks(shards: int, pairs_of, owner, placed=None):
    """Texts to rows (shard, contexts, lengths, successors, counts) of packed arrays.

    ``pairs_of``: texts to contexts and following words; ``owner``: contexts, sorted, to shards, which rise
    with them; ``placed``: contexts and successors to the contexts that hold them.
    """
    def run(batches):
        import pyarrow as pa

        from .textnum import batches as parts
        from .textnum import column_bytes, release

        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush():
            first = np.concatenate([h[0] for h in held])
            second = np.concatenate([h[1] for h in held]) >> np.uint64(64 - FINGERPRINT)
            first = placed(first, second) if placed else first
            first, second, counts = _merged(first, second, np.ones(len(first), np.uint32))
            begin = np.flatnonzero(np.concatenate(([True], first[1:] != first[:-1])))
            lengths = np.diff(np.concatenate((begin, [len(first)])))
            contexts = first[begin]
            cuts = np.searchsorted(owner(contexts), np.arange(shards + 1))
            out = []
            for s in np.flatnonzero(np.diff(cuts)):
                a, b = cuts[s], cuts[s + 1]
                x, y = begin[a], (begin[b] if b < len(begin) else len(first))
                high, low = (second[x:y] >> np.uint64(8)).astype(np.uint32), second[x:y].astype(np.uint8)
                out.append((int(s), contexts[a:b].tobytes(), lengths[a:b].astype(np.uint32).tobytes(), high.tobytes() + low.tobytes(), counts[x:y].astype(np.uint32).tobytes()))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), *[pa.binary()] * 4), strict=True)], ["shard", "contexts", "lengths", "successors", "counts"])

        for batch in batches:
            texts = column_bytes(batch["txt"])
            for a, b in parts(texts, LOOKUP_BYTES):
                pair = pairs_of(texts[a:b])
                if len(pair[0]):
                    held.append(pair)
                    size += len(pair[0])
                if size >= FLUSH:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()
        release()

    return run


def _unpacked(table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A shard's blocks, merged: sorted contexts of all pairs, successors, counts."""
    first, second, counts = [], [], []
    for a, b, c, d in zip(*([x.as_py() for x in table[n]] for n in ("contexts", "lengths", "successors", "counts")), strict=True):
        first.append(np.repeat(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint32)))
        n = len(first[-1])
        second.append((np.frombuffer(c, np.uint32, n).astype(np.uint64) << np.uint64(8)) | np.frombuffer(c, np.uint8, n, 4 * n))
        counts.append(np.frombuffer(d, np.uint32).astype(np.int64))
    return _merged(np.concatenate(first), np.concatenate(second), np.concatenate(counts))


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    """By the upper half of the hash, so shards follow the order of hashes."""
    return ((hashes >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _files(uri: str):
    import pyarrow.fs as fs

    return fs.FileSystem.from_uri(uri)


def relative(begin: np.ndarray, types: np.ndarray, prints: np.ndarray) -> np.ndarray:
    """A successor's number in its level: the context's first place and the fingerprint scaled to its number of successors, then LOW bits of the fingerprint."""
    up = begin.astype(np.uint64) + (((prints >> np.uint64(FINGERPRINT - 32)) * types.astype(np.uint64)) >> np.uint64(32))
    return (up << np.uint64(LOW)) | (prints & np.uint64((1 << LOW) - 1))


def _quantised(p: np.ndarray) -> np.ndarray:
    return np.clip(np.round(-np.log10(p) * STEPS), 0, 65535).astype(np.uint16)


def build(first: np.ndarray, second: np.ndarray, counts: np.ndarray) -> tuple[dict, dict]:
    """Rising sequences and plain arrays of one level: keys (contexts), pointers, successors; share, backoff, often; and the counts of the contexts."""
    begin = np.flatnonzero(np.concatenate(([True], first[1:] != first[:-1]))) if len(first) else np.zeros(0, np.int64)
    keys, pointers = first[begin], np.concatenate((begin, [len(first)]))
    types = np.diff(pointers)
    totals = np.add.reduceat(counts, begin) if len(begin) else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(keys)), types)
    number = relative(pointers[:-1][owner], types[owner], second)
    order = np.argsort(number, kind="stable")
    share = counts / (totals + types)[owner]
    plain = {"share": _quantised(share[order]), "backoff": _quantised(types / np.maximum(totals + types, 1)), "often": np.packbits(counts[order] >= TWICE)}
    return {"keys": (keys, None), "counts": (np.concatenate(([0], np.cumsum(totals))), None), "pointers": (pointers, None), "successors": (number[order], LOW)}, plain


def _write(at: str, name: str, rising: dict, plain: dict) -> str:
    """One file: its parts 8 bytes aligned, then the head, then the head's length. Each attempt writes a file of its own."""
    from .elias_fano import EliasFano

    files, path = _files(f"{at}/{name}-{uuid.uuid4().hex[:8]}")
    files.create_dir(os.path.dirname(path), recursive=True)
    with files.open_output_stream(path) as out:
        head, where, done = {}, [], 0

        def put(a: np.ndarray) -> None:
            nonlocal done
            raw = a.tobytes()
            raw += bytes(-len(raw) % 8)
            where.append([done, len(a), a.dtype.str])
            out.write(raw)
            done += len(raw)

        for k, (values, width) in rising.items():
            ef = EliasFano.of(values, width)
            head[k] = [ef.n, ef.width, len(where)]
            for a in ef.parts():
                put(a)
        for k, a in plain.items():
            head[k] = len(where)
            put(a)
        tail = json.dumps(head | {"arrays": where}).encode()
        out.write(tail + len(tail).to_bytes(8, "little"))
    return os.path.basename(path)


class Level:
    """A level's file in memory-mapped form."""

    def __init__(self, uri: str):
        import pyarrow.fs as fs

        from .elias_fano import EliasFano

        files, path = _files(uri)
        if isinstance(files, fs.LocalFileSystem):
            raw = np.memmap(path, np.uint8, "r")
        else:
            with tempfile.NamedTemporaryFile() as own, files.open_input_stream(path) as stream:
                while piece := stream.read(1 << 24):
                    own.write(piece)
                own.flush()
                raw = np.memmap(own.name, np.uint8, "r")  # the file is unlinked here; the mapping stays
        raw = raw.view(np.ndarray)  # the mapping without its class, whose slices cost more
        size = int.from_bytes(raw[-8:].tobytes(), "little")
        head = json.loads(raw[-8 - size : -8].tobytes())

        def part(i: int) -> np.ndarray:
            start, n, kind = head["arrays"][i]
            return raw[start : start + n * np.dtype(kind).itemsize].view(kind)

        for name in ("keys", "counts", "pointers", "successors"):
            if name in head:
                n, width, at = head[name]
                setattr(self, name, EliasFano(n, width, part(at), part(at + 1), part(at + 2)))
        self.share, self.backoff, self.often = (part(head[k]) for k in ("share", "backoff", "often"))

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which contexts are known, and of those the place and the place of the first successor."""
        place, hit = self.keys.successor(keys)
        return hit, place[hit], self.pointers.get(place[hit]).astype(np.int64)

    def count(self, places: np.ndarray) -> np.ndarray:
        return (self.counts.get(places + 1) - self.counts.get(places)).astype(np.int64)

    def types(self, places: np.ndarray, begin: np.ndarray) -> np.ndarray:
        return self.pointers.get(places + 1).astype(np.int64) - begin

    def after(self, begin: np.ndarray, types: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Place of each word among the successors that begin there, -1 if it isn't among them."""
        at, hit = self.successors.successor(relative(begin, types, words >> np.uint64(64 - FINGERPRINT)))
        return np.where(hit, at, -1)

    def shares(self, places: np.ndarray) -> np.ndarray:
        return _POWERS[self.share[places]]

    def weights(self, places: np.ndarray) -> np.ndarray:
        return _POWERS[self.backoff[places]]

    def is_often(self, places: np.ndarray) -> np.ndarray:
        return (self.often[places >> 3] >> (7 - (places & 7)).astype(np.uint8) & 1).astype(bool)


class Model:
    """The files of a trie, one per shard and level, opened when first asked."""

    def __init__(self, at: str, shards: int, slices: Slices, names: dict[int, str], tokens: int, types: int, texts: int):
        self.at, self.shards, self.slices, self.names, self.upper = at, shards, slices, names, {}
        self.tokens, self.types, self.texts = tokens, types, texts

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "open"}

    def _level(self, names: dict[int, str], s: int) -> Level | None:
        cache = self.__dict__.setdefault("open", {})
        if s not in names:
            return None
        if names[s] not in cache:
            cache[names[s]] = Level(f"{self.at}/{names[s]}")
        return cache[names[s]]

    def _by_shard(self, names: dict[int, str], of: np.ndarray):
        order = np.argsort(of.astype(np.uint16) if self.shards < 65536 else of, kind="stable")
        cuts = np.searchsorted(of[order], np.arange(self.shards + 1))
        for s in np.flatnonzero(np.diff(cuts)):
            if (level := self._level(names, int(s))) is not None:
                yield level, order[cuts[s] : cuts[s + 1]]

    def looked_up(self, texts: list[bytes]) -> dict:
        """Tokens of the texts and what levels 1 and 2 have: count of each token; count and distinct successors of the one before; the pair's shard, its place there (-1 if never seen), share and whether it was met often."""
        tokens, before, off = chains(texts)
        words, of_token = np.unique(np.concatenate((tokens, [START])), return_inverse=True)
        # a context for each slice of each word: the first slices in the words' own places, the others after them
        numbers = self.slices.of(words)
        dealt = np.flatnonzero(numbers > 1)
        more = numbers[dealt] - 1
        owner = np.concatenate((np.arange(len(words)), np.repeat(dealt, more)))
        after = np.zeros(len(words), np.int64)
        after[dealt] = len(words) + np.cumsum(more) - more  # place of a word's second slice
        keys = self.slices.key(words[owner], np.where(np.arange(len(owner)) < len(words), 0, np.arange(len(owner)) - after[owner] + 1))
        held, kinds, begin = (np.zeros(len(keys), np.int64) for _ in range(3))
        shard = shard_of(keys, self.shards)
        for level, on in self._by_shard(self.names, shard):
            hit, place, first = level.find(keys[on])
            on = on[hit]
            held[on], begin[on] = level.count(place), first
            kinds[on] = level.types(place, first)
        count, types = held[: len(words)].copy(), kinds[: len(words)].copy()
        np.add.at(count, owner[len(words) :], held[len(words) :])
        np.add.at(types, owner[len(words) :], kinds[len(words) :])
        count[words == END] = self.texts
        start, of_token = of_token[-1], of_token[:-1]
        of_before = np.empty_like(of_token)
        of_before[1:] = of_token[:-1]
        of_before[off[:-1]] = start
        slot = of_before
        if len(dealt):
            which = self.slices.which(numbers[of_before], tokens >> np.uint64(64 - FINGERPRINT))
            slot = np.where(which > 0, after[of_before] + which - 1, of_before)
        place, share, often = np.full(len(tokens), -1), np.zeros(len(tokens)), np.zeros(len(tokens), bool)
        seen = np.flatnonzero((kinds[slot] > 0) & (count[of_token] > 0))
        for level, on in self._by_shard(self.names, shard[slot[seen]]):
            on = seen[on]
            at = level.after(begin[slot[on]], kinds[slot[on]], tokens[on])
            on, at = on[at >= 0], at[at >= 0]
            place[on], share[on], often[on] = at, level.shares(at), level.is_often(at)
        if len(dealt):  # shares are of the slice
            own, whole = held + kinds, (count + types)[of_before]
            share *= own[slot] / np.maximum(whole, 1)
        return {"tokens": tokens, "off": off, "count": count[of_token], "c": count[of_before], "t": types[of_before], "shard": shard[slot], "place": place, "share": share, "often": often}

    def pair_contexts(self, x: dict) -> np.ndarray:
        """Tokens whose two words before form a pair that was met often."""
        ok = np.zeros(len(x["tokens"]), bool)
        ok[1:] = x["often"][:-1]
        ok[x["off"][:-1]] = False
        return np.flatnonzero(ok)

    def triples(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Level-3 contexts and the words that follow them."""
        x = self.looked_up(texts)
        at = self.pair_contexts(x)
        return (x["shard"][at - 1].astype(np.uint64) << np.uint64(PLACE)) | x["place"][at - 1].astype(np.uint64), x["tokens"][at]

    def score(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Tokens, known tokens, base score and score (log10) of each text."""
        x = self.looked_up(texts)
        off, c, t = x["off"], x["c"], x["t"]
        base = (x["count"] + 1) / (self.tokens + self.types + 1)
        p = np.where(c + t > 0, t / np.maximum(c + t, 1), 1.0) * base + x["share"]
        at = self.pair_contexts(x)
        for level, on in self._by_shard(self.upper, x["shard"][at - 1]):
            on = at[on]
            hit, place, begin = level.find(x["place"][on - 1].astype(np.uint64))
            on = on[hit]
            found = level.after(begin, level.types(place, begin), x["tokens"][on])
            own = np.where(found >= 0, level.shares(np.maximum(found, 0)), 0.0)
            p[on] = own + level.weights(place) * p[on]
        at = off[:-1]
        known = np.add.reduceat((x["count"] > 0).astype(np.int64), at)
        return np.diff(off), known, np.add.reduceat(np.log10(base), at), np.add.reduceat(np.log10(np.minimum(p, 1.0)), at)


BLOCKS = "shard int, contexts binary, lengths binary, successors binary, counts binary"


def learn(docs: DataFrame) -> Model:
    """The trie of the texts (column txt) of ``docs``."""
    spark = docs.sparkSession
    ship(spark)
    shards, slices = layout(docs)
    keys, owners = slices.keys()  # fewer than twice FINE times the shards
    starts = np.append(keys[owners == START], START)
    at = f"{shared_dir(spark)}/seqloom-trie-{uuid.uuid4().hex}"

    def pairs(table):
        import pyarrow as pa

        shard = table["shard"][0].as_py()
        first, second, counts = _unpacked(table)
        rising, plain = build(first, second, counts)
        texts = int(counts[np.isin(first, starts)].sum())
        name = _write(at, f"pairs-{shard:05d}", rising, plain)
        words = rising["keys"][0]
        return pa.table({"shard": pa.array([shard], pa.int32()), "name": [name], "tokens": pa.array([int(counts.sum()) - texts], pa.int64()), "types": pa.array([len(words) - int(np.isin(words, np.append(keys, START)).sum())], pa.int64()), "texts": pa.array([texts], pa.int64())})

    blocks = docs.select("txt").mapInArrow(_blocks(shards, _pairs_of, lambda contexts: shard_of(contexts, shards), slices.placed), BLOCKS)
    told = blocks.repartitionById(shards, "shard").groupBy("shard").applyInArrow(pairs, "shard int, name string, tokens long, types long, texts long").collect()  # one row per shard
    texts = sum(r["texts"] for r in told)
    types = sum(r["types"] for r in told) + int((slices.words != START).sum()) + (texts > 0)
    model = Model(at, shards, slices, {r["shard"]: r["name"] for r in told}, sum(r["tokens"] for r in told) + texts, types, texts)
    lower = spark.sparkContext.broadcast(model)  # the names of the files, not their content

    def triples(table):
        import pyarrow as pa

        shard = table["shard"][0].as_py()
        first, second, counts = _unpacked(table)
        rising, plain = build(first & np.uint64((1 << PLACE) - 1), second, counts)
        del rising["counts"]
        return pa.table({"shard": pa.array([shard], pa.int32()), "name": [_write(at, f"triples-{shard:05d}", rising, plain)]})

    blocks = docs.select("txt").mapInArrow(_blocks(shards, lambda texts: lower.value.triples(texts), lambda contexts: (contexts >> np.uint64(PLACE)).astype(np.int64)), BLOCKS)
    model.upper = {r["shard"]: r["name"] for r in blocks.repartitionById(shards, "shard").groupBy("shard").applyInArrow(triples, "shard int, name string").collect()}
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row of (doc_id, held_out, txt)."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the names of the files, not their content

    def run(batches):
        import pyarrow as pa

        from .textnum import batches as parts
        from .textnum import column_bytes

        for batch in batches:
            texts = column_bytes(batch["txt"])
            for a, b in parts(texts, LOOKUP_BYTES):
                n, known, base, own = shared.value.score(texts[a:b])
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(a, b - a), batch["held_out"].slice(a, b - a), pa.array(n), pa.array(known), pa.array(np.full(b - a, shared.value.tokens)), pa.array(base), pa.array(own)], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return docs.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def apply(docs: DataFrame) -> DataFrame:
    """Learn from the rows whose crc32(doc_id) mod 7 isn't 2 and score all."""
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold == HELD_OUT).alias("held_out"), text_of().alias("txt"))
    return score(rows, learn(rows.where("not held_out")))
