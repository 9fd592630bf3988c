import hashlib
import random

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

from seqloom.llm import bpe  # noqa: E402


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(open(bpe.vocabulary(), encoding="utf-8").read())


ALPHABET = ["a", "b", " ", "  ", "\n", "\t", "\x1c", "\x85", "​", "é", "ß", "日", "😀", "1", "٣", "²", "'s", "'ll", "<|endoftext|>", "<|endof", "!", " ", "the", "ing", "\r\n", "\x0b", "́", "　", "\0", "�"]


def test_like_the_library(codec, library):
    rng = random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 50)))
        ids = codec.encode(text)
        assert ids == library.encode(text, add_special_tokens=False).ids, text
        assert codec.decode(ids) == library.decode(ids, skip_special_tokens=False) == text


def test_decode_of_broken_bytes(codec, library):
    rng = random.Random(2)
    for _ in range(500):
        ids = [rng.randrange(50257) for _ in range(rng.randint(0, 12))]
        assert codec.decode(ids) == library.decode(ids, skip_special_tokens=False)


def plain_merge(symbols, pairs):
    symbols = list(symbols)
    while True:
        found = [(pairs[a * bpe.PAIR + b], i) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if a * bpe.PAIR + b in pairs]
        if not found:
            return symbols
        (_, new), i = min(found, key=lambda x: (x[0][0], x[1]))
        symbols[i : i + 2] = [new]


def test_tree_against_scanning():
    rng = random.Random(3)
    pairs, new = {}, 4
    for rank in range(30):
        key = rng.randrange(new) * bpe.PAIR + rng.randrange(new)
        if key not in pairs:
            pairs[key] = (rank, new)
            new += 1
    for _ in range(500):
        symbols = [rng.randrange(4) for _ in range(rng.randint(0, 40))]
        assert bpe.merged(symbols, pairs) == plain_merge(symbols, pairs)


def test_rows_of_trees(codec):
    """Pieces merged together give what each gives alone, whatever their lengths and the table."""
    rng = random.Random(3)
    few = {a * bpe.PAIR + b: (rank, 256 + rank) for rank, (a, b) in enumerate([(97, 97), (256, 97), (97, 98), (98, 256), (256, 256), (257, 257), (98, 98), (260, 98)])}
    for pairs, ids in ((few, list(range(256))), ({}, list(range(256))), (codec.pairs, codec.byte_ids)):
        pieces = [bytes(rng.choice(b"ab" if rng.random() < 0.7 else b"abcthe \xc3\xa9") for _ in range(n)) for n in [1, 2, 3, 4, 5, 8, 9, 63, 64, 65, bpe.ROW_BYTES] + [rng.randint(1, 40) for _ in range(300)]]
        assert bpe.merged_rows(pieces, np.array(ids), bpe.Pairs(pairs)) == [tuple(bpe.merged([ids[b] for b in p], pairs)) for p in pieces]
    assert bpe.merged_rows([], np.array(codec.byte_ids), bpe.Pairs(codec.pairs)) == []


def test_new_pieces_are_merged_together(codec, library, monkeypatch):
    calls = []
    alone, rows = bpe.merged, bpe.merged_rows
    monkeypatch.setattr(bpe, "merged", lambda *a: calls.append(1) or alone(*a))
    monkeypatch.setattr(bpe, "merged_rows", lambda *a: calls.append(len(a[0])) or rows(*a))
    rng = random.Random(4)
    texts = [" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyzäß語") for _ in range(rng.randint(1, 12))) for _ in range(50)) for _ in range(60)] + ["", "x<|endoftext|>y", "q" * 999, "né" * bpe.TOGETHER]
    assert list(codec.encode_each(texts)) == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert sum(calls) > 2000 and len(calls) < 20


def test_long_piece_is_not_quadratic(codec, library):
    text = "ab" * 100_000
    assert codec.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_generations_of_pieces(codec, monkeypatch):
    want = [codec.encode(f"word{i} zq{i}x") for i in range(300)]
    monkeypatch.setattr(bpe, "KEPT_PIECES", 7)
    codec.fresh, codec.old = {}, {}
    assert [codec.encode(f"word{i} zq{i}x") for i in range(300)] == want


def test_frames(spark, library):
    texts = [None, "", "héllo  wörld", "héllo  wörld", "x" * 50_000, "a<|endoftext|>b"]
    docs = spark.createDataFrame([(i, x, 1, 2) for i, x in enumerate(texts)] + [(None, "z", 1, 2)], "doc_id long, text string, ids int, n_tokens int")
    got = {r["doc_id"]: r for r in bpe.encode(docs, bpe.vocabulary()).collect()}
    assert len(got) == len(texts) + 1
    for i, x in enumerate(texts):
        ids = library.encode(x or "", add_special_tokens=False).ids
        assert got[i]["ids"] == ids and got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((x or "").encode()).hexdigest()
    back = {r[0]: r[1] for r in bpe.decode(bpe.encode(docs, bpe.vocabulary()), bpe.vocabulary()).collect()}
    assert all(back[i] == (x or "") for i, x in enumerate(texts))
    assert bpe.encode(docs.where("false"), bpe.vocabulary()).count() == 0
