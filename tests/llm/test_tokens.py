"""Token counts and BPE against the public libraries, and the edge rows."""

import hashlib
import random
import struct

import public_tokenizers
import pytest
import sentencepiece
import tokenizers

from parley.llm import bpe, tokencount

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")


def strings(n, seed=3):
    rnd = random.Random(seed)
    letters = [chr(i) for i in range(0x250)] + ["日", "😀", "　", "▁", "\x85", "\x1c", "ﬁ"]
    words = ["<s>", "<|endoftext|>", "<0x0A>", " ", "  ", "        ", "ing", "'ll", "1", "\n"] * 30
    pool = letters + words
    return ["".join(rnd.choices(pool, k=rnd.randrange(50))) for _ in range(n)]


@pytest.fixture(scope="module")
def pieces():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


@pytest.fixture(scope="module")
def byte_level():
    return tokenizers.Tokenizer.from_file(BYTES)


EDGES = [
    (1, None),
    (2, ""),
    (3, " "),
    (None, "no id"),
    (5, "same row"),
    (5, "same row"),
    (6, "a" * 5000 + " " * 900 + "é" * 300 + "word " * 4000),
    (6, "a" * 5000 + " " * 900 + "é" * 300 + "word " * 4000),
    (7, "x\n\n\ty <|endoftext|> z"),
]


def frame(spark, rows):
    # extra columns that clash with names the operators use inside
    rows = [(*r, 1, 2, "n", "p") for r in rows]
    return spark.createDataFrame(
        rows, "doc_id long, text string, key int, n_bytes int, name string, part string"
    )


def test_transducer_counts_as_the_library(pieces):
    counter = tokencount.Transducer(PIECES)
    texts = strings(1500) + ["ab" * 900, "=" * 700, " " * 333, "the the  the"]
    assert [counter.count(t) for t in texts] == [len(pieces.encode(t)) for t in texts]


def test_chunk_maps_compose_to_the_whole(pieces):
    counter = tokencount.Transducer(PIECES)
    rnd = random.Random(5)
    for text in filter(None, strings(300, seed=9)):
        whole, size = tokencount.spaced(text), rnd.randrange(1, 9)
        maps = [counter.chunk(whole[i : i + size]) for i in range(0, len(whole), size)]
        assert counter.close(counter.scan(maps)) == len(pieces.encode(text))


def test_full_caches_change_no_count(pieces, monkeypatch):
    monkeypatch.setattr(tokencount, "CACHED_STATES", 40)
    monkeypatch.setattr(tokencount, "CACHED_SEGMENTS", 3)
    counter = tokencount.Transducer(PIECES)
    texts = strings(200, seed=4)
    assert [counter.count(t) for t in texts] == [len(pieces.encode(t)) for t in texts]


@pytest.mark.parametrize("chunk", [7, 1000, tokencount.CHUNK])
def test_count_tokens_rows(spark, pieces, chunk):
    got = tokencount.count_tokens(frame(spark, EDGES), PIECES, chunk=chunk).collect()
    want = [(i, len((t or "").encode()), len(pieces.encode(t or ""))) for i, t in EDGES]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_empty_tables(spark):
    empty = frame(spark, EDGES).limit(0)
    assert tokencount.count_tokens(empty, PIECES).collect() == []
    assert bpe.round_trip(empty, BYTES).collect() == []


def test_codec_encodes_as_the_library(byte_level):
    codec = bpe.Codec(BYTES)
    for text in strings(1500) + ["ab" * 900, "a" * 4000, "é" * 300]:
        ids = byte_level.encode(text, add_special_tokens=False).ids
        assert codec.encode(text) == struct.pack(f"<{len(ids)}I", *ids)
        assert codec.decode(codec.encode(text)) == byte_level.decode(ids, skip_special_tokens=False)


def test_decode_broken_bytes(byte_level):
    codec = bpe.Codec(BYTES)
    ids = byte_level.encode("é😀", add_special_tokens=False).ids[:-1]
    packed = struct.pack(f"<{len(ids)}I", *ids)
    assert codec.decode(packed) == byte_level.decode(ids, skip_special_tokens=False)


def test_round_trip_rows(spark, byte_level):
    got = bpe.round_trip(frame(spark, EDGES), BYTES).collect()
    want = []
    for key, text in EDGES:
        ids = byte_level.encode(text or "", add_special_tokens=False).ids
        packed = struct.pack(f"<{len(ids)}I", *ids)
        back = byte_level.decode(ids, skip_special_tokens=False).encode()
        digests = (hashlib.sha256(packed).hexdigest(), hashlib.sha256(back).hexdigest())
        want.append((key, len(ids), *digests))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_encode_then_decode(spark):
    tokens = bpe.encode(frame(spark, EDGES), BYTES)
    back = {(r.doc_id, r.text) for r in bpe.decode(tokens, BYTES).collect()}
    assert back == {(i, t or "") for i, t in EDGES}
