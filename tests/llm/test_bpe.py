"""Ids equal those of a public tokenizer library over whole texts; decoding gives the bytes back."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from wtel.llm import bpe, queries
from wtel.llm.common import ranks_path


@pytest.fixture(scope="module")
def whole():
    import public_tokenizers
    import tiktoken

    ranks = bpe.read_ranks(ranks_path())
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


ALPHABET = "ab'sretvlmd  \n\t\r.!?19²½é\x1c\x85 　世界\U0001f600́​_ⅣſSx"


def random_text(rng, most):
    return "".join(rng.choice(ALPHABET) for _ in range(rng.randrange(most)))


def test_pieces_and_merges(whole):
    rng = random.Random(5)
    texts = [random_text(rng, 60) for _ in range(5000)]
    assert bpe.tokenizer(ranks_path()).encode(texts).to_pylist() == [whole.encode_ordinary(t) for t in texts]


def test_every_character(whole):
    points = [chr(p) for p in (*range(0xD800), *range(0xE000, 0x20000))]
    texts = [f"{c}a {c}{c} 1{c}" for c in points]
    assert bpe.tokenizer(ranks_path()).encode(texts).to_pylist() == [whole.encode_ordinary(t) for t in texts]


def test_long_pieces(whole):
    rng, ranks = random.Random(6), bpe.read_ranks(ranks_path())
    for _ in range(50):
        piece = "".join(rng.choice("abcdeéñü") for _ in range(rng.randrange(101, 400)))
        assert bpe.merged(piece.encode(), ranks) == whole.encode_ordinary(piece)
    assert len(bpe.merged(b"a" * 100_000, ranks)) < 100_000


@pytest.mark.parametrize(("chunk", "overlap"), [(300, 40), (200, 6), (64, 64)])
def test_chunks_are_stitched(spark, whole, chunk, overlap):
    rng = random.Random(chunk)
    texts = [random_text(rng, 3000) for _ in range(60)] + ["a" * 5000, " " * 700 + "x", "\n \n" * 400, "don't " * 300]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.ids for r in bpe.encode(docs, ranks_path(), chunk, overlap).collect()}
    assert got == {i: whole.encode_ordinary(t) for i, t in enumerate(texts)}


def test_query(spark, whole, documents):
    got = {r.doc_id: r for r in queries.op2_byte_bpe(spark, "/root/testdata/sf0.001").collect()}
    rows = documents.collect()
    assert len(got) == len(rows)
    for r in rows:
        ids = whole.encode_ordinary(r.text or "")
        found = got[r.doc_id]
        assert found.n_tokens == len(ids)
        assert found.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert found.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()


def test_odd_rows(odd, none, whole):
    rows = odd.collect()
    out = bpe.decode(bpe.encode(odd, ranks_path()), ranks_path()).collect()
    want = sorted((r.doc_id or 0, r.text or "") for r in rows)
    assert sorted((r.doc_id or 0, bytes(r.decoded).decode()) for r in out) == want
    assert sorted(r.n_tokens for r in out) == sorted(len(whole.encode_ordinary(r.text or "")) for r in rows)
    assert bpe.decode(bpe.encode(none, ranks_path()), ranks_path()).count() == 0


def test_decode_nothing():
    packed, decoded = bpe.tokenizer(ranks_path()).decode(pa.array([[], []], bpe.IDS))
    assert packed.to_pylist() == decoded.to_pylist() == [b"", b""]
