"""Byte-level BPE against the tiktoken library, and as a round trip."""

from __future__ import annotations

import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from clauseloom.llm import byte_bpe, queries
from tests.llm.conftest import ODD, SF


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(byte_bpe.RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def check(library, rows, frame):
    want = sorted(((i, library.encode_ordinary(t or ""), (t or "").encode()) for i, t in rows), key=str)
    assert sorted(((r.doc_id, list(r.ids), bytes(r.decoded)) for r in frame.collect()), key=str) == want


@pytest.mark.parametrize("chunk", [40, 32_768])
def test_odd_rows(docs, library, chunk):
    rows = [*ODD, (11, "<|endoftext|> isn't special"), (12, None)]
    check(library, rows, byte_bpe.decode(byte_bpe.encode(docs(*rows), chunk=chunk, overlap=24)))
    assert byte_bpe.encode(docs().limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_stitches(docs, library, seed):
    rng = random.Random(seed)
    bits = ["word", " word", "'ll", "'s", "  ", "\n\n", "   x", "12", "é", "漢字", "!!!", "don't", "\t", " ", "😀", "\u00a0"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randrange(200)))) for i in range(60)]
    rows += [(100, "a" * 500), (100, "a" * 500), (101, " " * 300 + "b"), (102, "ab " * 20 + "c" * 100 + " d" * 50)]
    check(library, rows, byte_bpe.decode(byte_bpe.encode(docs(*rows), chunk=50, overlap=30)))


def test_query(spark, library, sf_docs):
    want = []
    for i, t in zip(sf_docs.doc_id, sf_docs.text):
        ids = library.encode_ordinary(t)
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    assert sorted(map(tuple, queries.op10_byte_bpe(spark, SF).collect())) == sorted(want)
