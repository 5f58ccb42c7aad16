"""Packing under several limits against the tokenizer itself and the rules of a packing."""

from __future__ import annotations

import functools
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from clauseloom.llm import queries
from clauseloom.llm import vector_packing as vp
from tests.llm.conftest import ODD, SF


@functools.cache
def own_tokenizer():
    tokenizer = Tokenizer.from_file(vp.TOKENIZER)
    tokenizer.encode_special_tokens = True
    return tokenizer


@functools.cache
def ids_of(prompt, text):
    tokenizer = own_tokenizer()
    return [tokenizer.encode(x or "", add_special_tokens=False).ids for x in (prompt, text)]


def check(rows, out, limits):
    """Rows as (doc_id, text, prompt). The share of padding, and documents within the limits that were cut."""
    want = defaultdict(int)
    for doc, text, prompt in rows:
        before, after = ids_of(prompt, text)
        want[doc, tuple([*before, *after, 0]), len(before)] += 1
    by_doc, bins = defaultdict(list), defaultdict(list)
    for r in out:
        assert r.length > 0
        by_doc[r.doc_id].append(r)
        bins[r.sequence_id].append(r)
    used = 0
    for own in bins.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= limits.tokens and len(own) <= limits.segments and sum(r.loss_tokens for r in own) <= limits.loss
        used += at if at & (at - 1) == 0 else limits.tokens
    for (doc, ids, answer), times in want.items():
        left = [r for r in by_doc[doc] if r.doc_tokens == len(ids)]
        for _ in range(times):  # repeated documents: any chain of pieces that covers the ids
            at = 0
            while at < len(ids):
                r = next(r for r in left if r.start == at and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes()))
                assert r.loss_tokens == max(0, at + r.length - max(at, answer))
                left.remove(r)
                by_doc[doc].remove(r)
                at += r.length
    assert not any(by_doc.values())
    total = sum(len(ids) * n for (_, ids, _), n in want.items())
    cut = sum(r.length < r.doc_tokens <= limits.tokens for r in out)
    return (used - total) / max(total, 1), cut


def test_odd_rows(docs):
    limits = vp.Limits(64, 5, 50)
    padding, _ = check([(i, t, None) for i, t in ODD], vp.pack(docs(*ODD), limits).collect(), limits)
    assert padding < 0.4  # the limit on loss is below that on tokens
    assert vp.pack(docs().limit(0)).count() == 0


def test_all_cuts(docs):
    rng = random.Random(9)
    rows = [(i, "word " * rng.choice([1, 3, 20, 70, 500, 2500])) for i in range(700)]
    limits = vp.Limits(128, 100, 128)
    padding, _ = check([(i, t, None) for i, t in rows], vp.pack(docs(*rows).repartition(3), limits).collect(), limits)
    assert padding == 0


@pytest.mark.parametrize("keep_whole", [True, False])
def test_prompts(spark, keep_whole):
    rng = random.Random(2)
    rows = [(i, "yes " * rng.randrange(60), None if i % 7 == 0 else "why " * rng.randrange(90)) for i in range(400)]
    limits = vp.Limits(128, 6, 70)
    out = vp.pack(spark.createDataFrame(rows, "doc_id long, text string, prompt string"), limits, keep_whole=keep_whole).collect()
    padding, _ = check(rows, out, limits)
    assert padding < 0.25
    fit = {i for i, t, p in rows if sum(map(len, ids_of(p, t))) + 1 <= 128 and len(ids_of(p, t)[1]) + 1 <= 70}
    if keep_whole:
        assert all(r.length == r.doc_tokens for r in out if r.doc_id in fit)


def test_words_are_cut_where_the_tokenizer_cuts():
    rng = random.Random(11)
    bits = ["a", "B", "é", "1", ".", ",", "_", "'", "'s", "'LL", "-", "́", "…", " ", " ", " ", "\n", "\t", "<|endoftext|>", " ", "ª", "\x1c", "\x85", " ", "漢", "😀", "᠎", "​"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(40))) for _ in range(6000)]
    encoder = vp.BlankEncoder(vp.TOKENIZER)
    for text, ids in zip(texts, encoder.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_dot_product_mixes_demands():
    # long prompts with short answers and the other way round fit together only crosswise
    placer = vp.Placer(vp.Limits(100, 4, 50), keep_whole=True)
    placer.add([vp.Piece(i, 0, 50, 50) for i in range(6)] + [vp.Piece(i, 0, 50, 0) for i in range(6, 12)])
    assert [len(s) for s in placer.sequences(True)] == [2] * 6


def test_query(spark, sf_docs):
    rows = [(i, t, None) for i, t in zip(sf_docs.doc_id, sf_docs.text)]
    padding, cut = check(rows, queries.op12_vector_packing(spark, SF).collect(), vp.Limits())
    assert padding == 0 and cut <= 4


def test_limits_must_be_positive():
    with pytest.raises(ValueError):
        vp.Limits(tokens=0)
