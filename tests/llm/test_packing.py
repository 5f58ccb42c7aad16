"""Packing against the tokenizer itself and the rules of a packing."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from clauseloom.llm import packing, queries
from tests.llm.conftest import ODD, SF


def check(rows, out, length):
    tokenizer = Tokenizer.from_file(packing.TOKENIZER)
    tokenizer.encode_special_tokens = True
    want = []
    for doc, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        for k, i in enumerate(range(0, len(ids), length)):
            part = ids[i : i + length]
            want.append((doc, k, i, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted(want, key=str) == sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out), key=str)
    bins = defaultdict(list)
    for r in out:
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= length
    return len(bins), -(-sum(r.length for r in out) // length)


def test_odd_rows(docs):
    check(ODD, packing.pack(docs(*ODD), length=64).collect(), 64)
    assert packing.pack(docs().limit(0)).count() == 0


def test_words_are_cut_where_the_tokenizer_cuts():
    rng = random.Random(11)
    bits = ["a", "B", "é", "É", "1", ".", ",", "_", "'", "'s", "'LL", "-", "\u0301", "…", " ", "\n", "\t", "Σ", "İ", "ß", "<|endoftext|>", "\u00a0", "ª", "\x1c"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(40))) for _ in range(4000)]
    encoder = packing.WordEncoder(packing.TOKENIZER)
    for text, ids in zip(texts, encoder.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == [*encoder.tokenizer.encode(text, add_special_tokens=False).ids, 0], text


def test_tree_of_groups(docs, monkeypatch):
    monkeypatch.setattr(packing, "LOCAL_PIECES", 150)
    monkeypatch.setattr(packing, "CARRIED", 30)
    rng = random.Random(3)
    rows = [(i, " ".join("word" for _ in range(rng.randrange(70)))) for i in range(800)]
    used, least = check(rows, packing.pack(docs(*rows), length=64).collect(), 64)
    assert used <= 1.05 * least


def test_query(spark, sf_docs):
    used, least = check(list(zip(sf_docs.doc_id, sf_docs.text)), queries.op5_packing(spark, SF).collect(), 2048)
    assert used <= 1.02 * least + 1


@pytest.mark.parametrize("seed", range(5))
def test_best_fit(seed):
    rng = random.Random(seed)
    sizes = [rng.randrange(1, 100) for _ in range(300)]
    bins = packing.best_fit(sizes, 100)
    assert sorted(i for b in bins for i in b) == list(range(300))
    assert all(sum(sizes[i] for i in b) <= 100 for b in bins)
    assert sum(2 * sum(sizes[i] for i in b) <= 100 for b in bins) <= 1


def test_punctuation_is_cut_in_new_words_alone(monkeypatch):
    texts = ["Ab,c d. a.b", "x ab,c (d)", "...é, \x1c,y it's", "漢字,a ab,c", None, "a\u0301,b. ab,c"] * 3
    plain = Tokenizer.from_file(packing.TOKENIZER)
    want = [np.array([*plain.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes() for t in texts]
    encoder, cut = packing.WordEncoder(packing.TOKENIZER), []
    marks = packing._MARKS
    monkeypatch.setattr(packing, "_MARKS", type("Marks", (), {"sub": staticmethod(lambda by, text: cut.append(text) or marks.sub(by, text))}))
    assert list(encoder.encode(texts)) == want
    words = "\n".join(cut).split("\n")
    assert words and len(words) == len(set(words))  # each once, however often it stands in the texts
    known = len(encoder.known)
    monkeypatch.setattr(packing, "MARKED", 1)
    assert list(encoder.encode(texts)) == want and len(encoder.known) == known and len(cut) == 2  # forgotten, and learnt from their parts


def test_new_words_of_letters_share_a_text(monkeypatch):
    rng = random.Random(5)
    words = list({"".join(rng.choice("aeiouxzqbcdstéßñÿªµ") for _ in range(rng.randrange(1, 14))) for _ in range(3000)})
    encoder, asked = packing.WordEncoder(packing.TOKENIZER), []
    plain = encoder.tokenizer
    encode = lambda texts, **kw: asked.append(len(texts)) or plain.encode_batch_fast(texts, **kw)
    encoder.tokenizer = type("Counted", (), {"encode_batch_fast": staticmethod(encode)})
    encoder._learn(words)
    want = plain.encode_batch_fast(words, add_special_tokens=False)
    assert [encoder.known[w] for w in words] == [np.array(m.ids, "<u4").tobytes() for m in want]
    assert sum(asked) <= len(words) / 100
