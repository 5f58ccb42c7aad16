"""Repeated passages against a count of every window."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import pytest

from clauseloom.llm import passage_dedup, queries
from tests.llm.conftest import ODD, SF


def brute(rows, length):
    data = [(t or "").encode() for _, t in rows]
    seen = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for (doc, _), b in zip(rows, data):
        gone = bytearray(len(b) + 1)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\x01" * length
        spans = sum(gone[i] and not gone[i + 1] for i in range(len(b)))
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((doc, len(b), sum(gone), spans, kept))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in df.collect()), key=str)


def mosaic(seed, count=60, length=40):
    """Texts of shared passages of all lengths around the limit, near copies, runs and periods."""
    rng = random.Random(seed)
    pool = ["".join(rng.choice("abcdé ") for _ in range(rng.choice([length // 2, length - 1, length, length + 1, 3 * length]))) for _ in range(12)]
    rows = []
    for i in range(count):
        parts = []
        for _ in range(rng.randrange(8)):
            x = rng.choice(pool)
            kind = rng.randrange(5)
            if kind == 0:
                x = "".join(rng.choice("abcdé ") for _ in range(rng.randrange(2 * length)))
            elif kind == 1:
                at = rng.randrange(len(x))
                x = x[:at] + "Z" + x[at + 1 :]
            elif kind == 2:
                x = rng.choice(["ab", "abc", "y"]) * rng.randrange(length)
            parts.append(x)
        rows.append((i, "".join(parts)))
    return rows


@pytest.mark.parametrize("seed", range(4))
def test_mosaics(docs, seed):
    rows = mosaic(seed)
    assert got(passage_dedup.remove_repeats(docs(*rows), 40)) == brute(rows, 40)


def test_small_segments(docs, monkeypatch):
    rows = mosaic(9, 40)
    monkeypatch.setattr(passage_dedup, "SEGMENT", 97)
    texts = [memoryview((t or "").encode()) for _, t in rows]
    for part in passage_dedup.anchors(texts, 40):
        row, a, least, most, *_ = part
        for r, at, lo, hi in zip(row, a, least, most):
            assert 0 <= at - hi <= at - lo <= len(texts[r]) - 40
    windows = Counter((r, w) for row, a, lo, hi, *_ in passage_dedup.anchors(texts, 40) for r, x, l, h in zip(row, a, lo, hi) for w in range(x - h, x - l + 1))
    assert windows == Counter((r, w) for r, t in enumerate(texts) for w in range(len(t) - 39))


@pytest.mark.parametrize("length", [40, 400])
def test_odd_rows(docs, length):
    assert got(passage_dedup.remove_repeats(docs(*ODD), length)) == brute(ODD, length)


def test_text_and_columns(docs):
    rows = [(1, "é" * 30 + "end"), (2, "x" + "é" * 30)]
    out = passage_dedup.remove_repeats(docs(*rows), 21, texts=True)
    assert set(out.columns) == {"doc_id", "cls", "n", "_id", "_tk", "_gone", "n_bytes", "n_removed", "n_spans", "text"}
    assert {r.text for r in out.collect()} == {"end", "x"}
    assert passage_dedup.remove_repeats(docs().limit(0)).count() == 0


def same_crc(text, other):
    """``other`` with some of its a's turned to q's, so that both texts have one crc32: a linear system over bits."""
    at = [i for i, c in enumerate(other) if c == "a"][:48]
    base = zlib.crc32(other.encode())
    rows = []  # (effect on the crc, letters turned)
    for k, i in enumerate(at):
        effect, turned = zlib.crc32((other[:i] + "q" + other[i + 1 :]).encode()) ^ base, 1 << k
        for e, t in rows:
            if effect ^ e < effect:
                effect, turned = effect ^ e, turned ^ t
        if effect:
            rows = sorted([*rows, (effect, turned)], reverse=True)
    want, turned = zlib.crc32(text.encode()) ^ base, 0
    for e, t in rows:
        if want ^ e < want:
            want, turned = want ^ e, turned ^ t
    assert want == 0
    return "".join("q" if i in at and turned >> at.index(i) & 1 else c for i, c in enumerate(other))


@pytest.mark.parametrize("doc_id", [None, 7])
def test_texts_of_one_id_and_one_crc(docs, doc_id):
    first = "passage that stands twice in this table of texts, " * 2 + "x" * 50
    second = same_crc(first, "y" * 33 + "another passage, found in one more text, of sixty letters..." + "a" * 64)
    assert first != second and zlib.crc32(first.encode()) == zlib.crc32(second.encode())
    rows = [(doc_id, first), (doc_id, second), (3, "-" + first[:100]), (4, "--" + second[33:93])]
    assert got(passage_dedup.remove_repeats(docs(*rows), 40)) == brute(rows, 40)


def test_query(spark, sf_docs):
    want = [(*x[:4], hashlib.sha256(x[4]).hexdigest()) for x in brute(list(zip(sf_docs.doc_id, sf_docs.text)), 400)]
    rows = queries.op8_passage_dedup(spark, SF).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows), key=str) == sorted(want, key=str)
