"""Toxicity: the index against brute force, held-out accuracy, odd rows."""

from __future__ import annotations

import random
import re
import zlib

import numpy as np
import pytest

from clauseloom.llm import queries, toxicity
from tests.llm.conftest import ODD, SF


@pytest.mark.parametrize("seed", range(4))
def test_index_is_exact(seed):
    rng = np.random.default_rng(seed)

    def some():
        at = np.sort(rng.choice(30, rng.integers(1, 6), replace=False))
        x = rng.choice([0.5, 1.0, 2.0], len(at))
        return at, x / np.sqrt(x @ x)

    rows = [some() for _ in range(700)]
    dense = np.zeros((700, 30))
    for i, (at, x) in enumerate(rows):
        dense[i, at] = x
    index = toxicity.BlockMaxIndex(30, rows, block=16)
    for _ in range(60):
        at, x = some()
        q = np.zeros(30)
        q[at] = x
        cosine = np.round(dense @ q, 12)
        want = [i for i in np.lexsort((np.arange(700), -cosine)) if cosine[i] > 0][:25]
        ids, scores = index.nearest(at, x, 25)
        assert ids.tolist() == want and np.allclose(scores, cosine[want])


@pytest.mark.parametrize("seed", range(4))
def test_products_are_exact(seed, monkeypatch):
    """Many queries at once against brute force: groups, matrices, single postings, ties and examples left out."""
    monkeypatch.setattr(toxicity, "SUMMED", 500)
    rng = np.random.default_rng(seed)

    def some(language):
        at = np.unique(np.minimum(rng.zipf(1.3, rng.integers(1, 40)), 150) - 1 + 150 * language)
        at = np.union1d(at, rng.choice(300, 1))
        x = rng.choice([0.5, 1.0, 2.0], len(at))
        return at, x / np.sqrt(x @ x)

    rows = [some(i % 2) for i in range(700)]
    rows[1::7] = rows[0::7]  # equal examples
    dense = np.zeros((700, 300))
    for i, (at, x) in enumerate(rows):
        dense[i, at] = x
    index = toxicity.BlockMaxIndex(300, rows)
    products = toxicity.Products(index, toxicity.grouped(index))
    assert products.n_groups > 1 and any(len(m) for m in products.matrices)
    queries = [some(i % 2) for i in range(40)] + rows[:20]
    for skip in (None, [*range(690, 700)] * 4 + [*range(20)]):
        for i, (ids, scores) in enumerate(products.nearest(queries, 25, skip)):
            q = np.zeros(300)
            q[queries[i][0]] = queries[i][1]
            cosine = np.round(dense @ q, 12)
            if skip:
                cosine[skip[i]] = 0
            want = [k for k in np.lexsort((np.arange(700), -cosine)) if cosine[k] > 0][:25]
            assert ids.tolist() == want and np.allclose(scores, cosine[want], rtol=0, atol=1e-12)
    few = toxicity.BlockMaxIndex(300, rows[:9])
    assert [len(ids) for ids, _ in toxicity.Products(few, toxicity.grouped(few)).nearest(rows[:1], 25)] == [int((dense[:9] @ dense[0] > 0).sum())]


def test_words_are_runs_of_letters():
    every = "".join(chr(c) for c in [*range(0xD800), *range(0xE000, 0x110000)])
    assert toxicity.words_of(every) == re.findall(r"[^\W\d_]+", every.lower()) and toxicity.words_of(None) == []


def corpus(n=600):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("bcdfg") + rng.choice("aeiou") for _ in range(rng.randrange(1, 4)))
    rows, labels = [], []
    for i in range(n):
        toxic = i % 5 == 0
        words = [word() for _ in range(rng.randrange(20, 60))]
        if toxic:
            words[rng.randrange(20)] = rng.choice(["zounds", "vexxed" + word()])
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_learns_words_and_beginnings(spark, docs):
    rows, labels = corpus()
    marked = spark.createDataFrame([*labels[:400], (None, 1), (7, None), (10**6, 1)], "doc_id long, toxic int")
    df = docs(*rows)
    out = toxicity.score(df, toxicity.train(df, marked)).collect()
    assert set(out[0].asDict()) == {"doc_id", "cls", "n", "score", "predicted", "neighbours", "cosines"}
    got = {r.doc_id: r for r in out}
    assert all(got[i].predicted == y for i, y in labels[400:])
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    assert got[500].neighbours and dict(labels)[got[500].neighbours[0]] == 1


def test_every_text_with_a_known_word_meets_its_nearest_examples(spark, docs):
    rows, labels = corpus(300)
    model = toxicity.train(docs(*rows), spark.createDataFrame(labels[:200], "doc_id long, toxic int"))
    texts = dict(rows)
    known = set().union(*(toxicity.terms_of(texts[i]) for i in range(200)))
    assert set(model.terms) == known and sorted(model.ids.tolist()) == list(range(200))
    dense = {i: np.zeros(len(known)) for i in texts}
    for i, text in rows:
        at, x = toxicity.vector(text, model.finder, model.idf)
        dense[i][at] = x
    for r in toxicity.score(docs(*rows[200:]), model).collect():
        cosine = {i: round(float(dense[i] @ dense[r.doc_id]), 12) for i in range(200)}
        assert r.neighbours == sorted(range(200), key=lambda i: (-cosine[i], i))[:3]
        assert np.allclose(r.cosines, [cosine[i] for i in r.neighbours])


def test_postings_reach_the_driver_in_slices(spark, docs, monkeypatch):
    rows, labels = corpus(300)
    marked = spark.createDataFrame(labels, "doc_id long, toxic int")
    whole = toxicity.train(docs(*rows), marked)
    taken, frame = [], type(marked)
    collect = frame.toArrow
    monkeypatch.setattr(frame, "toArrow", lambda df: taken.append((df.columns, collect(df))) or taken[-1][1])
    monkeypatch.setattr(toxicity, "SLICE", 500)
    model = toxicity.train(docs(*rows), marked)
    assert not any("list" in str(kind) for _, table in taken for kind in table.schema.types)
    sizes = [len(table) for columns, table in taken if columns == ["at", "id", "tf"]]
    assert len(sizes) > 2 and max(sizes) <= max(500, model.index.counts.max()) and sum(sizes) == model.index.counts.sum()
    assert model.index.ids.itemsize == 2 and model.index.weights[0].itemsize == 1  # what is sent of a posting
    for made in (model, whole):
        made.index._index()
    assert (model.index.ids == whole.index.ids).all() and np.allclose(model.index.weights, whole.index.weights)
    # the postings as the vectors of the examples give them
    texts = dict(rows)
    plain = toxicity.BlockMaxIndex(len(model.idf), [toxicity.vector(texts[i], model.finder, model.idf) for i in model.ids.tolist()])
    assert (plain.ids == model.index.ids).all() and (plain.counts == model.index.counts).all() and np.allclose(plain.weights, model.index.weights)


def test_odd_rows(spark, docs):
    rows, labels = corpus(200)
    model = toxicity.train(docs(*rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    out = toxicity.score(docs(*ODD), model).collect()
    assert len(out) == len(ODD) and all(r.predicted == 0 and 0 <= r.score < 0.5 for r in out)
    assert toxicity.score(docs(*ODD).limit(0), model).count() == 0


def test_no_labels(spark, docs):
    df = docs(*ODD)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.train(df, none) is None
    assert {r.score for r in toxicity.score(df, None).collect()} == {0.0}
    one = toxicity.train(df, spark.createDataFrame([(4, 1)], "doc_id long, toxic int"))
    assert all(0 <= r.score <= 1 for r in toxicity.score(df, one).collect())


def test_query(spark, sf_docs):
    rows = queries.op1_toxicity(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(sf_docs.doc_id)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
