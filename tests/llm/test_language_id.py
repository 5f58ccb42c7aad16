"""Language ID: held-out accuracy, odd rows, and the parts of the training."""

from __future__ import annotations

import zlib

import numpy as np
import pytest

from clauseloom.llm import language_id, queries
from tests.llm.conftest import ODD, SF


def test_query_accuracy(spark, sf_docs):
    rows = {r.doc_id: r for r in queries.op4_language_id(spark, SF).collect()}
    assert set(rows) == set(sf_docs.doc_id) and len(rows) == len(sf_docs)
    held = [i for i in sf_docs.doc_id if zlib.crc32(str(i).encode()) % 4 == 2]
    assert {i for i, r in rows.items() if r.held_out} == set(held)
    truth = dict(zip(sf_docs.doc_id, sf_docs.lang))
    assert np.mean([rows[i].lang_pred == truth[i] for i in held]) >= 0.95
    assert all(0 <= r.score <= 1 for r in rows.values())


def test_odd_rows(spark, docs):
    train = spark.createDataFrame([(i, t, l) for i in range(40) for t, l in ((f"the cat and the dog {i}", "en"), (f"der Hund und die Katze {i}", "de"))]
                                  + [(None, "x", "en"), (1, None, "de"), (2, "kein", None)], "doc_id long, text string, lang string")
    model = language_id.train(train)
    assert model.labels == ["de", "en"]
    rows = [*ODD, (11, "und die Katze"), (12, "and the cat"), (13, "123 !!! ???"), (14, "漢字")]
    df = docs(*rows).withColumnRenamed("cls", "score")
    out = language_id.predict(df, model)
    assert set(out.columns) == {"doc_id", "text", "score", "n", "lang_pred", "_id", "_tk", "_gone"}
    got = {(r.doc_id, r.text): (r.lang_pred, r.score) for r in out.collect()}
    assert len(out.collect()) == len(rows)
    assert got[11, "und die Katze"][0] == "de" and got[12, "and the cat"][0] == "en"
    for key in ((1, None), (2, ""), (3, " \n\t\n "), (13, "123 !!! ???")):
        assert got[key] == ("und", 0.0)
    assert got[14, "漢字"][0] in model.labels
    assert language_id.predict(df.limit(0), model).count() == 0


def test_nothing_to_learn(docs):
    df = docs((1, "some text"))
    model = language_id.train(df.selectExpr("doc_id", "text", "cast(null as string) as lang"))
    assert [(r.lang_pred, r.score) for r in language_id.predict(df, model).collect()] == [("und", 0.0)]


def test_long_text_counts_like_its_parts():
    text = "the quick brown fox " * 60_000
    at, n, _ = language_id.counts(text)
    one, m, _ = language_id.counts("the quick brown fox " * 6_000)
    assert set(at) == set(one) and np.allclose(n / 10, m, rtol=0.01)


@pytest.mark.parametrize("size", [1, 2, 3, 7, 50])
def test_cuts_change_no_count(monkeypatch, size):
    for text in ("inside a word, and  -- at a blank ", "x", " ", "", "12 ab", "ab 12", "a" * 20, "É漢字 " * 9):
        whole = [x.tolist() if hasattr(x, "tolist") else x for x in language_id.counts(text)]
        with monkeypatch.context() as m:
            m.setattr(language_id, "SLICE", size)
            assert [x.tolist() if hasattr(x, "tolist") else x for x in language_id.counts(text)] == whole


def test_penalty_and_temperature():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 400)
    rows = [(np.array([int(k), 5, 6 + rng.integers(50)]), np.array([1.0, 1.0, 0.3])) for k in y]
    w = language_id.Ftrl(l1=1.0).fit(rows, y, 2)
    assert w[0, 0] > 0 > w[0, 1] and (w[6:56] == 0).mean() > 0.9 and (w[60:] == 0).all()
    logits = np.stack([3 * (y == 0), 3 * (y == 1)], axis=1) * np.where(rng.random(400) < 0.8, 1, -1)[:, None]
    assert 1.5 < language_id.temperature(logits.astype(float), y) < 3.5
