"""Vector search against brute force: recall, exact scores and order."""

from __future__ import annotations

import numpy as np
import pytest

from clauseloom.llm import queries, vector_search
from tests.llm.conftest import SF


def compare(ids, x, query_ids, got, k):
    """Recall; scores and order must be right for what was found."""
    x, ids = np.asarray(x, float), np.asarray(ids)
    hits = total = 0
    by_query = {}
    for r in got:
        by_query.setdefault(r.query_id, []).append(r)
    for q in query_ids:
        own = sorted(by_query.get(q, []), key=lambda r: r.rank)
        scores = x @ x[np.flatnonzero(ids == q)[0]]
        others = np.flatnonzero(ids != q)
        best = others[np.lexsort((ids[others], -scores[others]))][:k]
        assert [r.rank for r in own] == list(range(1, len(best) + 1))
        assert [(r.score, -r.vec_id) for r in own] == sorted(((r.score, -r.vec_id) for r in own), reverse=True)
        at = {i: s for i, s in zip(ids, scores)}
        assert all(abs(r.score - at[r.vec_id]) < 1e-12 * max(1, abs(r.score)) for r in own) and q not in {r.vec_id for r in own}
        hits += len({r.vec_id for r in own} & set(ids[best].tolist()))
        total += len(best)
    return hits / max(1, total)


def frame(spark, ids, x):
    return spark.createDataFrame([(int(i), None if v is None else [float(c) for c in v], 1) for i, v in zip(ids, x)], "vec_id long, embedding array<float>, score int")


@pytest.mark.parametrize("kind", ["clusters", "random", "copies"])
def test_recall(spark, monkeypatch, kind):
    monkeypatch.setattr(vector_search, "PER_LIST", 150)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 24)) * rng.uniform(0.5, 2, (3000, 1))
    if kind == "clusters":
        x = x * 0.3 + rng.normal(size=(10, 24))[rng.integers(0, 10, 3000)]
    if kind == "copies":
        x[:1200] = x[0]
    x = x.astype(np.float32)
    ids = rng.permutation(6000)[:3000]
    df = frame(spark, ids, x)
    got = vector_search.neighbours(df, df.where("vec_id % 40 = 0"), 20).collect()
    assert compare(ids, x, [i for i in ids if i % 40 == 0], got, 20) >= 0.93


def test_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [3.0, 1.0]), (6, [3.0, 1.0]), (7, [1.0, None]), (8, [-1.0, 0.0]), (9, [1.0, 1.0, 1.0])]
    df = spark.createDataFrame([*rows, (None, [1.0, 1.0])], "vec_id long, embedding array<float>")
    got = sorted(map(tuple, vector_search.neighbours(df, df.where("vec_id in (0, 5, 1, 9)"), 20).collect()))
    assert got == [(0, 1, 5, 5.0), (0, 2, 6, 5.0), (0, 3, 8, -1.0), (5, 1, 6, 10.0), (5, 2, 0, 5.0), (5, 3, 8, -3.0)]
    assert vector_search.neighbours(df.limit(0), df, 3).count() == 0
    assert vector_search.neighbours(df, df.limit(0), 3).count() == 0


def test_query(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    ids, x = [r.vec_id for r in rows], [list(r.embedding) for r in rows]
    got = queries.op6_vector_search(spark, SF).collect()
    assert compare(ids, x, [i for i in ids if i % 20 == 0], got, 20) >= 0.95
