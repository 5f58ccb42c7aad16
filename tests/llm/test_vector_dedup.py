"""Near-duplicate vectors against all pairs."""

from __future__ import annotations

import math

import numpy as np
import pytest

from clauseloom.llm import queries, vector_dedup
from tests.llm.conftest import SF


def brute(rows, cosine):
    good = [v is not None and len(v) > 0 and None not in v and all(map(math.isfinite, v)) and any(v) for _, v in rows]
    unit = [np.array(v, float) / np.linalg.norm(v) if g else None for (_, v), g in zip(rows, good)]
    n, root, links = len(rows), list(range(len(rows))), [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if good[i] and good[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= cosine:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    return sorted(((k, links[i], least.get(find(i))) for i, (k, _) in enumerate(rows)), key=str)


def got(df):
    rows = df.collect()
    assert all(r.kept == (r.vec_id == r.component_id) for r in rows)
    return sorted(((r.vec_id, r.n_links, r.component_id) for r in rows), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, n int")


def clouds(seed, n=260, dim=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    x = centres[rng.integers(0, 12, n)] + rng.normal(size=(n, dim)) * rng.choice([0.02, 0.2, 0.6, 1.5], (n, 1))
    x = np.concatenate([x, np.repeat(x[:2], 40, axis=0), 3 * x[:20]]).astype(np.float32)
    return [(i, v.tolist()) for i, v in enumerate(x)]


@pytest.mark.parametrize("block", [16, 4096])
def test_clouds(spark, block):
    rows = clouds(block)
    assert got(vector_dedup.near_vectors(frame(spark, rows), block=block)) == brute(rows, 0.9)


def test_odd_rows(spark):
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [1.0, 0.0]),
            (8, [2.0, -0.0]), (8, [2.0, 0.0]), (9, [1.0, 0.0, 0.0]), (None, [1.0, 0.01]), (10, [-1.0, 0.0]), (11, [1e-30, 0.0]), (12, [1e30, 0.0])]
    assert got(vector_dedup.near_vectors(frame(spark, rows))) == brute(rows, 0.9)
    assert vector_dedup.near_vectors(frame(spark, rows).limit(0)).count() == 0


def test_dual_traversal_finds_all():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(900, 3))
    x = np.concatenate([x, np.repeat(x[:1], 200, axis=0) + 1e-3 * rng.normal(size=(200, 3))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    a, b = vector_dedup.CoverTree(x[:700]), vector_dedup.CoverTree(x[700:])
    assert a.nodes[0][4] and sorted(a.order) == list(range(700))
    i, j = vector_dedup.linked(a, b, 0.9)
    assert set(zip(a.order[i], b.order[j])) == set(zip(*np.nonzero(x[:700] @ x[700:].T >= 0.9)))
    i, j = vector_dedup.linked(a, a, 0.9)
    assert {tuple(sorted(p)) for p in zip(a.order[i], a.order[j])} == {(p, q) for p, q in zip(*np.nonzero(x[:700] @ x[:700].T >= 0.9)) if p < q}
    assert len(i) == len({tuple(sorted(p)) for p in zip(i, j)})


def test_query(spark):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert got(queries.op2_vector_dedup(spark, SF)) == brute(rows, 0.9)
