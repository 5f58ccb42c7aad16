"""Hard negatives against all inner products."""

from __future__ import annotations

import numpy as np
import pytest

from clauseloom.llm import hard_negatives as hn
from clauseloom.llm import queries
from tests.llm.conftest import SF

SHAPE = "vec_id long, embedding array<double>, label int, cell int, n string"


def brute(rows, anchors, least=80, k=5, m=5):
    """Rows as (id, vector, label); Python's whole numbers throughout."""
    own = []
    for i, v, label in rows:
        if i is None or label is None or not v or any(x is None or not np.isfinite(x) for x in v):
            continue
        own.append((i, [int(np.floor(256.0 * x)) for x in v], label))
    out = []
    for a, va, la in {(i, tuple(v), label) for i, v, label in own if anchors(i)}:
        scored = sorted((-sum(x * y for x, y in zip(va, v)), i, label) for i, v, label in own if len(v) == len(va) and i != a)
        for s, p, _ in [x for x in scored if x[2] == la][:k]:
            fit = [(n, -t) for t, n, label in scored if label != la and least * -s <= 100 * -t <= 100 * -s]
            out += [(a, p, r + 1, n, -s, t) for r, (n, t) in enumerate(fit[:m])]
    return sorted(out)


def result(df):
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def build(spark, rows):
    return spark.createDataFrame([(i, v, label, 1, "x") for i, v, label in rows], SHAPE)


@pytest.mark.parametrize("kind", ["even", "clusters", "norms", "copies"])
def test_against_all_products(spark, monkeypatch, kind):
    for name, value in {"BLOCK": 40, "GROUP": 7, "TILE": 2, "LEAF": 8, "FITTED": 64}.items():
        monkeypatch.setattr(hn, name, value)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(500, 6))
    if kind != "even":
        x = rng.normal(size=(8, 6))[rng.integers(0, 8, 500)] + 0.05 * x
    if kind == "norms":
        x *= np.exp(rng.normal(size=(500, 1)))
    if kind == "copies":
        x = np.round(x, 1)
        x[:200] = x[0]
    rows = [(i, v.tolist(), int(rng.integers(0, 3))) for i, v in enumerate(x)]
    want = brute(rows, lambda i: i % 10 == 0)
    assert len(want) > 500
    assert result(hn.mine(build(spark, rows), "vec_id % 10 = 0")) == want


def test_odd_rows(spark):
    big, nan, inf = 1e6, float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0], 1), (10, [0.0, 0.0], 1), (1, [1.0, 0.5], 1), (2, [0.9, 0.0], 2), (3, None, 1), (4, [1.0, None], 1), (5, [nan, 1.0], 2), (6, [inf, 0.0], 2),
        (7, [], 1), (8, [1.0], 2), (20, [1.0], 2), (21, [2.0], 2), (22, [1.9], 3), (None, [1.0, 0.0], 2), (9, [1.0, 0.0], None), (11, [-1.0, 0.2], 2),
        (2, [0.9, 0.0], 2), (0, [1.0, 0.0], 1), (30, [big, big], 5), (31, [big, big - 1], 5), (32, [big - 2, big], 6), (40, [1.0, 1.0], 99), (12, [-0.001, 0.001], 1),
    ]
    found = result(hn.mine(build(spark, rows), "vec_id % 10 = 0"))
    assert found == brute(rows, lambda i: i % 10 == 0)
    assert any(r[0] == 30 for r in found) and any(r[0] == 20 for r in found)
    assert hn.mine(build(spark, rows).limit(0), "vec_id % 10 = 0").count() == 0
    assert hn.mine(build(spark, rows), "vec_id < 0").count() == 0
    assert hn.mine(build(spark, [(0, [1e300, 0.0], 1), (1, [1e300, 1.0], 1)]), "vec_id % 10 = 0").count() == 0


def test_tree_covers_its_rows_and_prunes():
    rng = np.random.default_rng(1)
    rows = np.floor(256 * (rng.normal(size=(20, 16))[rng.integers(0, 20, 3000)] + 0.02 * rng.normal(size=(3000, 16))))
    top = np.sqrt((rows * rows).sum(axis=1)).max()
    tree = hn.Tree(rows, top)
    unit = hn.on_sphere(tree.rows, top)
    for centre, radius, (a, b), kids in zip(tree.centres, tree.radii, tree.ranges, tree.children):
        assert (np.arccos(np.clip(unit[a:b] @ centre, -1, 1)) <= radius + 1e-6).all()
        if kids:
            assert [tree.ranges[k][0] for k in kids[1:]] == [tree.ranges[k][1] for k in kids[:-1]]
            assert (tree.ranges[kids[0]][0], tree.ranges[kids[-1]][1]) == (a, b)
    compared = []
    group = hn.Anchors(rows[:5], np.arange(5), np.zeros(5, int), np.full((5, 1), hn.NONE), np.full((5, 1), hn.EVERY), True, 3)
    group.verify = lambda some, own, *rest, plain=group.verify: (compared.append(len(some) * len(own)), plain(some, own, *rest))
    hn.search(tree, np.arange(3000), np.zeros(3000, int), group)
    assert sum(compared) < 5 * 3000 / 3


def test_query(spark):
    rows = [(r.vec_id, list(r.embedding), (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert result(queries.op11_hard_negatives(spark, SF)) == brute(rows, lambda i: i % 100 == 0)
