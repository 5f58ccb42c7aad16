"""Connected components against union-find."""

from __future__ import annotations

import random

import pytest

from clauseloom.llm.graph import components
from clauseloom.llm.shared import Scratch


def brute(pairs):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {x: find(x) for x in root}


@pytest.mark.parametrize("kind", ["random", "path", "star", "odd"])
def test_components(spark, kind):
    rng = random.Random(3)
    pairs = {
        "random": [(rng.randrange(300), rng.randrange(300)) for _ in range(220)], "path": [(i, i + 1) for i in range(40)],
        "star": [(50, i) for i in range(200)], "odd": [(1, 1), (None, 2), (3, None), (4, 5), (5, 4), (4, 5), (9, 5)],
    }[kind]
    rng.shuffle(pairs)
    frame = spark.createDataFrame(pairs, "a long, b long")
    got = [tuple(r) for r in components(Scratch(spark, "t"), frame).collect()]
    assert len(got) == len(set(got)) and dict(got) == brute(pairs)


def test_no_links(spark):
    assert components(Scratch(spark, "t"), spark.createDataFrame([], "a long, b long")).count() == 0
