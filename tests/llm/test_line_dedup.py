"""Line dedup against a plain count over lines."""

from __future__ import annotations

import hashlib
from collections import Counter

import pytest

from clauseloom.llm import line_dedup, queries
from clauseloom.llm.shared import Scratch
from tests.llm.conftest import ODD, SF

STRIP = "".join(map(chr, [0x20, *range(9, 14)]))


def brute(rows, min_docs):
    def lower(s):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)

    split = [(i, (t or "").split("\n")) for i, t in rows]
    keys = [[lower(x.strip(STRIP)) for x in lines] for _, lines in split]
    seen = Counter(k for own in keys for k in set(own) if k)
    out = []
    for (i, lines), own in zip(split, keys):
        left = [x for x, k in zip(lines, own) if not (k and seen[k] >= min_docs)]
        out.append((i, len(lines), len(lines) - len(left), "\n".join(left)))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in df.collect()), key=str)


@pytest.mark.parametrize("min_docs", [1, 2, 3])
@pytest.mark.parametrize("joined", [False, True])
def test_odd_rows(docs, monkeypatch, min_docs, joined):
    if joined:
        monkeypatch.setattr(line_dedup, "BROADCAST_KEYS", 0)
    rows = ODD + [(20 + i, f" Hot line \nown {i}\nHOT LINE\n\nhalf" if i % 2 else f"hot line\t\nother {i}") for i in range(12)]
    assert got(line_dedup.dedup_lines(docs(*rows), min_docs)) == brute(rows, min_docs)


def test_keeps_columns_and_empty(docs):
    out = line_dedup.dedup_lines(docs((1, "a")), 2)
    assert set(out.columns) == {"doc_id", "text", "cls", "n", "_id", "_tk", "_gone", "n_lines", "n_dropped"}
    assert line_dedup.dedup_lines(docs().limit(0), 2).count() == 0


def test_compaction_keeps_counts(spark):
    scratch = Scratch(spark, "t")
    runs = line_dedup.LineRuns(scratch, min_docs=3, fanout=2)
    want = Counter()
    for i in range(7):
        rows = [(k, k, n) for k in range(6) if (n := (k * (i + 1)) % 3)]
        want.update({k: n for k, _, n in rows})
        runs.add(scratch.keep(spark.createDataFrame(rows, "h1 long, h2 long, n long"), f"in-{i}"), f"in-{i}")
    assert runs.settled
    found = [r.h1 for r in runs.frequent().collect()]
    assert sorted(found) == sorted(k for k, n in want.items() if n >= 3)


def test_query(spark, sf_docs):
    want = brute(list(zip(sf_docs.doc_id, sf_docs.text)), 10)
    rows = queries.op9_line_dedup(spark, SF).collect()
    have = sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in rows), key=str)
    assert have == [(a, b, c, hashlib.sha256(d.encode()).hexdigest()) for a, b, c, d in want]
