"""Spelling variants against all pairs of words."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from clauseloom.llm import queries, spelling
from tests.llm.conftest import ODD, SF


def count(rows, slips, least=5, often=3):
    total = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{word}".encode())
            if slips and h % slips == 0:
                at = h % len(word)
                word = word[:at] + word[at + 1 :]
            total[word] += 1
    return {w: n for w, n in total.items() if len(w) >= least and n >= often}


def edits(word, letters):
    out = {word[:i] + word[i + 1 :] for i in range(len(word))}
    out |= {word[:i] + c + word[i:] for i in range(len(word) + 1) for c in letters}
    out |= {word[:i] + c + word[i + 1 :] for i in range(len(word)) for c in letters}
    return out - {word}


def one_apart(a, b):
    a, b = sorted((a, b), key=len)
    if len(b) - len(a) > 1 or a == b:
        return False
    at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[at + (len(a) == len(b)) :] == b[at + 1 :]


def brute(counts):
    letters = set("".join(counts))
    forms, out = {}, {}
    for w, n in counts.items():
        others = (x for x in counts if one_apart(w, x)) if len(w) > 20 else edits(w, letters)
        near = sorted((-counts[x], x) for x in others if x in counts)
        form = near[0] if near and -near[0][0] >= 2 * n else None
        forms[w] = form[1] if form else None
        out[w] = [n, len(near), forms[w], -form[0] if form else None]
    for w in out:
        root = w
        while forms[root] is not None:
            root = forms[root]
        out[w].append(root)
    return {w: tuple(v) for w, v in out.items()}


def result(df):
    rows = df.select("word", "n", "n_near", "form", "form_n", "root").collect()
    assert len(rows) == len({r.word for r in rows})
    return {r.word: tuple(r)[1:] for r in rows}


@pytest.mark.parametrize("small", [False, True])
def test_random_words(spark, monkeypatch, small):
    if small:  # deep upper tries, tries of equal counts over several parts, many turns
        for name, value in {"TRIE": 8, "LOOKING": 11, "LEAF": 3, "AT_ONCE": 50}.items():
            monkeypatch.setattr(spelling, name, value)
    rng = random.Random(4)
    words = {"".join(rng.choice("abé×z") for _ in range(rng.randrange(3, 8))): rng.randrange(1, 40) for _ in range(900)}
    words |= {"".join(rng.sample("aabbez", 6)): rng.randrange(1, 9) for _ in range(100)}
    words |= {"x" * 300: 5, "x" * 301: 50, "x" * 300 + "y": 1, "x" * 302: 200}
    assert result(spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long"))) == brute(words)


def test_odd_rows(spark, docs):
    made = spelling.words(docs(*ODD), least=1, often=1, slips=3)
    assert {r.word: r.n for r in made.collect()} == count(ODD, 3, 1, 1)
    assert {r.word: r.n for r in spelling.words(docs(*ODD), 5, 3).collect()} == count(ODD, None)
    assert result(spelling.variants(made)) == brute(count(ODD, 3, 1, 1))
    assert spelling.variants(spelling.words(docs().limit(0))).count() == 0
    odd = spark.createDataFrame([(None, 3), ("alpha", None), ("alpha", 2), ("alpha", 3), ("alpah", 1), ("alphas", 10), ("alphb", 10)], "word string, n long")
    assert result(spelling.variants(odd)) == brute({"alpha": 5, "alpah": 1, "alphas": 10, "alphb": 10})


def test_one_edit():
    pairs = [("abc", "abc", False), ("abc", "abd", True), ("abc", "ab", True), ("abc", "bc", True), ("abc", "ac", True), ("abc", "acb", False), ("abc", "abcde", False),
             ("aab", "ab", True), ("", "a", True), ("", "", False), ("aaaa", "aaa", True), ("abab", "baba", False)]
    a, b, want = ([x.encode() if isinstance(x, str) else x for x in column] for column in zip(*pairs))
    a, b, every = spelling.Spelled(a), spelling.Spelled(b), np.arange(len(want))
    assert spelling.one_edit(a, b, every, every).tolist() == want == spelling.one_edit(b, a, every, every).tolist()
    assert [spelling._one_edit(x, y) for x, y in zip(a.words, b.words)] == want


def test_query(spark, sf_docs):
    want = brute(count(list(zip(sf_docs.doc_id, sf_docs.text)), 97))
    assert sum(v[2] is not None for v in want.values()) > 20
    assert result(queries.op13_spelling_variants(spark, SF)) == want
