"""Near-duplicates against all pairs."""

from __future__ import annotations

import random
import re

import pyarrow as pa
import pytest

from clauseloom.llm import near_dedup, queries
from tests.llm.conftest import ODD, SF


def shingle_set(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute(rows):
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    return sorted(((k, len(s), least.get(find(i))) for i, ((k, _), s) in enumerate(zip(rows, sets))), key=str)


def got(df):
    rows = df.collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in rows), key=str)


def near_copies(n, edits, words=120, seed=1):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(900)}" for _ in range(words)]
    out = []
    for i in range(n):
        own = list(base)
        for _ in range(rng.randrange(edits + 1)):
            own[rng.randrange(words)] = f"e{rng.randrange(9000)}"
        out.append((100 + i, " ".join(own)))
    return out


def test_odd_rows(docs):
    assert got(near_dedup.near_duplicates(docs(*ODD))) == brute(ODD)


@pytest.mark.parametrize("edits", [2, 5, 9])
def test_large_group_of_near_copies(docs, edits):
    rows = near_copies(150, edits) + near_copies(40, 3, seed=2) + [(1, "five words are just enough"), (2, "Five words ARE just enough")]
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    assert got(near_dedup.near_duplicates(docs(*rows))) == brute(rows)


@pytest.mark.parametrize("hub_rounds, pairs_left", [(1, 8), (3, 0)])
def test_rounds(docs, monkeypatch, hub_rounds, pairs_left):
    monkeypatch.setattr(near_dedup, "HUB_ROUNDS", hub_rounds)
    monkeypatch.setattr(near_dedup, "PAIRS_LEFT", pairs_left)
    rows = near_copies(120, 8)
    assert got(near_dedup.near_duplicates(docs(*rows))) == brute(rows)


def edited(base, rng, edits):
    own = list(base)
    for _ in range(edits):
        own[rng.randrange(len(own))] = f"e{rng.randrange(10**6)}"
    return " ".join(own)


@pytest.mark.parametrize("low, high", [(8, 11), (12, 17), (18, 30)])
def test_estimates_keep_linked_pairs_of_short_texts(low, high):
    rng = random.Random(low)
    texts, linked = [], []
    while len(linked) < 300:
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(low, high))]
        a, b = " ".join(base), " ".join(base[rng.randrange(3) :]) if rng.random() < 0.5 else edited(base, rng, 1)
        x, y = shingle_set(a), shingle_set(b)
        if x != y and 100 * len(x & y) >= 75 * len(x | y):
            linked.append(len(texts))
            texts += [a, b]
    sides = pa.RecordBatch.from_arrays([pa.array([b""] * len(texts), pa.binary()), pa.array(texts)], ["cls", "text"])
    fine = next(near_dedup._fine([sides])).column(1).to_pylist()
    rows = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array([0] * len(texts), pa.int32()), pa.array(texts)], ["doc_id", "tk", "text"])
    sig = next(near_dedup._sketched([rows])).column(4).to_pylist()
    for signature, most in ((fine, near_dedup.FINE_DIFFER), (sig, near_dedup.DIFFER)):
        apart = [sum(((x ^ y) & (2**64 - 1)).bit_count() for x, y in zip(signature[i], signature[i + 1], strict=True)) for i in linked]
        assert max(apart) <= most


def test_groups_of_short_texts(docs):
    rng, rows = random.Random(5), []
    for words in range(8, 31):
        base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
        rows += [edited(base, rng, rng.randrange(3)) for _ in range(40)]
    rows = list(enumerate(rows))
    assert got(near_dedup.near_duplicates(docs(*rows))) == brute(rows)


def test_linked_pair_behind_an_unlike_hub(docs):
    """Every bucket that the two linked texts share has a third one as its hub, too long to be linked to them."""
    for seed in range(5000):
        rng = random.Random(seed)
        words = [f"w{rng.randrange(10**6)}" for _ in range(42)]
        texts = [" ".join(x) for x in (words[3:35], words[7:39], words)]
        a, b, hub = (set(near_dedup.bands(near_dedup.minima(near_dedup.shingles(t))).tolist()) for t in texts)
        if a & b and a & b <= hub:
            break
    rows = list(enumerate(texts))
    assert brute(rows) == [(0, 28, 0), (1, 28, 0), (2, 38, 2)]
    assert got(near_dedup.near_duplicates(docs(*rows))) == brute(rows)


def test_empty(docs):
    assert near_dedup.near_duplicates(docs().limit(0)).count() == 0


def test_query(spark, sf_docs):
    assert got(queries.op3_near_dedup(spark, SF)) == brute(list(zip(sf_docs.doc_id, sf_docs.text)))
