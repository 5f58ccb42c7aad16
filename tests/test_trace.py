from __future__ import annotations

import random

import numpy as np

from clauseloom.operators import trace as T
from clauseloom.plans import adapters as A
from clauseloom.plans import registry

BOX = "bbox STRUCT<x1: DOUBLE, y1: DOUBLE, x2: DOUBLE, y2: DOUBLE>"
FIELDS = f"contract_id STRING, field_key STRING, value STRING, source_text STRING, page_no INT, {BOX}"
BLOCKS = f"contract_id STRING, page_no INT, sort_order INT, id STRING, text STRING, {BOX}"


def grams(t):
    return {t} if len(t) == 1 else {t[i : i + 2] for i in range(len(t) - 1)}


def brute(field, blocks):
    """Compare with every block in order; windows as plain slices."""
    key, value, source, page = field
    s = "".join((source or "").split())
    if value is None or len(s) < 6:
        return None
    rows = sorted(b for b in blocks if page is None or b[0] == page)
    sg, scored = grams(s), []
    for i, b in enumerate(rows):
        bg = grams("".join(b[3].split())) if b[3].strip() else set()
        n = len(sg & bg)
        if n:
            scored.append((-(n / len(sg) * 0.7 + n / len(sg | bg) * 0.3), i))
    scored.sort()
    if not scored:
        return None
    best = rows[scored[0][1]]
    if -scored[0][0] >= 0.85 and best[4]:
        return best[0], best[4]
    if page is None:
        return None
    for _, a in scored[:3]:
        for span in (2, 3, 4):
            win = rows[a : a + span]
            if len(win) < span or any(y[1] - x[1] > 2 for x, y in zip(win, win[1:])):
                break
            text = "".join("".join(w[3].split()) for w in win)
            got = [w[4] for w in win if w[4]]
            if len(sg & grams(text)) / len(sg) >= 0.7 and got:
                return page, (min(b[0] for b in got), min(b[1] for b in got), max(b[2] for b in got), max(b[3] for b in got))
    return None


def test_random_contracts_against_brute_force(make, monkeypatch):
    """Small buckets, so that windows cross them."""
    monkeypatch.setattr(T, "BUCKET", 4)
    rng = random.Random(11)
    field_rows, block_rows, expected = [], [], {}
    for k in range(60):
        blocks = []
        for page in (1, 2):
            order = 0
            for _ in range(rng.randrange(0, 9)):
                order += rng.choice([1, 1, 1, 2, 3])
                text = "".join(rng.choice("甲乙丙丁戊ab ") for _ in range(rng.randrange(0, 12)))
                box = None if rng.random() < 0.2 else tuple(float(rng.randrange(100)) for _ in range(4))
                blocks.append((page, order, f"{order:03d}", text, box))
        block_rows += [(f"k{k}", p, o, i, t, b) for p, o, i, t, b in blocks]
        for f in range(8):
            page = rng.choice([1, 2, None])
            mine = [b for b in blocks if b[0] == (page or 1)] or [(1, 1, "", "无文字可用", None)]
            at = rng.randrange(len(mine))
            source = "".join(b[3] for b in mine[at : at + rng.choice([1, 1, 2, 3])])
            field = (f"f{f}", rng.choice(["v", "v", "v", None]), source, page)
            field_rows.append((f"k{k}", field[0], field[1], source, page, None))
            hit = brute(field, blocks)
            if hit:
                expected[(f"k{k}", field[0])] = hit
    got = T.locate_sources(make(FIELDS, *field_rows), make(BLOCKS, *block_rows)).collect()
    assert {(r.contract_id, r.field_key): (r.page_no, tuple(r.bbox)) for r in got} == expected
    assert len(expected) > 100 and any(r.span > 1 for r in got)


def test_attach_keeps_rows_and_given_boxes(make):
    blocks = make(BLOCKS, ("c", 3, 1, "a", "合同总金额为人民币十万元", (1.0, 2.0, 3.0, 4.0)))
    source = "合同总金额为人民币十万元"
    fields = make(
        FIELDS, ("c", "found", "x", source, None, None), ("c", "given", "x", source, 3, (9.0, 9.0, 9.0, 9.0)),
        ("c", "no-value", None, source, 3, None), ("c", "short", "x", "合同总", 3, None), ("c", "other-page", "x", source, 1, None),
    )
    got = {r.field_key: (r.page_no, r.bbox and tuple(r.bbox)) for r in T.attach_boxes(fields, blocks).collect()}
    assert got == {
        "found": (3, (1, 2, 3, 4)), "given": (3, (9, 9, 9, 9)), "no-value": (3, None), "short": (3, None), "other-page": (1, None),
    }


def test_hot_page_is_split_into_buckets(spark):
    """A page with very many blocks meets its fields bucket by bucket."""
    blocks = spark.range(20000).selectExpr(
        "'hot' AS contract_id", "1 AS page_no", "CAST(id AS INT) AS sort_order", "CAST(id AS STRING) AS id",
        "concat('第', id, '号条款内容说明文字') AS text", "named_struct('x1', 0D, 'y1', CAST(id AS DOUBLE), 'x2', 1D, 'y2', 1D) AS bbox",
    )
    fields = spark.createDataFrame([("hot", "f", "v", "第12345号条款内容说明文字", 1, None)], FIELDS)
    row = T.locate_sources(fields, blocks).first()
    assert row.bbox.y1 == 12345


def test_every_line_is_traced(spark):
    sf = "/root/testdata/sf0.001"
    lines = A.table(spark, sf, "documents").selectExpr(r"explode(split(text, '\\n'))").count()
    assert registry.queries()["trace_attach"](spark, sf).count() == lines


def test_hot_contract_compares_few_blocks(spark, make):
    """Thousands of blocks, most of them copies of a few: a field without a page meets those that can pass."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(4, 9))) for _ in range(400)]
    texts = [" ".join(rng.choice(words) for _ in range(8)) for _ in range(600)] + ["the same line on every page of it"] * 2400
    rng.shuffle(texts)
    blocks = [("k", i // 30 + 1, i % 30, f"{i:05d}", t, (0.0, float(i), 1.0, float(i + 1))) for i, t in enumerate(texts)]
    own = {t: next(b for b in blocks if b[4] == t) for t in texts}
    chosen = rng.sample(sorted(own), 40) + ["the same line on every page of it"]
    fields = [("k", f"f{i}", "v", t, None, None) for i, t in enumerate(chosen)]
    fields, blocks = make(FIELDS, *fields), make(BLOCKS, *blocks).repartition(4).persist()
    index = T.GramIndex(T._probes(fields), T._blocks(blocks))
    assert index.passing(T.SINGLE_PASS).count() <= 41 * 3000 / 100
    got = {r.field_key: (r.page_no, r.bbox.y1, r.span) for r in T.locate_sources(fields, blocks).collect()}
    assert got == {f"f{i}": (own[t][1], own[t][5][1], 1) for i, t in enumerate(chosen)}


def test_three_best_blocks_through_the_index(make):
    """Scores and ranks of fields without a page against all blocks of the contract, copies and ties included."""
    rng = random.Random(8)
    rows = []
    for k in range(6):
        pool = ["".join(rng.choice("甲乙丙丁ab ") for _ in range(rng.randrange(0, 14))) for _ in range(25)]
        rows += [(f"k{k}", 1 + i // 9, i % 9, f"{i:03d}", rng.choice(pool), None) for i in range(70)]
    fields = [(f"k{rng.randrange(7)}", f"f{i}", "v", "".join(rng.choice("甲乙丙丁ab") for _ in range(rng.randrange(6, 15))), None, None) for i in range(60)]
    want = set()
    for key, name, _, source, _, _ in fields:
        scored = []
        for _, page, order, block, text, _ in (r for r in rows if r[0] == key):
            text = "".join(text.split())
            s, b = grams(source), grams(text) if text else set()
            n = len(s & b)
            if n:
                scored.append((-(n / len(s) * 0.7 + n / len(s | b) * 0.3), page, order, block))
        want |= {(key, name, page, order, rank + 1) for rank, (_, page, order, _) in enumerate(sorted(scored)[:3])}
    got = T.block_scores(make(FIELDS, *fields), make(BLOCKS, *rows)).collect()
    assert {(r.contract_id, r.field_key, r.page_no, r.sort_order, r["rank"]) for r in got} == want and len(got) == len(want)


def test_bigrams_are_no_rows(spark):
    """Lists of bigrams took hundreds of rows a line, shuffled several times over."""
    sf = "/root/testdata/sf0.001"
    for found in (T.block_scores(A.traces(spark, sf), A.blocks(spark, sf)), T.locate_sources(A.traces(spark, sf), A.blocks(spark, sf))):
        assert "gram" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_tiles_in_slices_of_bigrams(monkeypatch):
    """However many characters a tile has, its matrices stay small; counts and windows are those of plain sets."""
    rng = random.Random(5)
    for chars, cells in (("甲乙丙丁ab", 10**6), ("甲乙丙丁ab", 60), ("".join(map(chr, range(0x4E00, 0x5600))) + "😀", 400)):
        monkeypatch.setattr(T, "CELLS", cells)
        text = lambda least: "".join(rng.choice(chars) for _ in range(rng.randrange(least, 14)))  # noqa: E731, B023
        sources, texts = [text(6) for _ in range(7)], ["", *[text(0) for _ in range(9)], "", ""]
        tile = T._Tile(sources, texts)
        assert all((hi - lo) * (len(sources) + len(texts)) <= cells for lo, hi in tile.slices)
        pairs = lambda t: {t[i : i + 2] for i in range(len(t) - 1)}
        n, ns, nb = tile.shared()
        assert n.tolist() == [[len(pairs(s) & pairs(t)) for t in texts] for s in sources]
        assert ns.tolist() == [len(pairs(s)) for s in sources] and nb.tolist() == [len(pairs(t)) for t in texts]
        f_at, b_at = (g.ravel() for g in np.meshgrid(range(7), range(len(texts) - 1), indexing="ij"))
        got = tile.windows(f_at, b_at)
        for span in (2, 3, 4):
            want = [len(pairs(sources[f]) & pairs("".join(texts[b : b + span]))) for f, b in zip(f_at, b_at) if b + span <= len(texts)]
            assert got[span][b_at + span <= len(texts)].tolist() == want


def test_fields_of_scattered_pages(make):
    """Fields of many pages of one contract, in no order and in several partitions, each find their own page's block."""
    rng = random.Random(9)
    texts = {(p, o): "".join(rng.choice("abcdefghij") for _ in range(12)) for p in range(1, 40) for o in (0, 255, 256, 600)}
    blocks = [("k", p, o, "", t, (float(p), float(o), 1.0, 1.0)) for (p, o), t in texts.items()]
    fields = [("k", f"{p}-{o}", "v", t, p, None) for (p, o), t in texts.items()]
    rng.shuffle(fields)
    got = T.locate_sources(make(FIELDS, *fields).repartition(5), make(BLOCKS, *blocks)).collect()
    assert {(r.field_key, r.page_no, r.bbox.y1, r.span) for r in got} == {(f"{p}-{o}", p, float(o), 1) for p, o in texts}
