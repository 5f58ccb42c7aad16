from __future__ import annotations

import random

import pytest

from clauseloom.operators import clauses as C

BLOCKS = (
    "contract_id STRING, page_no INT, sort_order INT, block_type STRING, text STRING, "
    "bbox STRUCT<x1: DOUBLE, y1: DOUBLE, x2: DOUBLE, y2: DOUBLE>, confidence DOUBLE"
)


def box(y1, y2=None):
    return (50.0, float(y1), 500.0, float(y1 + 20 if y2 is None else y2))


@pytest.mark.parametrize(
    "line, expected",
    [
        ("第一条 项目概述", ("article_cn", "第一条", "项目概述", 0)),
        ("第 12 条", ("article_cn", "第12条", None, 0)),
        ("一、付款方式", ("section_cn", "一、", "付款方式", 1)),
        ("（一）总则", ("paren_cn", "（一）", "总则", 1)),
        ("（3）细则", ("paren_num", "（3）", "细则", 2)),
        ("1.2.3 范围", ("dotted_multi", "1.2.3", "范围", 2)),
        ("1.2范围", ("dotted_multi", "1.2", "范围", 2)),
        ("3、验收", ("num_dot", "3、", "验收", 2)),
        ("4. Scope", ("num_dot", "4.", "Scope", 2)),
        ("ARTICLE 7  Payment", ("article_en", "Article 7", "Payment", 0)),
        ("其他约定事项", ("section_title", "其他约定", None, 0)),
        ("附则", ("section_title", "附则", None, 0)),
        ("第一条 标题\n正文", ("article_cn", "第一条", "标题", 0)),
        ("第一条\n正文", ("article_cn", "第一条", "正文", 0)),
        ("普通文字", None),
        ("1", None),
        ("2024年", None),
        ("附", None),
    ],
)
def test_marker(make, line, expected):
    row = C.with_marker(make("line STRING", (line,)), "line").first()
    got = (row.m_pattern, row.m_marker, row.m_title, row.m_level)
    assert got == (expected or (None, None, None, None))
    assert make("line STRING", (line,)).filter(C.opens_clause("line")).count() == (expected is not None)


def test_clause_types(evaluate):
    titles = ["付款方式", "违约责任", "保密条款", "争议解决", "合同期限", "项目概述", "支付与违约", "甲乙双方"]
    assert evaluate(C.clause_type, *titles) == ["payment", "breach", "confidentiality", "dispute", "term", "project", "payment", None]


def split(make, *rows):
    return C.split_clauses(make(BLOCKS, *rows)).orderBy("contract_id", "sort_order").collect()


def test_pages_titles_and_gaps(make):
    got = split(
        make,
        ("c", 1, 1, "title", "采购合同", box(0), 0.9),
        ("c", 1, 2, "title", "（正本）", box(40), 0.8),
        ("c", 1, 3, "text", "第一条 付款", box(300), 0.7),
        ("c", 1, 4, "text", "  内容一 ", box(330), 0.6),
        ("c", 1, 5, "text", "   ", box(500), 0.1),
        ("c", 1, 6, "text", "远处", box(420), 0.5),
        ("c", 2, 1, "text", "下页接续", box(0), None),
        ("c", 2, 2, "text", "2、交付", box(10), 1.0),
    )
    assert [(r.sort_order, r.clause_title, r.clause_type, r.level) for r in got] == [
        (1, "第一条 付款", "payment", 0), (2, "第一条 付款", "payment", 0), (3, "2、 交付", "delivery", 2),
    ]
    assert got[0].content == "采购合同\n（正本）\n第一条 付款\n内容一" and got[0].confidence == pytest.approx(0.75)
    assert got[0].bbox.y1 == 0 and (got[0].page_no, got[0].page_end) == (1, None)
    assert got[1].content == "远处\n下页接续" and (got[1].page_no, got[1].page_end) == (1, 2)


def brute(rows):
    """Row-by-row reading of the same rules, for comparison."""
    kinds = []
    for page, kind, y1, y2, text in rows:
        kinds.append((page, kind, y1, y2, text))
    out, prev, head = [], None, None
    for page, kind, y1, y2, text in kinds:
        gap = prev is not None and prev[0] == page and None not in (y1, prev[3]) and y1 - prev[3] > 50
        if prev is None or (prev[1] != "T" and (kind != "X" or gap)):
            out.append([None, []])
        if kind != "X":
            head = text
        out[-1][0] = head
        out[-1][1].append(text)
        prev = (page, kind, y1, y2, text)
    return [(h, "\n".join(t)) for h, t in out]


def test_random_contracts_against_brute_force(make, monkeypatch):
    """Small buckets, so that every level of the numbering is crossed."""
    monkeypatch.setattr(C, "BLOCK_BITS", 1)
    monkeypatch.setattr(C, "PAGE_BITS", 1)
    rng = random.Random(3)
    rows, expected = [], {}
    for k in range(120):
        seq = []
        for page in range(1, rng.randrange(2, 9)):
            y = 0
            for order in range(1, rng.randrange(1, 9)):
                kind = rng.choice("MTXXX")
                y += rng.choice([10, 10, 90])
                b = None if rng.random() < 0.15 else box(y, y + 5)
                text = {"M": f"（{len(seq)}）甲", "T": f"题{len(seq)}", "X": f"文{len(seq)}"}[kind]
                rows.append((f"k{k}", page, order, "title" if kind == "T" else "text", text, b, 0.5))
                seq.append((page, kind, b and b[1], b and b[3], text))
        expected[f"k{k}"] = brute(seq)
    rng.shuffle(rows)
    got: dict = {}
    for r in split(make, *rows):
        title = r.clause_title and r.clause_title.replace(" ", "")
        got.setdefault(r.contract_id, []).append((title, r.content))
    assert got == {k: v for k, v in expected.items() if v}


def test_text_segmentation(make):
    docs = make(
        "contract_id STRING, text STRING",
        ("a", "前言\n\n第一条 付款\n\n  内容 \n\n二、保密\n"), ("b", "  \n \n"), ("c", "第一条 甲\n第二条 乙"), ("d", "无标记"),
    )
    got = [
        (r.contract_id, r.sort_order, r.clause_title, r.clause_type, r.level, r.content)
        for r in C.split_clauses_text(docs).orderBy("contract_id", "sort_order").collect()
    ]
    assert got == [
        ("a", 1, None, None, 0, "前言"),
        ("a", 2, "第一条 付款", "payment", 0, "第一条 付款\n\n内容"),
        ("a", 3, "二、 保密", "confidentiality", 1, "二、保密"),
        ("c", 1, "第一条 甲", None, 0, "第一条 甲"),
        ("c", 2, "第二条 乙", None, 0, "第二条 乙"),
        ("d", 1, None, None, 0, "无标记"),
    ]


def test_hot_contract_is_spread_over_buckets(spark):
    """One contract with most rows: numbering windows see page runs, never the contract."""
    rows = spark.range(60000).selectExpr(
        "CASE WHEN id % 3 < 2 THEN 'hot' ELSE concat('k', id % 500) END AS contract_id", "CAST(id DIV 60 AS INT) AS page_no",
        "CAST(id % 60 AS INT) AS sort_order", "'text' AS block_type", "concat('第', id % 7, '条') AS text",
        "CAST(NULL AS STRUCT<x1: DOUBLE, y1: DOUBLE, x2: DOUBLE, y2: DOUBLE>) AS bbox", "1D AS confidence",
    )
    numbered = C.number_clauses(rows)
    assert numbered.filter("contract_id = 'hot'").selectExpr("max(clause_no) AS m", "count(*) AS n").first() == (40000, 40000)
    plan = numbered._jdf.queryExecution().executedPlan().toString()
    row_windows = [line for line in plan.splitlines() if " Window [" in line and "__new" in line and "__run" not in line]
    assert not row_windows
