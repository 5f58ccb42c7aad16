from __future__ import annotations

import pytest

from clauseloom.operators import layout as L
from clauseloom.operators.ordered import number_rows, reading_order

BLOCKS = "contract_id STRING, page_no INT, sort_order INT, id STRING, block_type STRING, text STRING, confidence DOUBLE"


@pytest.fixture
def blocks(make):
    return make(
        BLOCKS, ("c", 2, 1, "d", "table", "<table><tr><td>1</td></tr></table>", None), ("c", 1, 2, "c", "text", "正文第二行", 0.9),
        ("c", 1, 1, "a", "title", "合同", 0.8), ("c", 1, 2, "b", "text", "正文\n第一行很长", 0.7),
    )


def test_text_and_markdown(blocks):
    assert L.document_text(blocks).first().text == "合同\n正文\n第一行很长\n正文第二行\n<table><tr><td>1</td></tr></table>"
    assert L.document_markdown(blocks).first().markdown == (
        "<!-- page: 1 -->\n\n合同\n\n正文\n第一行很长\n\n正文第二行\n\n<!-- page: 2 -->\n\n<table><tr><td>1</td></tr></table>"
    )


def test_title_and_counts(blocks, make):
    assert L.extract_title(blocks).first().title == "第一行很长"
    assert L.page_count(blocks).first().page_count == 2
    assert L.extract_title(make(BLOCKS, ("c", 1, 1, "a", "text", "x" * 300, None))).first().title == "x" * 200


def test_load_pages(blocks):
    sized = blocks.selectExpr(
        "*", "sort_order AS page_width", "CAST(NULL AS INT) AS page_height", "NULL AS bbox", "0 AS paragraph_id", "0D AS font_size"
    )
    first, second = L.load_pages(sized).orderBy("page_no").collect()
    assert [b.id for b in first.blocks] == ["a", "b", "c"] and first.page_width == 2 and second.blocks[0].confidence == 0.0


def test_keyword_contexts_and_diagnostics(make):
    text = "x" * 100 + "甲方：某公司 " + "y" * 300
    got = {r.keyword: r.context for r in L.keyword_contexts(make("contract_id STRING, text STRING", ("c", text))).collect()}
    assert set(got) == {"甲方"} and got["甲方"].startswith("x" * 80 + "甲方：某公司 y") and got["甲方"].endswith("...")
    blocks = make(BLOCKS, ("c", 1, 1, "a", "text", "甲方名称", None), ("c", 2, 1, "b", "text", "abc", None), ("d", 1, 1, "e", "text", "x", None))
    rows = {r.contract_id: r for r in L.ocr_diagnostics(blocks).collect()}
    assert rows["c"].asDict() == {
        "contract_id": "c", "page_count": 2, "block_count": 2, "text_length": 8, "keyword_hits": "甲方,甲方名称", "no_keyword": False,
    }
    assert rows["d"].no_keyword


def windows(n, p, overlap):
    """Page windows by simple stepping, for comparison."""
    if n <= p:
        return [list(range(1, n + 1))]
    out, i = [], 0
    while True:
        out.append(list(range(i + 1, min(i + p, n) + 1)))
        if i + p >= n:
            return out
        i += max(1, p - overlap)


@pytest.mark.parametrize("p, overlap", [(6, 1), (2, 0), (3, 5), (1, 1), (4, 2)])
def test_chunks_against_stepping(spark, p, overlap):
    pages = spark.range(1, 18).selectExpr("CAST(id AS STRING) AS contract_id", "explode(sequence(1, id)) AS n").selectExpr(
        "contract_id", "CAST(n * 2 AS INT) AS page_no", "concat('<!-- page: ', n, ' -->\n\nT', n) AS text"
    )
    got: dict = {}
    for r in L.page_chunks(pages, p, overlap).orderBy("contract_id", "chunk_no").collect():
        got.setdefault(int(r.contract_id), []).append(r.text)
    marked = lambda ns: "\n\n".join(f"<!-- page: {n} -->\n\nT{n}" for n in ns)
    for n in range(1, 18):
        w = windows(n, p, overlap)
        assert got[n] == [marked(ns) + ("\n\n" if i < len(w) - 1 else "") for i, ns in enumerate(w)]
    docs = spark.createDataFrame([(n, marked(range(1, n + 1))) for n in range(1, 18)], "n INT, m STRING")
    cut = docs.selectExpr("n", f"{L.chunk_markdown('m', p, overlap)} AS c").collect()
    assert {r.n: r.c for r in cut} == got


def test_chunk_markdown_edges(evaluate):
    cut = lambda x: L.chunk_markdown(x, 1, 0)
    assert evaluate(cut, "no markers", "  \n", "head\n<!-- page: 1 -->\na\n<!-- page: 2 -->\nb") == [
        ["no markers"], [], ["<!-- page: 1 -->\na\n", "<!-- page: 2 -->\nb"],
    ]
    with pytest.raises(ValueError):
        L.chunk_markdown("x", 0)
    with pytest.raises(ValueError):
        L.page_chunks(None, 0)


def test_classifier(evaluate, make):
    kinds = [tuple(r) for r in evaluate(L.classify_contract_type, "技术服务", "采购技术", "购买", "租赁", "其他", None)]
    assert kinds == [("service", 0.85), ("service", 0.85), ("purchase", 0.8), ("lease", 0.8), ("sale", 0.7), ("unknown", 0.0)]
    blocks = make(BLOCKS, ("c", 1, 1, "a", "text", "租赁", None), ("c", 2, 1, "b", "text", "采购", None), ("d", 1, 1, "e", "text", "x", None))
    assert {tuple(r) for r in L.classify_documents(blocks).collect()} == {("c", "purchase", 0.8), ("d", "sale", 0.7)}


def test_model_hook_reports_failures_as_data(spark):
    calls = spark.createDataFrame([("c", 0, "good"), ("c", 1, "bad"), ("d", 0, "bad")], "contract_id STRING, chunk_no INT, prompt STRING")

    def model(prompt):
        if prompt == "bad":
            raise RuntimeError("no")
        return prompt.upper()

    out = L.infer(calls, model, attempts=2)
    assert sorted(tuple(r) for r in out.collect()) == [
        ("c", 0, "GOOD", None), ("c", 1, None, "RuntimeError: no"), ("d", 0, None, "RuntimeError: no"),
    ]
    assert {tuple(r) for r in L.inference_status(out).collect()} == {("c", 2, 1, True), ("d", 1, 1, False)}


def test_reading_order_is_stable(make):
    ddl = "contract_id STRING, page_no INT, sort_order INT, text STRING, bbox STRUCT<x1: DOUBLE, y1: DOUBLE, x2: DOUBLE, y2: DOUBLE>"
    rows = [("c", 1, 1, "d", (9.0, 900.0, 1.0, 1.0)), ("c", 1, 2, "c", (1.0, 900.0, 1.0, 1.0)), ("c", 1, 3, "a", None), ("c", 1, 4, "b", (0.0, 0.0, 1.0, 1.0))]
    got = reading_order(make(ddl, *rows)).orderBy("sort_order").collect()
    assert [(r.sort_order, r.text) for r in got] == [(1, "a"), (2, "b"), (3, "c"), (4, "d")]


def test_number_rows_over_everything(spark):
    df = spark.range(1000).selectExpr("(id * 7919) % 1009 AS v")
    got = number_rows(df, [], "floor(v / 50)", "v", "n", "total").orderBy("v").collect()
    assert [r.n for r in got] == list(range(1, 1001)) and {r.total for r in got} == {1000}
