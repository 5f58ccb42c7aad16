from __future__ import annotations

import json

import pytest

from clauseloom.sources import definitions as D
from clauseloom.sources import exports as X
from clauseloom.sources import files as S
from clauseloom.sources import ocr as O
from clauseloom.sources import tables as T

RESPONSES = "contract_id STRING, body STRING"


def test_scan_and_intake(spark, tmp_path):
    contents = {"a.bin": b"%PDF-1", "b.txt": b"hello", "c.JPG": b"raw", "e.gif": b"MM\x00*xx", "f.png": b"%PDF-1"}
    for name, data in contents.items():
        (tmp_path / name).write_bytes(data)
    rows = {r.file_name: r for r in S.validate_intake(S.scan_files(spark, str(tmp_path)), max_size=6).collect()}
    assert {n: r.file_type for n, r in rows.items()} == {"a.bin": "pdf", "b.txt": None, "c.JPG": "jpg", "e.gif": "tiff", "f.png": "pdf"}
    assert {n: r.reason for n, r in rows.items() if r.reason} == {"b.txt": "unsupported_type"}
    assert rows["a.bin"].stored_name == "a.bin.pdf" and rows["e.gif"].stored_name == "e.gif.tiff"
    assert [tuple(r)[1:] for r in S.duplicate_report(S.validate_intake(S.scan_files(spark, str(tmp_path)))).collect()] == [(2, "a.bin")]
    assert {r.reason for r in S.validate_intake(S.scan_files(spark, str(tmp_path)), max_size=2).collect()} == {"too_large"}
    empty = spark.createDataFrame([("d.pdf", 0, bytearray(b"")), ("", 3, bytearray(b"abc"))], "file_name STRING, file_size BIGINT, content BINARY")
    assert [r.reason for r in S.validate_intake(empty).collect()] == ["empty_file", "missing_name"]


def test_batch_limits(make):
    mb = 1024 * 1024
    files = make(
        "batch_id INT, file_name STRING, file_size BIGINT", (1, "a.png", 5 * mb), (1, "b.png", 5 * mb + 1), (1, "c.pdf", 60 * mb), (1, "d.pdf", 60 * mb + 1),
        (1, "e.docx", 1), *[(2, f"{i}.pdf", 1) for i in range(6)],
    )
    got = {r.file_name: r.reason for r in S.validate_batch(files).collect()}
    assert got["a.png"] is None and got["c.pdf"] is None and got["b.png"] == got["d.pdf"] == "too_large"
    assert got["e.docx"] == "unsupported_type" and got["0.pdf"] == "too_many_files"


def test_layout_response(make):
    page = {"prunedResult": {"width": 1192, "height": 1636, "parsing_res_list": [
        {"block_label": "doc_title", "block_content": " 合同 ", "block_bbox": [1, 2, 3, 4]}, {"block_label": "seal", "block_content": "章"},
        {"block_label": "table", "block_content": "<table/>", "block_bbox": [1, 2]}, {"block_label": "text", "block_content": "  "},
        {"block_content": "正文", "block_bbox": ["a", 2, 3, 4]}, {"block_label": "odd", "block_content": "其它"},
    ]}}
    wrapped, bare = json.dumps({"result": {"layoutParsingResults": [{"prunedResult": {"parsing_res_list": []}}, page]}}), json.dumps({"layoutParsingResults": [page]})
    df = make(RESPONSES, ("w", wrapped), ("b", bare), ("none", json.dumps({"result": {}})), ("empty", json.dumps({"layoutParsingResults": []})), ("junk", "oops"))
    rows = O.blocks_from_layout(df).orderBy("contract_id", "sort_order").collect()
    got = [(r.sort_order, r.block_type, r.text, r.bbox and tuple(r.bbox)) for r in rows if r.contract_id == "w"]
    assert got == [(1, "title", "合同", (1, 2, 3, 4)), (3, "table", "<table/>", None), (5, "text", "正文", None), (6, "text", "其它", None)]
    assert {(r.contract_id, r.page_no, r.page_width, r.confidence) for r in rows} == {("w", 2, 1192, 0.0), ("b", 1, 1192, 0.0)}
    assert sorted(r.contract_id for r in O.layout_errors(df).collect()) == ["empty", "junk", "none"]


POLY = [[1, 2], [30, 2], [30, 12], [1, 12]]
BOX = (1.0, 2.0, 30.0, 12.0)


@pytest.mark.parametrize(
    "body, expected",
    [
        ({"result": [{"text": "甲", "bbox": {"x1": 1, "y1": 2, "x2": 30, "y2": 12}, "confidence": 0.5}]}, [("甲", BOX, 0.5)]),
        ({"results": [{"transcription": "甲", "points": POLY, "score": 0.6}]}, [("甲", BOX, 0.6)]),
        ({"data": [{"rec_text": " 甲 ", "box": [1, 2, 30, 12]}]}, [("甲", BOX, 0.8)]),
        ({"ocr_results": [[POLY, ["甲", 0.9]], [POLY, ["乙"]]]}, [("甲", BOX, 0.9), ("乙", BOX, 0.8)]),
        ({"result": [[[POLY, ["甲", 0.9]], [POLY, ["乙", 0.7]]]]}, [("甲", BOX, 0.9), ("乙", BOX, 0.7)]),
        ({"result": [["甲", 0.9], ["乙"]]}, [("甲", None, 0.9), ("乙", None, 0.8)]),
        ({"result": {"rec_texts": ["甲", "", "乙"], "rec_polys": [POLY], "rec_scores": [0.9]}}, [("甲", BOX, 0.9), ("乙", None, 0.8)]),
        ({"result": {"texts": ["甲"], "rec_polys": [], "boxes": [[1, 2, 30, 12]], "scores": [0.4]}}, [("甲", BOX, 0.4)]),
        ({"errorCode": 0, "result": {"ocrResults": [{"prunedResult": {"rec_texts": ["甲"], "dt_polys": [POLY]}}]}}, [("甲", BOX, 0.8)]),
        ({"data": {"ocrResults": [{"prunedResult": {"rec_texts": ["甲"]}}, {"rec_texts": ["乙"]}]}}, [("甲", None, 0.8), ("乙", None, 0.8)]),
        ({"result": [{"value": "甲", "bbox": [1, 2]}]}, [("甲", None, 0.8)]),
        ([{"text": "甲"}], [("甲", None, 0.8)]),
        ({"text": "甲", "score": "0.3"}, [("甲", None, 0.3)]),
        ({"result": [5, {"other": 1}]}, []),
    ],
)
def test_text_ocr_shapes(make, body, expected):
    rows = O.blocks_from_text_ocr(make(RESPONSES, ("c", json.dumps(body, ensure_ascii=False)))).orderBy("sort_order").collect()
    assert sorted((r.text, r.bbox and tuple(r.bbox), r.confidence) for r in rows) == sorted(expected)
    assert [r.sort_order for r in rows] == list(range(1, len(rows) + 1))


def test_text_ocr_order_and_pages(make):
    body = {"errorCode": 0, "result": {
        "ocrResults": [{"prunedResult": {"rec_texts": ["下", "上"], "rec_boxes": [[0, 50, 1, 60], [0, 10, 1, 20]]}}, {"prunedResult": {"rec_texts": ["二"]}}],
        "dataInfo": {"pages": [{"width": 1000, "height": 1400}, {"width": 1100, "height": 1500}]},
    }}
    single = {"result": {"ocrResults": [{}, {}], "dataInfo": {"width": 9, "height": 8}}}
    df = make(RESPONSES, ("c", json.dumps(body)), ("s", json.dumps(single)), ("e", '{"errorCode": 7, "errorMsg": "bad"}'), ("t", '{"rec_texts": ["x"]}'))
    rows = O.blocks_from_text_ocr(df).filter("contract_id = 'c'").orderBy("page_no", "sort_order").collect()
    assert [(r.page_no, r.sort_order, r.text) for r in rows] == [(1, 1, "上"), (1, 2, "下"), (2, 1, "二")]
    templates = make("contract_id STRING, idx INT, page_no INT, width INT, height INT", ("c", 0, 5, 1, 1), ("s", 1, 4, 3, 2), ("t", 0, 6, 7, 7))
    got = {(r.contract_id, r.position): (r.page_no, r.page_width, r.page_height) for r in O.pages_from_text_ocr(df, templates).collect()}
    assert got == {("c", 1): (5, 1000, 1400), ("c", 2): (2, 1100, 1500), ("s", 1): (1, 9, 8), ("s", 2): (4, 3, 2), ("t", 1): (6, 7, 7)}
    assert [tuple(r) for r in O.text_ocr_errors(df).collect()] == [("e", "OCR error 7: bad")]


def test_spans_and_routing(make):
    spans = make(
        "contract_id STRING, page_no INT, block_no INT, line_no INT, span_no INT, text STRING, size DOUBLE",
        ("c", 1, 1, 0, 1, "题", 14.0), ("c", 1, 1, 0, 0, "标", 10.0), ("c", 1, 1, 1, 0, " 二行 ", 9.0), ("c", 1, 2, 0, 0, "小", 13.9), ("c", 1, 3, 0, 0, "无", None),
    )
    got = {r.block_no: (r.text, r.font_size, r.block_type) for r in O.block_types_from_spans(spans).collect()}
    assert got == {1: ("标题\n 二行", 14.0, "title"), 2: ("小", 13.9, "text"), 3: ("无", None, "text")}
    pages = make("contract_id STRING, page_no INT, text STRING", *[("t", i, "x" * 25) for i in range(4)], ("t", 9, " "), ("few", 1, "x" * 99), *[("gaps", i, "x" * 200 if i else None) for i in range(4)])
    assert {r.contract_id: r.route for r in O.route_documents(pages).collect()} == {"t": "text", "few": "ocr", "gaps": "ocr"}


@pytest.mark.parametrize(
    "content, expected",
    [
        ("﻿字段名称,描述,字段标识,值类型\n甲方,\"名称, 全称\",k1,\n,无名,k2,x\n 乙方 ,\"说\"\"明\",,number\n", [("甲方", "名称, 全称", "k1", "string"), ("乙方", '说"明', None, "number")]),
        ("Field Name\tdesc\r\nA\tx\r\nB\t\r\n", [("A", "x", None, "string"), ("B", "", None, "string")]),
        ("甲;说明\n乙;其他\n", [("甲", "说明", None, "string"), ("乙", "其他", None, "string")]),
        ("只有名称\n第二\n", [("只有名称", "", None, "string"), ("第二", "", None, "string")]),
    ],
)
def test_definition_import(spark, tmp_path, content, expected):
    path = tmp_path / "f.csv"
    path.write_bytes(content.encode())
    got = [(r.field_name, r.description, r.field_key, r.value_type) for r in D.read_field_definitions(spark, str(path)).collect()]
    assert got == expected


def test_key_assignment(make):
    rows = make(
        "field_key STRING, field_name STRING, description STRING, value_type STRING, pos INT",
        ("taken", "Net Price!", "", "string", 1), ("mine", "x", "", "string", 2), ("mine", "x", "", "string", 3), (None, "Net  price", "", "string", 4), (" ", "！", "", "string", 5),
    )
    existing = make("field_key STRING", ("taken",), ("custom-net-price-4",))
    got = {r.sort_order: r.field_key for r in D.assign_field_keys(rows, existing, 10).collect()}
    assert got == {11: "custom-net-price-5", 12: "mine", 13: "custom-x-1", 14: "custom-net-price-6", 15: "custom-field-1"}


def test_golden(spark, tmp_path):
    (tmp_path / "c1.json").write_text('{"a": "甲", "b": null}', encoding="utf-8")
    (tmp_path / "c2.json").write_text('{"a": "1"}', encoding="utf-8")
    assert {tuple(r) for r in D.read_golden(spark, str(tmp_path)).collect()} == {("c1", "a", "甲"), ("c1", "b", None), ("c2", "a", "1")}


@pytest.fixture
def exported(make):
    fields = make(
        "contract_id INT, field_key STRING, value STRING, reviewed_value STRING, confidence DOUBLE, page_no INT, review_status STRING",
        (1, "a", "x", "", 0.5, 2, "extracted"), (1, "b", None, "改\n行", None, None, "corrected"), (2, "a", 'say "hi", ok', None, 0.9, 1, "approved"),
    )
    batch = make("contract_id INT, file_name STRING, status STRING, error STRING", (1, "一.pdf", "completed", None), (2, "b.pdf", "failed", "坏,了"), (9000, "c.pdf", "odd", ""))
    return fields, batch


def test_wide_and_csv(exported, tmp_path, spark):
    fields, batch = exported
    wide = [tuple(r) for r in X.wide_results(fields, batch, ["a", "b"]).orderBy("序号").collect()]
    assert wide == [(1, "一.pdf", "x", "", "完成", ""), (2, "b.pdf", 'say "hi", ok', "", "失败", "坏,了"), (3, "c.pdf", "", "", "未处理", "")]
    X.write_lines(X.csv_lines(fields, batch, ["a", "b"], ["甲,方", "乙"]), str(tmp_path / "out"))
    parts = sorted((tmp_path / "out").glob("part-*"))
    text = "".join(p.read_text(encoding="utf-8") for p in parts)
    assert text == (
        '﻿序号,文件名,"甲,方",乙,处理状态,错误信息\n1,一.pdf,x,"改\n行",完成,\n2,b.pdf,"say ""hi"", ok",,失败,"坏,了"\n3,c.pdf,,,未处理,\n'
    )


def test_json(exported, tmp_path):
    fields, batch = exported
    X.write_json(X.json_rows(fields, batch, ["a", "b"]), str(tmp_path / "out"))
    rows = [json.loads(line) for p in (tmp_path / "out").glob("part-*") for line in p.read_text(encoding="utf-8").splitlines()]
    first = next(r for r in rows if r["index"] == 1)
    assert first["fields"]["a"] == {"value": "x", "reviewed_value": "", "confidence": 0.5, "page_no": 2, "review_status": "extracted"}
    assert first["error"] is None and next(r for r in rows if r["index"] == 3)["fields"] == {"a": None, "b": None}


def test_batches_replace_by_contract(make, spark, tmp_path):
    ddl = "contract_id STRING, v INT"
    root = str(tmp_path / "t")
    T.write_batch(make(ddl, ("a", 1), ("a", 2), ("b", 1)), make(ddl, ("a", 0), ("b", 0)), root, 0)
    T.write_batch(make(ddl, ("a", 9)), make(ddl, ("a", 0)), root, 1)
    T.write_batch(make(ddl, ("a", 9)), make(ddl, ("a", 0)), root, 1)
    T.write_batch(make(ddl).limit(0), make(ddl, ("b", 0)), root, 2)
    assert [tuple(r) for r in T.read_current(spark, root).collect()] == [("a", 9)]
    got = T.replace_contracts(make(ddl, ("a", 1), ("b", 1)), make(ddl, ("a", 5)))
    assert sorted(tuple(r) for r in got.collect()) == [("a", 5), ("b", 1)]
