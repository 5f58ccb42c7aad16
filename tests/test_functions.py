from __future__ import annotations

import random

from clauseloom.functions import boxes, labels, numbers, text


def test_strip_knows_unicode_whitespace(evaluate):
    assert evaluate(text.strip, "　a b\n", "\x1ca\x1f", "   ") == ["a b", "a", ""]


def test_squash_and_snippet(evaluate):
    assert evaluate(text.squash, " a \n　b ") == ["a b"]
    assert evaluate(lambda x: text.snippet(x, 3), "abc", "abcd", None) == ["abc", "abc...", None]


def test_bigrams_are_code_point_pairs(evaluate):
    got = evaluate(text.bigrams, "甲乙甲乙", "x", "", "a😀b")
    assert [sorted(g) for g in got] == [["乙甲", "甲乙"], ["x"], [], ["a😀", "😀b"]]


def test_bigrams_against_brute_force(evaluate):
    rng = random.Random(1)
    words = ["".join(rng.choice("ab甲\n😀 ") for _ in range(rng.randrange(0, 30))) for _ in range(200)]
    expected = [{w} if len(w) == 1 else {w[i : i + 2] for i in range(len(w) - 1)} for w in words]
    assert [set(g) for g in evaluate(text.bigrams, *words)] == expected


def test_safe_filename(spark):
    rows = [("../../etc/x.pdf", "pdf"), ("a b（c）.PDF", "pdf"), ("..", "png"), ("", "tif"), ("合同.docx", "pdf"), ("x", None)]
    df = spark.createDataFrame(rows, "n STRING, t STRING").selectExpr(f"{text.safe_filename('n', 't')} AS r")
    assert [r.r for r in df.collect()] == ["x.pdf", "abc.PDF", "upload.png", "upload.tiff", "合同.docx.pdf", "x.bin"]


def test_text_to_double(evaluate):
    got = evaluate(numbers.text_to_double, " 1.5 ", "1_000", "１２", "1d", "abc", "", "1e3", "-.5", "inf", "5.")
    assert got == [1.5, 1000.0, 12.0, None, None, None, 1000.0, -0.5, float("inf"), 5.0]


def test_double_to_text_like_python(spark):
    values = [30.0, 0.1, 1e7, 12345678.125, 1e15, 1e16, 1.5e20, 0.0005, 0.00001, 1.25e-7, 0.0, -70.5]
    df = spark.createDataFrame([(v,) for v in values], "v DOUBLE").selectExpr("v", f"{numbers.double_to_text('v')} AS t")
    assert {r.v: r.t for r in df.collect()} == {v: str(v) for v in values}


def test_norm_date(evaluate):
    got = evaluate(numbers.norm_date, "2024-1-5", " 2024年1月5日 ", "2024年12月05", "24-01-01", "2024/01/01", None)
    assert got == ["2024-1-5", "2024-01-05", "2024-12-05", None, None, None]
    strict = evaluate(lambda x: numbers.norm_date(x, strict=True), "2024-9-1", "2024-13-01")
    assert strict == ["2024-09-01", None]


def test_formal_amount(evaluate):
    got = evaluate(
        numbers.formal_amount, "壹佰贰拾万元整", "拾万", "壹万", "壹拾万元", "壹元伍角", "，", "分", "万", "壹亿贰仟万零伍"
    )
    assert got == [1200000.0, 100000.0, 10000.0, 100000.0, 5.0, None, 0.0, 10000.0, 120000005.0]


def test_formal_amount_against_brute_force(evaluate):
    rng = random.Random(7)
    alphabet = "零壹贰叁玖拾佰仟万亿元整圆角分，、 "
    samples = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 12))) for _ in range(400)]
    units = {"拾": 10, "佰": 100, "仟": 1000}
    big = {"万": 10**4, "亿": 10**8}
    digits = dict(zip("零壹贰叁玖", (0, 1, 2, 3, 9)))

    def reading(t):
        t = t.replace("，", "").replace("、", "").replace(" ", "").rstrip("元整圆")
        if not t:
            return None
        total = section = digit = 0.0
        for ch in t:
            if ch in digits:
                digit = digits[ch]
            elif ch in units:
                section, digit = section + (digit or 1) * units[ch], 0
            elif ch in big:
                total, section, digit = total + ((section + digit) or 1) * big[ch], 0, 0
        return total + section + digit

    assert evaluate(numbers.formal_amount, *samples) == [reading(s) for s in samples]


def test_boxes(spark):
    rows = [('{"x1":1,"y1":2,"x2":3,"y2":4}',), ("[1,2,3,4]",), ("[1,2]",), ('{"x1":1}',), ("junk",), (None,)]
    df = spark.createDataFrame(rows, "j STRING").selectExpr(f"{boxes.decode_box('j')} AS b")
    assert [tuple(r.b) if r.b else None for r in df.collect()] == [(1, 2, 3, 4), (1, 2, 3, 4), None, None, None, None]
    one = spark.range(1).selectExpr(
        "array(named_struct('x1', 100D, 'y1', 200D, 'x2', 300D, 'y2', 220D), NULL, named_struct('x1', 90D, 'y1', 230D, 'x2', 250D, 'y2', 285D)) AS bs"
    )
    assert tuple(one.selectExpr(f"{boxes.union_box('bs')} AS u").first().u) == (90, 200, 300, 285)


def test_rescale_box(spark):
    df = spark.range(1).selectExpr(
        "named_struct('x1', 10D, 'y1', 20D, 'x2', 60D, 'y2', 70D) AS b", "named_struct('x1', 5D, 'y1', 5D, 'x2', 5D, 'y2', 5D) AS d"
    ).selectExpr(
        f"{boxes.rescale_box('b', '200', '100')} AS a", f"{boxes.rescale_box('b', '200', '0')} AS z", f"{boxes.rescale_box('d', '1', '1')} AS m"
    )
    row = df.first()
    assert tuple(row.a) == (20, 40, 100, 100) and tuple(row.z) == (0, 0, 0, 0) and tuple(row.m)[2:] == (1, 1)


def test_labels(evaluate):
    assert evaluate(labels.status_label, "completed", "skipped", "odd", None) == ["完成", "跳过", "未处理", "未处理"]
    assert evaluate(labels.review_label, "corrected", "extracted") == ["已修正", ""]
    assert evaluate(labels.record_status, "approved", "failed", "rejected") == ["COMPLETED", "FAILED", "PROCESSING"]
    assert evaluate(lambda x: labels.batch_label(x, "'pending'"), "completed", "pending") == ["OCR完成", "等待OCR"]
