from __future__ import annotations

import pytest

from clauseloom.operators import rules as V

FIELDS = "contract_id STRING, field_key STRING, value STRING, source_text STRING, confidence DOUBLE, pos INT"
OK = [("party-a-name", "甲公司"), ("party-b-name", "乙公司")]


@pytest.fixture
def check(spark):
    def run(rows, rule=None, **options):
        data = []
        for pos, row in enumerate(rows):
            key, value, source, conf = (*row, None, None)[:4] if len(row) < 4 else row
            data.append(("c", key, value, source, 0.9 if conf is None else conf, pos))
        fields = spark.createDataFrame(data, FIELDS)
        contracts = spark.createDataFrame([("c",)], "contract_id STRING")
        rules = [r for r in V.BUILTIN if r.name == rule] if rule else None
        found = V.validate(fields, contracts, rules=rules, **options)
        return [(r.rule_key, r.field_key, r.message) for r in found.orderBy("rule_order", "item_order").collect()]

    return run


def test_required(check):
    assert check(OK, "required_fields") == []
    got = check([("party-a-name", " 　"), ("other", "x")], "required_fields")
    assert got == [
        ("required_fields", "party-a-name", "必要字段值为空: 甲方 (party-a-name)"),
        ("required_fields", "party-b-name", "缺少必要字段: 乙方 (party-b-name)"),
    ]
    assert len(check([("party-a-name", None), ("party-b-name", "")], "required_fields")) == 2


def test_last_duplicate_counts(check):
    rows = [("party-a-name", "x"), ("party-a-name", ""), ("party-b-name", ""), ("party-b-name", "y")]
    assert [r[1] for r in check(rows, "required_fields")] == ["party-a-name"]


def test_dates(check):
    def run(eff, end, sign=None):
        return check([("effective-date", eff), ("end-date", end), ("sign-date", sign)], "date_consistency")

    assert run("2024-01-01", "2024-12-31") == []
    assert [r[1] for r in run("2025-01-01", "2024-12-31")] == ["effective-date"]
    assert run("2025年1月1日", "2024-12-31")[0][2] == "生效日期(2025年1月1日)晚于终止日期(2024-12-31)"
    assert [r[1] for r in run("x", "2024-12-31", "2025-01-01")] == ["sign-date"]


def test_dates_compare_as_text_unless_strict(check):
    rows = [("effective-date", "2024-9-1"), ("end-date", "2024-10-1")]
    assert len(check(rows, "date_consistency")) == 1
    assert check(rows, "date_consistency", strict=True) == []


def test_amounts(check):
    run = lambda src, **o: check([("contract-amount", "1", src)], "amount_consistency", **o)
    assert run("人民币壹佰贰拾万元整（¥1,200,000.00）") == []
    assert run("人民币壹佰贰拾万元整（¥1,500,000.00）")[0][2] == "大写金额(壹佰贰拾万元整)与小写金额(1,500,000.00)不一致"
    assert run("¥100") == [] and run("壹万元") == []
    stray = "分三期，人民币壹万元（￥10000）"
    assert len(run(stray)) == 1 and run(stray, strict=True) == []


def test_ratios(check):
    run = lambda *v: check([(f"ratio-{i}", x) for i, x in enumerate(v)], "payment_ratio")
    assert run("30%", "40%", "30%") == [] and run("30%") == [] and run("30%", "70％") == [] and run("30%", "69.5%") == []
    assert run("30%", "30%") == [("payment_ratio", "ratio-0", "付款比例合计为60.0%，不等于100% (共2期: 30.0%, 30.0%)")]
    assert run("30%", "abc") == [] and run("nan", "5") == []


def test_financial(check):
    run = lambda v: [r[2] for r in check([("contract-amount", v)], "financial_consistency")]
    assert run("-5") == ["合同金额为负数: -5"] and run("0.00") == ["合同金额为零"] and run("1,000") == [] and run("") == []
    assert run("壹万") == ["合同金额格式异常: 壹万"] and run("  ") == ["合同金额格式异常:   "]


def test_confidence(check):
    rows = [("a", "x", None, 0.7), ("b", "x", None, 0.699), ("c", "x", None, 0.1)]
    assert [r[1:] for r in check(rows, "low_confidence")] == [("b", "字段 'b' 置信度过低: 0.70"), ("c", "字段 'c' 置信度过低: 0.10")]


def test_contract_without_fields_and_verdict(spark, make):
    fields = make(FIELDS, ("c", "party-a-name", "x", None, 0.9, 1), ("c", "party-b-name", "y", None, 0.5, 2))
    contracts = make("contract_id STRING", ("c",), ("empty",))
    found = V.validate(fields, contracts)
    verdicts = {r.contract_id: (r.errors, r.passed) for r in V.verdict(found, contracts).collect()}
    assert verdicts == {"c": (0, True), "empty": (2, False)}


def test_clause_completeness(make):
    contracts = make("contract_id STRING, contract_type STRING", ("s", "service"), ("l", "lease"), ("n", "service"))
    clauses = make("contract_id STRING, clause_title STRING", ("s", "第一条 付款方式"), ("s", "交付与验收"), ("s", None), ("l", "x"))
    got = [r.message.split(": ")[1] for r in V.clause_completeness(contracts, clauses).orderBy("item_order").collect()]
    assert got == ["intellectual_property", "breach", "dispute"]


def test_refresh_keeps_ignored(make):
    ddl = "contract_id STRING, rule_key STRING, field_key STRING, status STRING"
    stored = make(ddl, ("c", "r1", "f", "active"), ("c", "r2", None, "ignored"), ("other", "r1", "f", "active"))
    touched = make("contract_id STRING", ("c",))
    fresh = make("contract_id STRING, rule_key STRING, field_key STRING", ("c", "r2", None), ("c", "r3", "f"))
    rows = lambda df: sorted((r.contract_id, r.rule_key, r.status) for r in df.collect())
    assert rows(V.refresh_violations(stored, fresh, touched)) == [
        ("c", "r2", "active"), ("c", "r2", "ignored"), ("c", "r3", "active"), ("other", "r1", "active"),
    ]
    assert rows(V.refresh_violations(stored, fresh, touched, suppress_ignored=True)) == [
        ("c", "r2", "ignored"), ("c", "r3", "active"), ("other", "r1", "active"),
    ]
    none = fresh.limit(0)
    assert rows(V.refresh_violations(stored, none, touched)) == [("c", "r2", "ignored"), ("other", "r1", "active")]


def test_recompute_uses_reviewed_values(make):
    ddl = "contract_id STRING, field_key STRING, value STRING, reviewed_value STRING, source_text STRING, confidence DOUBLE, pos INT"
    fields = make(
        ddl, ("c", "party-a-name", "x", "   ", None, 0.9, 1), ("c", "party-b-name", None, "y", None, 0.9, 2),
        ("d", "party-a-name", "x", "", None, None, 1), ("d", "party-b-name", "y", None, None, 0.9, 2),
    )
    found = V.recompute(fields, make("contract_id STRING", ("c",), ("d",)))
    assert sorted((r.contract_id, r.rule_key, r.field_key) for r in found.collect()) == [
        ("c", "required_fields", "party-a-name"), ("d", "low_confidence", "party-a-name"),
    ]


def test_registry_adds_user_rules(make):
    def long_value(fields, contracts):
        return fields.filter("length(value) > 3").selectExpr("contract_id", "'too long' AS message", "field_key", "1 AS item_order")

    V.register(V.Rule("long_value", "error", check=long_value))
    V.register(V.Rule("named_x", "warning", items=(("a.value = 'xxxx'", "'x'", "party-a-name"),)))
    try:
        fields = make(FIELDS, ("c", "party-a-name", "xxxx", None, 0.9, 1), ("c", "party-b-name", "y", None, 0.9, 2))
        found = V.validate(fields, make("contract_id STRING", ("c",)))
        assert [(r.rule_key, r.rule_order) for r in found.orderBy("rule_order").collect()] == [("long_value", 7), ("named_x", 8)]
        assert len(V.registered()) == 2
    finally:
        V.clear_rules()
    assert V.registered() == []


def test_violation_reviews(make):
    import datetime as dt

    t = lambda n: dt.datetime(2024, 1, 1, 0, n)
    violations = make(
        "id INT, status STRING, ignored_at TIMESTAMP, ignored_by STRING", (1, "active", None, None), (2, "ignored", t(0), "z"), (3, "active", None, None)
    )
    events = make(
        "event_id INT, target_id INT, action STRING, reviewer_id STRING, created_at TIMESTAMP",
        (1, 1, "approve", "a", t(1)), (2, 2, "reject", "b", t(2)), (3, 3, "modify", "c", t(3)), (4, 9, "approve", "d", t(4)),
    )
    out, refused = V.apply_violation_reviews(violations, events)
    assert sorted((r.id, r.status, r.ignored_by) for r in out.collect()) == [(1, "ignored", "a"), (2, "active", None), (3, "active", None)]
    assert sorted(r.event_id for r in refused.collect()) == [3, 4]


def test_reviews_reach_the_findings_of_every_rule(spark):
    from clauseloom.plans import registry

    sf = "/root/testdata/sf0.001"
    rows = registry.queries()["violation_reviews_every_rule"](spark, sf).collect()
    found = registry.queries()["validate_all"](spark, sf).collect()
    assert len({r.id for r in rows}) == len(rows) == len(found)
    kinds = {r.rule_key for r in found}
    assert len(kinds) > 1 and {r.rule_key for r in rows} == kinds
    assert {r.rule_key for r in rows if r.status == "ignored"} > {"required_fields"}
