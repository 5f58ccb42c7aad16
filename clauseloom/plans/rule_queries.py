"""Registered queries of the validation rules, each next to its reference SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseloom.operators import clauses as C
from clauseloom.operators import feed
from clauseloom.operators import rules as V
from clauseloom.plans import adapters as A
from clauseloom.plans.clause_queries import CLAUSE_TITLES_SQL

_OUT = ["contract_id", "rule_key", "severity", "message", "field_key", "item_order"]


def _rule(name: str):
    rule = next(r for r in V.BUILTIN if r.name == name)

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return V.validate(A.fields(spark, sf_dir), A.contracts(spark, sf_dir), rules=[rule]).drop("rule_order")

    return query


def _all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.validate(A.fields(spark, sf_dir), A.contracts(spark, sf_dir), rules=V.BUILTIN)


def contract_verdict(spark, sf_dir):
    return V.verdict(_all(spark, sf_dir), A.contracts(spark, sf_dir))


def violation_summary(spark, sf_dir):
    return V.violation_summary(_stored(spark, sf_dir))


def _stored(spark, sf_dir):
    """Findings of a first run; every tenth contract's were dismissed by a reviewer."""
    status = "CASE WHEN contract_id % 10 = 3 THEN 'ignored' ELSE 'active' END AS status"
    return _all(spark, sf_dir).selectExpr("*", status)


def _refreshed(spark, sf_dir, suppress_ignored):
    touched = A.contracts(spark, sf_dir).filter("contract_id % 2 = 1")
    fresh = _all(spark, sf_dir).filter("severity = 'error'")
    out = V.refresh_violations(_stored(spark, sf_dir), fresh, touched, suppress_ignored)
    return out.select(*_OUT, "rule_order", "status")


def refresh_violations(spark, sf_dir):
    return _refreshed(spark, sf_dir, False)


def refresh_violations_suppressed(spark, sf_dir):
    return _refreshed(spark, sf_dir, True)


#: What names a finding.
_FINDING = ["contract_id", "rule_key", "item_order", "status"]


def feed_refresh(spark, sf_dir):
    """What a refresh of the findings changes."""
    return feed.changes(_stored(spark, sf_dir).select(*_OUT, "rule_order", "status"), refresh_violations(spark, sf_dir), _FINDING)


def _reviewed(spark, sf_dir):
    reviewed = """CASE WHEN contract_id % 4 = 1 AND field_key = 'party-a-name' THEN '审核公司'
      WHEN contract_id % 4 = 2 AND field_key = 'party-a-name' THEN '   ' WHEN contract_id % 4 = 3 THEN '' END AS reviewed_value"""
    return A.fields(spark, sf_dir).selectExpr(
        "contract_id", "field_key", "pos", "value", "source_text", reviewed,
        "CASE WHEN contract_id % 9 <> 0 THEN confidence END AS confidence",
    )


def recompute_violations(spark, sf_dir):
    return V.recompute(_reviewed(spark, sf_dir), A.contracts(spark, sf_dir)).select(*_OUT, "rule_order")


def recompute_touched(spark, sf_dir):
    """The same from the findings before the reviews and the reviewed fields."""
    after, contracts = _reviewed(spark, sf_dir), A.contracts(spark, sf_dir)
    stored = V.recompute(after.withColumn("reviewed_value", F.lit(None).cast("string")), contracts)
    return V.recompute_touched(stored, after, contracts, after.filter("reviewed_value <> ''")).select(*_OUT, "rule_order")


#: A user's rule: contracts over a hundred thousand that name no end date.
OPEN_END = V.Rule(
    "open_end", "warning",
    items=(("amount > 100000 AND fin IS NULL", "concat('金额较大但无终止日期: ', amt)", "end-date"),),
    inputs="field_key IN ('contract-amount', 'end-date')",
)


def custom_rule(spark, sf_dir):
    """Validation with the built-in amount rule and a registered one."""
    before = V.registered()
    try:
        V.register(OPEN_END)
        rules = [r for r in V.BUILTIN if r.name == "financial_consistency"] + V.registered()[-1:]
        return V.validate(A.fields(spark, sf_dir), A.contracts(spark, sf_dir), rules=rules)
    finally:
        V.clear_rules()
        for rule in before:
            V.register(rule)


def violation_groups(spark, sf_dir):
    """The findings of each contract and field, as text in their order."""
    groups = V.violation_groups(_stored(spark, sf_dir))
    return groups.selectExpr("contract_id", "field_key", "array_join(transform(items, i -> concat(i.rule_key, ':', i.item_order, ':', i.status)), '|') AS items")


# A finding's own id; item_order is the field's position for low confidence.
_FINDING_ID = "CAST(contract_id AS BIGINT) * 100000 + rule_order * 10000 + item_order"
# The finding that a review event names; not all of them exist.
_EVENT_TARGET = "CAST(contract_id AS BIGINT) * 100000 + (1 + event_id % 6) * 10000 + 1 + event_id % 4"


def violation_reviews(spark, sf_dir):
    """The findings of all rules under review events that name one finding each."""
    events = A.reviews(spark, sf_dir).selectExpr("event_id", f"{_EVENT_TARGET} AS target_id", "action", "reviewer_id", "created_at")
    when = events.schema["created_at"].dataType.simpleString()
    violations = _all(spark, sf_dir).selectExpr(
        f"{_FINDING_ID} AS id", "contract_id", "rule_key", "field_key", "item_order", "'active' AS status",
        f"CAST(NULL AS {when}) AS ignored_at", "CAST(NULL AS STRING) AS ignored_by",
    )
    return V.apply_violation_reviews(violations, events)[0]


def clause_completeness(spark, sf_dir):
    kinds = A.table(spark, sf_dir, "documents").selectExpr(
        "doc_id AS contract_id", "CASE doc_id % 3 WHEN 0 THEN 'service' WHEN 1 THEN 'development' ELSE 'lease' END AS contract_type"
    )
    return V.clause_completeness(kinds, C.split_clauses(A.blocks(spark, sf_dir))).select(*_OUT)


QUERIES = {f"rule_{short}": _rule(name) for short, name in {
    "required": "required_fields", "dates": "date_consistency", "amount": "amount_consistency",
    "ratio": "payment_ratio", "financial": "financial_consistency", "confidence": "low_confidence",
}.items()}
QUERIES |= {
    "validate_all": _all,
    "contract_verdict": contract_verdict,
    "violation_summary": violation_summary,
    "refresh_violations": refresh_violations, "feed_refresh": feed_refresh,
    "refresh_violations_suppressed": refresh_violations_suppressed,
    "recompute_violations": recompute_violations, "recompute_touched": recompute_touched, "custom_rule": custom_rule, "violation_groups": violation_groups,
    "violation_reviews": violation_reviews,
    "clause_completeness": clause_completeness,
}

# --- reference SQL -----------------------------------------------------------

_WIDE = """wide AS (
  SELECT c.contract_id, bool_or(field_key = 'party-a-name') AS has_a, bool_or(field_key = 'party-b-name') AS has_b,
    max(value) FILTER (WHERE field_key = 'party-a-name') AS a, max(value) FILTER (WHERE field_key = 'party-b-name') AS b,
    nullif(max(value) FILTER (WHERE field_key = 'effective-date'), '') AS eff,
    nullif(max(value) FILTER (WHERE field_key = 'end-date'), '') AS fin,
    nullif(max(value) FILTER (WHERE field_key = 'sign-date'), '') AS sig,
    nullif(max(value) FILTER (WHERE field_key = 'contract-amount'), '') AS amt,
    max(source_text) FILTER (WHERE field_key = 'contract-amount') AS src
  FROM (SELECT o_orderkey AS contract_id FROM orders) c LEFT JOIN fields f ON f.contract_id = c.contract_id GROUP BY c.contract_id)"""

_MACRO_DATE = """CASE WHEN regexp_matches({0}, '^\\d{{4}}-\\d{{1,2}}-\\d{{1,2}}$') THEN {0}
  WHEN regexp_matches({0}, '^\\d{{4}}年\\d{{1,2}}月\\d{{1,2}}') THEN concat(regexp_extract({0}, '^(\\d{{4}})年', 1), '-',
    lpad(regexp_extract({0}, '年(\\d{{1,2}})月', 1), 2, '0'), '-', lpad(regexp_extract({0}, '月(\\d{{1,2}})', 1), 2, '0')) END"""


def _d(col: str) -> str:
    return _MACRO_DATE.format(col)


_REQUIRED = """SELECT contract_id, 'required_fields' AS rule_key, 'error' AS severity,
    CASE WHEN coalesce(has_a, false) THEN '必要字段值为空: 甲方 (party-a-name)' ELSE '缺少必要字段: 甲方 (party-a-name)' END AS message,
    'party-a-name' AS field_key, 1 AS item_order FROM wide WHERE coalesce(trim(a), '') = ''
  UNION ALL SELECT contract_id, 'required_fields', 'error',
    CASE WHEN coalesce(has_b, false) THEN '必要字段值为空: 乙方 (party-b-name)' ELSE '缺少必要字段: 乙方 (party-b-name)' END,
    'party-b-name', 2 FROM wide WHERE coalesce(trim(b), '') = ''"""

_DATES = f"""SELECT contract_id, 'date_consistency' AS rule_key, 'warning' AS severity,
    concat('生效日期(', eff, ')晚于终止日期(', fin, ')') AS message, 'effective-date' AS field_key, 1 AS item_order
    FROM wide WHERE {_d('eff')} > {_d('fin')}
  UNION ALL SELECT contract_id, 'date_consistency', 'warning', concat('签署日期(', sig, ')晚于终止日期(', fin, ')'), 'sign-date', 2
    FROM wide WHERE {_d('sig')} > {_d('fin')}"""

_CHARS = """list_transform(string_split(regexp_replace(regexp_replace(run, '[，、 ]', '', 'g'), '[元整圆]+$', ''), ''),
   lambda ch: {'t': 0.0::DOUBLE, 's': 0.0::DOUBLE, 'd': CASE ch WHEN '零' THEN 0 WHEN '壹' THEN 1 WHEN '贰' THEN 2 WHEN '叁' THEN 3
     WHEN '肆' THEN 4 WHEN '伍' THEN 5 WHEN '陆' THEN 6 WHEN '柒' THEN 7 WHEN '捌' THEN 8 WHEN '玖' THEN 9 WHEN '拾' THEN 10
     WHEN '佰' THEN 100 WHEN '仟' THEN 1000 WHEN '万' THEN 10000 WHEN '亿' THEN 100000000 ELSE -1 END::DOUBLE})"""

_AMOUNT = f"""SELECT contract_id, 'amount_consistency' AS rule_key, 'error' AS severity,
    concat('大写金额(', run, ')与小写金额(', printf('%,.2f', low), ')不一致') AS message, 'contract-amount' AS field_key, 1 AS item_order
  FROM (SELECT *, list_reduce(list_prepend({{'t': 0.0::DOUBLE, 's': 0.0::DOUBLE, 'd': 0.0::DOUBLE}}, {_CHARS}),
     lambda a, x: CASE WHEN x.d < 0 THEN a
       WHEN x.d >= 10000 THEN {{'t': a.t + (CASE WHEN a.s + a.d = 0 THEN 1 ELSE a.s + a.d END) * x.d, 's': 0.0::DOUBLE, 'd': 0.0::DOUBLE}}
       WHEN x.d >= 10 THEN {{'t': a.t, 's': a.s + (CASE WHEN a.d = 0 THEN 1 ELSE a.d END) * x.d, 'd': 0.0::DOUBLE}}
       ELSE {{'t': a.t, 's': a.s, 'd': x.d}} END) AS r
    FROM (SELECT contract_id, regexp_extract(src, '[人民币RMB￥]*\\s*([壹贰叁肆伍陆柒捌玖拾佰仟万亿零元整圆角分，、\\s]+)', 1) AS run,
            CAST(replace(regexp_extract(src, '[¥￥]\\s*([\\d,]+\\.?\\d*)', 1), ',', '') AS DOUBLE) AS low
          FROM wide WHERE regexp_matches(src, '[壹贰叁肆伍陆柒捌玖拾佰仟万亿零元整圆角分，、\\s]') AND regexp_matches(src, '[¥￥]\\s*[\\d,]')))
  WHERE abs(r.t + r.s + r.d - low) > 0.01"""

_RATIO = """SELECT contract_id, 'payment_ratio' AS rule_key, 'warning' AS severity,
    concat('付款比例合计为', printf('%.1f', sum(v)), '%，不等于100% (共', CAST(count(*) AS VARCHAR), '期: ',
      string_agg(concat(CAST(v AS VARCHAR), '%'), ', ' ORDER BY pos), ')') AS message,
    arg_min(field_key, pos) AS field_key, 1 AS item_order
  FROM (SELECT *, TRY_CAST(trim(replace(replace(value, '%', ''), '％', '')) AS DOUBLE) AS v FROM fields
        WHERE field_key LIKE '%ratio%' AND value <> '') WHERE v IS NOT NULL
  GROUP BY contract_id HAVING count(*) >= 2 AND abs(sum(v) - 100) > 1"""

_FINANCIAL = """SELECT contract_id, 'financial_consistency' AS rule_key, 'warning' AS severity,
    CASE WHEN n IS NULL THEN concat('合同金额格式异常: ', amt) WHEN n < 0 THEN concat('合同金额为负数: ', amt) ELSE '合同金额为零' END AS message,
    'contract-amount' AS field_key, 1 AS item_order
  FROM (SELECT *, TRY_CAST(replace(amt, ',', '') AS DOUBLE) AS n FROM wide WHERE amt IS NOT NULL) WHERE n IS NULL OR n <= 0"""

_CONFIDENCE = """SELECT contract_id, 'low_confidence' AS rule_key, 'warning' AS severity,
    concat('字段 ''', field_key, ''' 置信度过低: ', printf('%.2f', confidence)) AS message, field_key, pos AS item_order
  FROM fields WHERE confidence < 0.7"""

_PARTS = [_REQUIRED, _DATES, _AMOUNT, _RATIO, _FINANCIAL, _CONFIDENCE]
_FIELDS = f"WITH fields AS ({A.FIELDS_SQL}\n)"
_HEAD = f"{_FIELDS}, {_WIDE}"


def _all_cte(head: str = _HEAD) -> str:
    union = "\n UNION ALL ".join(f"SELECT *, {i} AS rule_order FROM ({p})" for i, p in enumerate(_PARTS, start=1))
    return f"{head}, found AS ({union})"


_STORED = "stored AS (SELECT *, CASE WHEN contract_id % 10 = 3 THEN 'ignored' ELSE 'active' END AS status FROM found)"
_O = "contract_id, rule_key, severity, message, field_key, item_order, rule_order, status"

_REVIEWED_FIELDS = f"""WITH raw AS ({A.FIELDS_SQL}
), fields AS (SELECT contract_id, field_key, pos, source_text,
    CASE WHEN contract_id % 4 = 1 AND field_key = 'party-a-name' THEN '审核公司'
         WHEN contract_id % 4 = 2 AND field_key = 'party-a-name' THEN '   ' ELSE value END AS value,
    CASE WHEN contract_id % 9 <> 0 THEN confidence ELSE 0.0 END AS confidence FROM raw)"""

_KINDS = [("payment", "付款|支付"), ("delivery", "交付"), ("acceptance", "验收"),
          ("intellectual_property", "知识产权|产权"), ("breach", "违约"), ("dispute", "争议")]
_COMPLETENESS = CLAUSE_TITLES_SQL + "\n UNION ALL ".join(
    f"""SELECT contract_id, 'clause_completeness' AS rule_key, 'warning' AS severity,
    '软件开发类合同缺少必要条款: {kind}' AS message, CAST(NULL AS VARCHAR) AS field_key, {i} AS item_order
    FROM titles WHERE contract_id % 3 < 2 GROUP BY contract_id
    HAVING NOT bool_or(coalesce(regexp_matches(clause_title, '{words}'), false))"""
    for i, (kind, words) in enumerate(_KINDS, start=1)
)

ORACLES = {
    "rule_required": f"{_HEAD} {_REQUIRED}",
    "rule_dates": f"{_HEAD} {_DATES}",
    "rule_amount": f"{_HEAD} {_AMOUNT}",
    "rule_ratio": f"{_FIELDS} {_RATIO}",
    "rule_financial": f"{_HEAD} {_FINANCIAL}",
    "rule_confidence": f"{_FIELDS} {_CONFIDENCE}",
    "validate_all": f"{_all_cte()} SELECT * FROM found",
    "contract_verdict": f"""{_all_cte()} SELECT c.o_orderkey AS contract_id, count(rule_key) AS violations,
        count(*) FILTER (WHERE severity = 'error') AS errors, count(*) FILTER (WHERE severity = 'error') = 0 AS passed
        FROM orders c LEFT JOIN found f ON f.contract_id = c.o_orderkey GROUP BY c.o_orderkey""",
    "violation_summary": f"""{_all_cte()}, {_STORED} SELECT contract_id, field_key, count(*) AS violations,
        count(*) FILTER (WHERE status = 'active') AS active,
        count(*) FILTER (WHERE status = 'active' AND severity = 'error') AS active_errors,
        count(*) FILTER (WHERE status = 'active' AND severity = 'warning') AS active_warnings
        FROM stored GROUP BY contract_id, field_key""",
    "refresh_violations": f"""{_all_cte()}, {_STORED}
        SELECT {_O} FROM stored WHERE contract_id % 2 = 0 OR status <> 'active'
        UNION ALL SELECT contract_id, rule_key, severity, message, field_key, item_order, rule_order, 'active' FROM found
        WHERE severity = 'error' AND contract_id % 2 = 1""",
    "refresh_violations_suppressed": f"""{_all_cte()}, {_STORED}
        SELECT {_O} FROM stored WHERE contract_id % 2 = 0 OR status <> 'active'
        UNION ALL SELECT contract_id, rule_key, severity, message, field_key, item_order, rule_order, 'active' FROM found
        WHERE severity = 'error' AND contract_id % 2 = 1 AND contract_id % 10 <> 3""",
    "recompute_violations": f"{_all_cte(_REVIEWED_FIELDS + ', ' + _WIDE)} SELECT * FROM found",
    "violation_reviews": f"""{_all_cte()}, reviews AS ({A.REVIEWS_SQL}
        ), last AS (SELECT {_EVENT_TARGET} AS k, arg_max(action, struct_pack(a := created_at, b := event_id)) AS action,
            arg_max(reviewer_id, struct_pack(a := created_at, b := event_id)) AS reviewer_id, max(created_at) AS created_at
            FROM reviews WHERE action IN ('approve', 'reject') GROUP BY k)
        SELECT {_FINDING_ID} AS id, contract_id, rule_key, field_key, item_order,
          CASE WHEN action = 'approve' THEN 'ignored' ELSE 'active' END AS status,
          CASE WHEN action = 'approve' THEN created_at END AS ignored_at,
          CASE WHEN action = 'approve' THEN reviewer_id END AS ignored_by
        FROM found LEFT JOIN last ON k = {_FINDING_ID}""",
    "clause_completeness": _COMPLETENESS,
}


def feed_sql(old: str, new: str, keys: list[str], rest: list[str]) -> str:
    """The rows in which two states differ, as SQL over their SQL."""
    on = " AND ".join(f"o.{k} IS NOT DISTINCT FROM n.{k}" for k in keys)
    named = ", ".join([*(f"coalesce(n.{k}, o.{k}) AS {k}" for k in keys), *(f"n.{c}" for c in rest)])
    same = " AND ".join(f"o.{c} IS NOT DISTINCT FROM n.{c}" for c in rest)
    return f"""WITH o AS (SELECT *, 1 AS had FROM ({old})), n AS (SELECT *, 1 AS has FROM ({new}))
        SELECT CASE WHEN had IS NULL THEN 'insert' WHEN has IS NULL THEN 'delete' ELSE 'update' END AS op, {named}
        FROM o FULL OUTER JOIN n ON {on} WHERE had IS NULL OR has IS NULL OR NOT ({same})"""


ORACLES |= {
    "recompute_touched": ORACLES["recompute_violations"],
    "custom_rule": f"""{_HEAD} SELECT *, 1 AS rule_order FROM ({_FINANCIAL}) UNION ALL
        SELECT contract_id, 'open_end', 'warning', concat('金额较大但无终止日期: ', amt), 'end-date', 1, 2
        FROM wide WHERE fin IS NULL AND TRY_CAST(replace(amt, ',', '') AS DOUBLE) > 100000""",
    "violation_groups": f"""{_all_cte()}, {_STORED} SELECT contract_id, field_key,
        string_agg(concat(rule_key, ':', CAST(item_order AS VARCHAR), ':', status), '|' ORDER BY rule_order, item_order) AS items
        FROM stored GROUP BY contract_id, field_key""",
}
ORACLES["feed_refresh"] = feed_sql(
    f"{_all_cte()}, {_STORED} SELECT {_O} FROM stored", ORACLES["refresh_violations"], _FINDING,
    ["severity", "message", "field_key", "rule_order"],
)

# All findings as a CTE list ending in "found"; "fields" is in it as well.
ALL_FINDINGS = _all_cte()
