"""Validation rules over the long field table.

Most rules read a few named values of a contract. Those come from one row per
contract, so the rule set costs a single aggregation on ``contract_id`` and
one pass over its result. The aggregates are mergeable: a contract with very
many rows is reduced before the shuffle. When a key occurs more than once the
last one (by ``pos``) counts.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauseloom.functions.numbers import double_to_text, formal_amount, norm_date, text_to_double
from clauseloom.functions.text import WS, blank_to_null, effective_value, regex
from clauseloom.operators.ordered import null_safe_join

K = "contract_id"

# Required keys with their labels, in report order.
REQUIRED = [("party-a-name", "甲方"), ("party-b-name", "乙方")]
LOW_CONFIDENCE = 0.7

# Amount patterns, first match of each in the source text.
FORMAL_RUN = "[人民币RMB￥]*" + WS + "*((?:[壹贰叁肆伍陆柒捌玖拾佰仟万亿零元整圆角分，、]|" + WS + ")+)"
FORMAL_RUN_STRICT = r"(?U)([壹贰叁肆伍陆柒捌玖拾佰仟万亿零][壹贰叁肆伍陆柒捌玖拾佰仟万亿零元整圆角分，、\s]*)"
FIGURES = rf"(?U)[¥￥]{WS}*([\d,]+\.?\d*)"
RATIO_KEY = "ratio|付款比例"

# Clause kinds a software contract must have, with title keywords.
CLAUSE_KINDS = [
    ("payment", ("付款", "支付")),
    ("delivery", ("交付",)),
    ("acceptance", ("验收",)),
    ("intellectual_property", ("知识产权", "产权")),
    ("breach", ("违约",)),
    ("dispute", ("争议",)),
]
CLAUSE_TYPES = ("service", "development")

COLUMNS = [K, "rule_key", "severity", "message", "field_key", "item_order", "rule_order"]


@dataclass(frozen=True)
class Rule:
    """A named rule.

    A set rule has ``check``: (fields, contracts) to rows of ``contract_id,
    message, field_key, item_order``. A value rule has ``items``: named values
    of the wide contract row, as (condition, message, field_key) SQL. All value
    rules of a run are evaluated together in one pass.

    ``inputs`` is an SQL condition on ``field_key``: the fields that the rule
    reads. A rule that does not say reads all of them.
    """

    name: str
    severity: str
    check: Callable[[DataFrame, DataFrame], DataFrame] | None = None
    items: tuple[tuple[str, str, str], ...] = ()
    inputs: str = "true"


_registry: list[Rule] = []


def register(rule: Rule) -> None:
    """Add a rule behind the ones already registered."""
    _registry.append(rule)


def registered() -> list[Rule]:
    return list(_registry)


def clear_rules() -> None:
    _registry.clear()


def _reads(*keys: str) -> str:
    return f"field_key IN ({', '.join(repr(k) for k in keys)})"


def _with_pos(fields: DataFrame) -> DataFrame:
    return fields if "pos" in fields.columns else fields.selectExpr("*", "0 AS pos")


def widen(fields: DataFrame, contracts: DataFrame, strict: bool = False) -> DataFrame:
    """One row per contract with the values the value rules read.

    Columns a, b, eff, fin, sig, amt hold the six named fields as structs
    (NULL when absent); ``*_date``, ``amount``, ``run`` and ``figures`` are
    parsed once here. ``strict`` checks dates as calendar dates and asks the
    numeral run to start with a numeral, so that a stray comma or unit before
    it is not mistaken for the amount.
    """
    slots = {
        "a": "party-a-name", "b": "party-b-name", "eff": "effective-date",
        "fin": "end-date", "sig": "sign-date", "amt": "contract-amount",
    }
    picks = [
        F.expr(f"max_by(struct(value, source_text), pos) FILTER (WHERE field_key = '{key}') AS {slot}")
        for slot, key in slots.items()
    ]
    keys = ", ".join(f"'{k}'" for k in slots.values())
    named = _with_pos(fields).filter(f"field_key IN ({keys})").groupBy(K).agg(*picks)
    run = FORMAL_RUN_STRICT if strict else FORMAL_RUN
    values = named.selectExpr(
        K, "a", "b",
        "nullif(eff.value, '') AS eff", "nullif(fin.value, '') AS fin", "nullif(sig.value, '') AS sig",
        "nullif(amt.value, '') AS amt",
        f"nullif(regexp_extract(amt.source_text, {regex(run)}, 1), '') AS run",
        f"nullif(replace(regexp_extract(amt.source_text, {regex(FIGURES)}, 1), ',', ''), '') AS figures",
    )
    parsed = values.selectExpr(
        "*",
        f"{norm_date('eff', strict)} AS eff_date", f"{norm_date('fin', strict)} AS fin_date",
        f"{norm_date('sig', strict)} AS sig_date",
        f"{text_to_double('''replace(amt, ',', '')''')} AS amount",
        f"{formal_amount('run')} AS formal", f"{text_to_double('figures')} AS low",
    )
    return contracts.select(K).distinct().join(parsed, K, "left")


def _required_items() -> list[tuple[str, str, str]]:
    items = []
    for slot, (key, label) in zip(("a", "b"), REQUIRED):
        blank = f"{blank_to_null(f'{slot}.value')} IS NULL"
        message = (
            f"CASE WHEN {slot} IS NULL THEN '缺少必要字段: {label} ({key})' "
            f"ELSE '必要字段值为空: {label} ({key})' END"
        )
        items.append((blank, message, key))
    return items


def payment_ratio(fields: DataFrame, contracts: DataFrame) -> DataFrame:
    """Ratio fields of a contract should sum to 100 within one point.

    Duplicates are reduced per (contract, key) first; the field named is the
    first ratio key seen.
    """
    ratios = _with_pos(fields).filter(f"field_key RLIKE '{RATIO_KEY}'")
    per_key = ratios.groupBy(K, "field_key").agg(
        F.expr("max_by(value, pos) AS value"), F.expr("min(pos) AS pos")
    )
    number = text_to_double(f"regexp_replace(value, {regex('[%％]')}, '')")
    parsed = per_key.selectExpr(K, "field_key", "pos", f"{number} AS ratio")
    known = "FILTER (WHERE ratio IS NOT NULL)"
    parts = f"array_sort(collect_list(struct(pos, field_key, {double_to_text('ratio')} AS t)) {known})"
    per_contract = parsed.groupBy(K).agg(
        F.expr("sum(ratio) AS total"),
        F.expr("count(ratio) AS n"),
        F.expr(f"min_by(field_key, struct(pos, field_key)) {known} AS field_key"),
        F.expr(f"{parts} AS parts"),
    )
    message = (
        "concat('付款比例合计为', format_number(total, '0.0'), '%，不等于100% (共', n, '期: ', "
        "array_join(transform(parts, p -> concat(p.t, '%')), ', '), ')')"
    )
    return per_contract.filter("n >= 2 AND NOT isnan(total) AND abs(total - 100) > 1").selectExpr(
        K, f"{message} AS message", "field_key", "1 AS item_order"
    )


def low_confidence(fields: DataFrame, contracts: DataFrame) -> DataFrame:
    message = r"concat('字段 \'', field_key, '\' 置信度过低: ', format_number(confidence, '0.00'))"
    return _with_pos(fields).filter(f"confidence < {LOW_CONFIDENCE} AND NOT isnan(confidence)").selectExpr(
        K, f"{message} AS message", "field_key", "CAST(pos AS INT) AS item_order"
    )


BUILTIN = [
    Rule("required_fields", "error", items=tuple(_required_items()), inputs=_reads("party-a-name", "party-b-name")),
    Rule(
        "date_consistency", "warning",
        items=(
            ("eff_date > fin_date", "concat('生效日期(', eff, ')晚于终止日期(', fin, ')')", "effective-date"),
            ("sig_date > fin_date", "concat('签署日期(', sig, ')晚于终止日期(', fin, ')')", "sign-date"),
        ),
        inputs=_reads("effective-date", "end-date", "sign-date"),
    ),
    Rule(
        "amount_consistency", "error",
        items=(
            (
                "abs(formal - low) > 0.01",
                "concat('大写金额(', run, ')与小写金额(', format_number(low, 2), ')不一致')",
                "contract-amount",
            ),
        ),
        inputs=_reads("contract-amount"),
    ),
    Rule("payment_ratio", "warning", check=payment_ratio, inputs=f"field_key RLIKE '{RATIO_KEY}'"),
    Rule(
        "financial_consistency", "warning",
        items=(
            (
                "amt IS NOT NULL AND (amount IS NULL OR amount <= 0)",
                "CASE WHEN amount IS NULL THEN concat('合同金额格式异常: ', amt) "
                "WHEN amount < 0 THEN concat('合同金额为负数: ', amt) ELSE '合同金额为零' END",
                "contract-amount",
            ),
        ),
        inputs=_reads("contract-amount"),
    ),
    Rule("low_confidence", "warning", check=low_confidence),
]


def _value_findings(wide: DataFrame, rules: list[tuple[int, Rule]]) -> DataFrame:
    """Findings of all value rules from one scan of the wide rows."""
    found = [
        f"struct('{rule.name}' AS rule_key, '{rule.severity}' AS severity, "
        f"CASE WHEN {condition} THEN {message} END AS message, "
        f"'{key}' AS field_key, {item} AS item_order, {order} AS rule_order)"
        for order, rule in rules
        for item, (condition, message, key) in enumerate(rule.items, start=1)
    ]
    return wide.selectExpr(K, f"inline(array({', '.join(found)}))").filter("message IS NOT NULL").select(*COLUMNS)


def validate(
    fields: DataFrame,
    contracts: DataFrame,
    clauses: DataFrame | None = None,
    rules: list[Rule] | None = None,
    strict: bool = False,
) -> DataFrame:
    """All violations with their rule position; built-ins, registered rules, clause check last."""
    rules = [*BUILTIN, *registered()] if rules is None else rules
    numbered = list(enumerate(rules, start=1))
    by_value = [(order, rule) for order, rule in numbered if rule.items]
    found = [_value_findings(widen(fields, contracts, strict), by_value)] if by_value else []
    for order, rule in numbered:
        if rule.check:
            tag = f"'{rule.name}' AS rule_key", f"'{rule.severity}' AS severity", f"{order} AS rule_order"
            found.append(rule.check(fields, contracts).selectExpr("*", *tag).select(*COLUMNS))
    if clauses is not None:
        found.append(clause_completeness(contracts, clauses).selectExpr("*", f"{len(rules) + 1} AS rule_order"))
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out


def clause_completeness(contracts: DataFrame, clauses: DataFrame) -> DataFrame:
    """Software contracts must have a clause title for each required kind.

    Titles are reduced to one flag per kind and contract before the join;
    only contracts that have a clause list are judged.
    """
    flags = [
        F.expr(
            "coalesce(bool_or(" + " OR ".join(f"contains(clause_title, '{w}')" for w in words) + f"), false) AS {kind}"
        )
        for kind, words in CLAUSE_KINDS
    ]
    present = clauses.groupBy(K).agg(*flags)
    types = ", ".join(f"'{t}'" for t in CLAUSE_TYPES)
    judged = contracts.filter(f"contract_type IN ({types})").select(K).join(present, K)
    found = ", ".join(
        f"struct(CASE WHEN NOT {kind} THEN '软件开发类合同缺少必要条款: {kind}' END AS message, {order} AS item_order)"
        for order, (kind, _) in enumerate(CLAUSE_KINDS, start=1)
    )
    return judged.selectExpr(K, f"inline(array({found}))").filter("message IS NOT NULL").selectExpr(
        K, "'clause_completeness' AS rule_key", "'warning' AS severity", "message",
        "CAST(NULL AS STRING) AS field_key", "item_order",
    )


def verdict(violations: DataFrame, contracts: DataFrame) -> DataFrame:
    """A contract passes unless it has an error; no findings is a pass."""
    counts = violations.groupBy(K).agg(
        F.expr("count(*) AS n"), F.expr("count_if(severity = 'error') AS e")
    )
    return contracts.select(K).distinct().join(counts, K, "left").selectExpr(
        K, "coalesce(n, 0) AS violations", "coalesce(e, 0) AS errors", "coalesce(e, 0) = 0 AS passed"
    )


def refresh_violations(
    stored: DataFrame, fresh: DataFrame, validated: DataFrame, suppress_ignored: bool = False
) -> DataFrame:
    """New state of the violation table after re-validating some contracts.

    For a validated contract the active rows go, ignored ones stay, and fresh
    findings come in as active, also when they equal an ignored one. With
    ``suppress_ignored`` such a finding stays dismissed. Other contracts are
    left alone.
    """
    touched = validated.select(K).distinct()
    flagged = stored.join(touched.selectExpr(K, "true AS __touched"), K, "left")
    kept = flagged.filter("__touched IS NULL OR status <> 'active'").drop("__touched")
    new = fresh.join(touched, K, "left_semi").selectExpr("*", "'active' AS status")
    if suppress_ignored:
        natural = [K, "rule_key", "field_key"]
        ignored = stored.filter("status = 'ignored'").select(*natural).distinct().selectExpr("*", "true AS __old")
        new = null_safe_join(new, ignored, natural, "left").filter("__old IS NULL").drop("__old")
    return kept.unionByName(new, allowMissingColumns=True)


def _effective(fields: DataFrame) -> DataFrame:
    swap = {
        "value": f"{effective_value('reviewed_value', 'value')} AS value",
        "confidence": "coalesce(confidence, 0D) AS confidence",
    }
    return fields.selectExpr(*[swap.get(c, c) for c in fields.columns])


def recompute(fields: DataFrame, contracts: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """Validate reviewed values where given; a missing confidence counts as 0."""
    return validate(_effective(fields), contracts, rules=rules)


def touched_rules(edits: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """(contract_id, rule_key) of the rules that read one of the edited fields.

    ``edits``: contract_id, field_key. The index from field to rules is made
    of the rules' own ``inputs`` and is as small as the list of rules, so it
    is evaluated in place, without a join.
    """
    rules = [*BUILTIN, *registered()] if rules is None else rules
    hit = ", ".join(f"CASE WHEN {rule.inputs} THEN '{rule.name}' END" for rule in rules)
    return edits.selectExpr(K, f"explode(array({hit})) AS rule_key").filter("rule_key IS NOT NULL").distinct()


def recompute_touched(
    stored: DataFrame, fields: DataFrame, contracts: DataFrame, edits: DataFrame, rules: list[Rule] | None = None
) -> DataFrame:
    """``recompute`` after edits, worked out for the touched (contract, rule) pairs alone.

    ``stored`` are the findings before the edits, ``fields`` the state after
    them. Rules that no edit touches are not evaluated in any contract; the
    others see the fields of edited contracts only.
    """
    rules = [*BUILTIN, *registered()] if rules is None else rules
    pairs = touched_rules(edits, rules)
    some = edits.select(K).distinct()
    fresh = recompute(fields.join(some, K, "left_semi"), contracts.join(some, K, "left_semi"), rules)
    kept = stored.join(pairs, [K, "rule_key"], "left_anti")
    return kept.unionByName(fresh.join(pairs, [K, "rule_key"], "left_semi"))


def apply_violation_reviews(violations: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ignore (approve) or restore (reject) violations by their last event.

    Returns (violations, events refused because of another action or an
    unknown target).
    """
    valid = events.filter("action IN ('approve', 'reject')")
    last = valid.groupBy("target_id").agg(
        F.expr("max_by(struct(action, reviewer_id, created_at), struct(created_at, event_id)) AS e")
    ).selectExpr("target_id AS __id", "e")
    out = violations.join(last, F.expr("id = __id"), "left")
    swap = {
        "status": "CASE e.action WHEN 'approve' THEN 'ignored' WHEN 'reject' THEN 'active' ELSE status END AS status",
        "ignored_at": "CASE e.action WHEN 'approve' THEN e.created_at WHEN 'reject' THEN NULL ELSE ignored_at END AS ignored_at",
        "ignored_by": "CASE e.action WHEN 'approve' THEN e.reviewer_id WHEN 'reject' THEN NULL ELSE ignored_by END AS ignored_by",
    }
    out = out.selectExpr(*[swap.get(c, c) for c in violations.columns])
    unknown = valid.join(violations.selectExpr("id AS target_id"), "target_id", "left_anti").select(*events.columns)
    refused = events.filter("action IS NULL OR action NOT IN ('approve', 'reject')").unionByName(unknown)
    return out, refused


def violation_summary(violations: DataFrame) -> DataFrame:
    """Counts per contract and field; contract-level findings have a NULL field."""
    return violations.groupBy(K, "field_key").agg(
        F.expr("count(*) AS violations"),
        F.expr("count_if(status = 'active') AS active"),
        F.expr("count_if(status = 'active' AND severity = 'error') AS active_errors"),
        F.expr("count_if(status = 'active' AND severity = 'warning') AS active_warnings"),
    )


def violation_groups(violations: DataFrame) -> DataFrame:
    """The findings themselves per contract and field, in rule order."""
    item = "struct(rule_order, item_order, rule_key, severity, message, status)"
    return violations.groupBy(K, "field_key").agg(F.expr(f"array_sort(collect_list({item})) AS items"))
