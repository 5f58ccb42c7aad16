"""Registered queries of review, audit and evaluation, each next to its reference SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from clauseloom.operators import clauses as C
from clauseloom.operators import evaluation as M
from clauseloom.operators import review as R
from clauseloom.plans import adapters as A
from clauseloom.plans.clause_queries import BLOCKS, CLAUSE_TITLES_SQL

_STATE = ["contract_id", "field_key", "value", "reviewed_value", "review_status", "reviewer_id", "reviewed_at"]


def review_state(spark, sf_dir):
    return R.apply_field_reviews(A.stored_fields(spark, sf_dir), A.reviews(spark, sf_dir)).select(*_STATE)


def batch_review(spark, sf_dir):
    return R.apply_batch_reviews(A.stored_fields(spark, sf_dir), A.reviews(spark, sf_dir)).select(*_STATE)


def review_audit(spark, sf_dir):
    return R.field_audit(A.stored_fields(spark, sf_dir), A.reviews(spark, sf_dir))


def batch_audit(spark, sf_dir):
    return R.batch_audit(A.reviews(spark, sf_dir))


def clause_review(spark, sf_dir):
    clauses = A.blocks(spark, sf_dir).selectExpr("contract_id", "page_no * 20 + sort_order AS sort_order", "'pending' AS review_status")
    events = A.reviews(spark, sf_dir).selectExpr(
        "event_id", "contract_id", "CAST(20 + event_id % 7 AS INT) AS sort_order",
        "CASE action WHEN 'reject' THEN 'rejected' WHEN 'modify' THEN 'approved' ELSE action END AS action", "created_at",
    )
    return R.apply_clause_reviews(clauses, events)


def _requests(spark, sf_dir):
    """Each event asks for corrections of up to two fields; some name a field that does not exist."""
    lists = """CASE WHEN event_id % 4 = 0 THEN CAST(array() AS ARRAY<STRUCT<field_key: STRING, corrected_value: STRING, comment: STRING>>)
      WHEN event_id % 4 = 1 THEN array(struct(field_key, concat('c', event_id) AS corrected_value, CAST(NULL AS STRING) AS comment))
      ELSE array(struct(field_key, concat('c', event_id) AS corrected_value, 'why' AS comment),
                 struct(CASE WHEN event_id % 9 = 2 THEN 'no-such-field' ELSE 'sign-date' END AS field_key, concat('d', event_id) AS corrected_value, 'too' AS comment)) END AS corrections"""
    return A.reviews(spark, sf_dir).selectExpr(
        "event_id", "contract_id", "CASE WHEN event_id % 3 = 0 THEN 'reviewed' WHEN event_id % 3 = 1 THEN 'corrected' ELSE 'rejected' END AS action",
        "CASE WHEN event_id % 8 = 4 THEN 'note' END AS comment", "reviewer_id", "created_at", lists,
    )


def corrections_state(spark, sf_dir):
    return R.apply_corrections(A.stored_fields(spark, sf_dir), _requests(spark, sf_dir))[0].select(*_STATE)


def corrections_audit(spark, sf_dir):
    return R.apply_corrections(A.stored_fields(spark, sf_dir), _requests(spark, sf_dir))[1]


def corrections_refused(spark, sf_dir):
    return R.apply_corrections(A.stored_fields(spark, sf_dir), _requests(spark, sf_dir))[2]


def _decisions(spark, sf_dir, action):
    return A.reviews(spark, sf_dir).filter(F.col("action") == action)


def approve_contracts(spark, sf_dir):
    approvals = _decisions(spark, sf_dir, "approve")
    pending = A.stored_fields(spark, sf_dir).selectExpr(
        "contract_id", "field_key", "CASE WHEN pos % 2 = 0 THEN 'pending' ELSE review_status END AS review_status"
    )
    contracts, fields = R.approve_contracts(A.contracts(spark, sf_dir), pending, approvals)
    return fields.join(contracts.select("contract_id", "status"), "contract_id")


def reject_contracts(spark, sf_dir):
    return R.reject_contracts(A.contracts(spark, sf_dir), _decisions(spark, sf_dir, "reject")).select("contract_id", "status")


def contract_audit(spark, sf_dir):
    return R.contract_audit(_decisions(spark, sf_dir, "approve"), "approve")


def audit_page(spark, sf_dir):
    audit = R.field_audit(A.stored_fields(spark, sf_dir), A.reviews(spark, sf_dir))
    return R.review_history(audit, 7, "field", page=1, page_size=5).select("event_id", "contract_id", "action", "created_at", "total")


def review_queue(spark, sf_dir):
    reviewed = R.apply_field_reviews(A.stored_fields(spark, sf_dir), A.reviews(spark, sf_dir))
    return R.review_queue(reviewed).select("contract_id", "field_key", "score", "review_label")


def _golden(spark, sf_dir):
    return A.fields(spark, sf_dir).selectExpr(
        "contract_id", "field_key",
        "CASE WHEN contract_id % 9 = 0 THEN concat(value, 'x') WHEN contract_id % 8 = 0 THEN NULL ELSE value END AS expected",
    )


def _verdicts(spark, sf_dir):
    answers = A.fields(spark, sf_dir).selectExpr(
        "contract_id", "field_key", "CASE WHEN (contract_id + pos) % 6 = 0 THEN NULL ELSE value END AS value"
    )
    return M.field_verdicts(answers, _golden(spark, sf_dir))


def field_verdicts(spark, sf_dir):
    return _verdicts(spark, sf_dir)


def accuracy(spark, sf_dir):
    return M.accuracy(_verdicts(spark, sf_dir))


def accuracy_by_field(spark, sf_dir):
    return M.accuracy(_verdicts(spark, sf_dir), ["field_key"])


def accuracy_by_contract(spark, sf_dir):
    return M.accuracy(_verdicts(spark, sf_dir), ["contract_id"])


def accuracy_report(spark, sf_dir):
    return M.accuracy_report(_verdicts(spark, sf_dir))


def quality_report(spark, sf_dir):
    fields = R.apply_field_reviews(A.stored_fields(spark, sf_dir), A.reviews(spark, sf_dir))
    return M.quality_report(fields, _golden(spark, sf_dir))


def clause_list(spark, sf_dir):
    return C.list_clauses(C.split_clauses(A.blocks(spark, sf_dir)), 3).select("contract_id", "sort_order", "clause_title")


QUERIES = {
    "review_state": review_state, "batch_review": batch_review, "review_audit": review_audit, "batch_audit": batch_audit,
    "clause_review": clause_review, "corrections_state": corrections_state, "corrections_audit": corrections_audit,
    "corrections_refused": corrections_refused, "approve_contracts": approve_contracts, "reject_contracts": reject_contracts,
    "contract_audit": contract_audit, "audit_page": audit_page, "review_queue": review_queue, "field_verdicts": field_verdicts,
    "accuracy": accuracy, "accuracy_by_field": accuracy_by_field, "accuracy_by_contract": accuracy_by_contract,
    "accuracy_report": accuracy_report, "quality_report": quality_report, "clause_list": clause_list,
}

# --- reference SQL -----------------------------------------------------------

_BASE = f"WITH fields AS ({A.FIELDS_SQL}), reviews AS ({A.REVIEWS_SQL})"


def _state(change: str) -> str:
    return f"""{_BASE}, ev AS (SELECT *, row_number() OVER (PARTITION BY contract_id, field_key ORDER BY created_at DESC, event_id DESC) AS rn FROM reviews),
 chg AS (SELECT *, row_number() OVER (PARTITION BY contract_id, field_key ORDER BY created_at DESC, event_id DESC) AS rn FROM reviews WHERE {change}),
 state AS (SELECT f.contract_id, f.field_key, f.value, f.confidence, c.new_value AS reviewed_value,
   CASE WHEN e.action IS NULL THEN 'extracted' WHEN {change.replace('action', 'e.action').replace('new_value', 'e.new_value')} THEN 'corrected'
     WHEN e.action = 'approve' THEN 'approved' WHEN e.action = 'reject' THEN 'rejected' ELSE e.action END AS review_status,
   e.reviewer_id, e.created_at AS reviewed_at FROM fields f
   LEFT JOIN ev e ON e.contract_id = f.contract_id AND e.field_key = f.field_key AND e.rn = 1
   LEFT JOIN chg c ON c.contract_id = f.contract_id AND c.field_key = f.field_key AND c.rn = 1)"""


_COLS = "contract_id, field_key, value, reviewed_value, review_status, reviewer_id, reviewed_at"
_FIELD_CHANGE = "action = 'modify' AND new_value IS NOT NULL"
_AUDIT = f"""{_BASE}, audit AS (SELECT event_id, r.contract_id, 'field' AS target_type, r.field_key AS target_id, action, f.value AS old_value,
   new_value, reviewer_id, created_at FROM reviews r JOIN fields f ON f.contract_id = r.contract_id AND f.field_key = r.field_key)"""

_CORR = f"""WITH fields AS MATERIALIZED ({A.FIELDS_SQL}), reviews AS MATERIALIZED ({A.REVIEWS_SQL}), req AS (SELECT event_id, contract_id, field_key, reviewer_id, created_at,
   CASE WHEN event_id % 3 = 0 THEN 'reviewed' WHEN event_id % 3 = 1 THEN 'corrected' ELSE 'rejected' END AS action,
   CASE WHEN event_id % 8 = 4 THEN 'note' END AS comment FROM reviews),
 items AS (SELECT event_id, contract_id, action, reviewer_id, created_at, 0 AS pos, field_key, concat('c', CAST(event_id AS VARCHAR)) AS new_value,
     CASE WHEN event_id % 4 = 1 THEN NULL ELSE 'why' END AS comment FROM req WHERE event_id % 4 <> 0
   UNION ALL SELECT event_id, contract_id, action, reviewer_id, created_at, 1, CASE WHEN event_id % 9 = 2 THEN 'no-such-field' ELSE 'sign-date' END,
     concat('d', CAST(event_id AS VARCHAR)), 'too' FROM req WHERE event_id % 4 > 1),
 refused AS MATERIALIZED (SELECT DISTINCT event_id FROM items LEFT JOIN (SELECT contract_id, field_key, 1 AS known FROM fields) USING (contract_id, field_key) WHERE known IS NULL),
 good AS (SELECT i.* FROM items i LEFT JOIN (SELECT event_id, 1 AS gone FROM refused) r ON r.event_id = i.event_id WHERE gone IS NULL),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY contract_id, field_key ORDER BY created_at DESC, event_id DESC, pos DESC) AS rn FROM good)"""

_VERDICTS = f"""WITH raw AS MATERIALIZED ({A.FIELDS_SQL}), both_sides AS (SELECT contract_id, field_key,
   trim(coalesce(CASE WHEN contract_id % 9 = 0 THEN value || 'x' WHEN contract_id % 8 = 0 THEN NULL ELSE value END, '')) AS golden,
   trim(coalesce(CASE WHEN (contract_id + pos) % 6 = 0 THEN NULL ELSE value END, '')) AS extracted FROM raw),
 verdicts AS (SELECT contract_id, field_key, golden, extracted,
   CASE WHEN extracted = golden THEN 'tp' WHEN extracted <> '' THEN 'fp' ELSE 'fn' END AS verdict FROM both_sides WHERE golden <> '')"""


def _accuracy(by: str) -> str:
    group = f"GROUP BY {by}" if by else ""
    cols = f"{by}, " if by else ""
    return f"""{_VERDICTS}, c AS (SELECT {cols} count(*) FILTER (WHERE verdict = 'tp') AS tp, count(*) FILTER (WHERE verdict = 'fp') AS fp,
   count(*) FILTER (WHERE verdict = 'fn') AS fn FROM verdicts {group}),
 r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS q FROM c)
 SELECT {cols} tp, fp, fn, round(p, 4) AS precision, round(q, 4) AS recall, round(CASE WHEN p + q > 0 THEN 2 * p * q / (p + q) ELSE 0 END, 4) AS f1 FROM r"""


_F1 = "round(CASE WHEN tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 4) AS f1"
_COUNTS = "count(*) FILTER (WHERE verdict = 'tp') AS tp, count(*) FILTER (WHERE verdict = 'fp') AS fp, count(*) FILTER (WHERE verdict = 'fn') AS fn"

ORACLES = {
    "review_state": f"{_state(_FIELD_CHANGE)} SELECT {_COLS} FROM state",
    "batch_review": f"""{_state("action = 'modify' AND new_value <> ''")} SELECT {_COLS} FROM state""",
    "review_audit": f"{_AUDIT} SELECT * FROM audit",
    "batch_audit": f"""{_BASE} SELECT event_id, contract_id, 'field' AS target_type, field_key AS target_id, action, CAST(NULL AS VARCHAR) AS old_value,
        new_value, reviewer_id, created_at FROM reviews""",
    "clause_review": f"""{BLOCKS}, reviews AS ({A.REVIEWS_SQL}), ev AS (SELECT contract_id, CAST(20 + event_id % 7 AS INT) AS so,
          CASE action WHEN 'reject' THEN 'rejected' WHEN 'modify' THEN 'approved' ELSE action END AS a,
          row_number() OVER (PARTITION BY contract_id, event_id % 7 ORDER BY created_at DESC, event_id DESC) AS rn FROM reviews)
        SELECT b.contract_id, b.page_no * 20 + b.sort_order AS sort_order,
          CASE WHEN a IS NULL THEN 'pending' WHEN a IN ('approved', 'rejected') THEN a ELSE 'reviewed' END AS review_status
        FROM blocks b LEFT JOIN ev ON ev.contract_id = b.contract_id AND so = b.page_no * 20 + b.sort_order AND rn = 1""",
    "corrections_state": f"""{_CORR} SELECT f.contract_id, f.field_key, f.value, r.new_value AS reviewed_value, coalesce(r.action, 'extracted') AS review_status,
        r.reviewer_id, r.created_at AS reviewed_at FROM fields f LEFT JOIN ranked r ON r.contract_id = f.contract_id AND r.field_key = f.field_key AND rn = 1""",
    "corrections_audit": f"""{_CORR} SELECT event_id, g.contract_id, 'field' AS target_type, g.field_key AS target_id, 'modify' AS action, f.value AS old_value,
          new_value, comment, reviewer_id, created_at FROM good g JOIN fields f ON f.contract_id = g.contract_id AND f.field_key = g.field_key
        UNION ALL SELECT event_id, contract_id, 'contract', CAST(contract_id AS VARCHAR), action, NULL, NULL, comment, reviewer_id, created_at
          FROM req WHERE event_id % 4 = 0 AND (action IN ('approved', 'reviewed') OR comment <> '')""",
    "corrections_refused": f"{_CORR} SELECT event_id FROM refused",
    "approve_contracts": f"""{_BASE}, c AS ({A.CONTRACTS_SQL}), ok AS (SELECT DISTINCT contract_id FROM reviews WHERE action = 'approve')
        SELECT f.contract_id, f.field_key, CASE WHEN pos % 2 = 0 THEN CASE WHEN ok.contract_id IS NOT NULL THEN 'approved' ELSE 'pending' END
          ELSE 'extracted' END AS review_status, CASE WHEN ok.contract_id IS NOT NULL THEN 'approved' ELSE c.status END AS status
        FROM fields f JOIN c ON c.contract_id = f.contract_id LEFT JOIN ok ON ok.contract_id = f.contract_id""",
    "reject_contracts": f"""WITH c AS ({A.CONTRACTS_SQL}), reviews AS ({A.REVIEWS_SQL}) SELECT contract_id,
        CASE WHEN contract_id IN (SELECT contract_id FROM reviews WHERE action = 'reject') THEN 'rejected' ELSE status END AS status FROM c""",
    "contract_audit": f"""WITH reviews AS ({A.REVIEWS_SQL}) SELECT event_id, contract_id, 'contract' AS target_type,
        CAST(contract_id AS VARCHAR) AS target_id, 'approve' AS action, reviewer_id, created_at FROM reviews WHERE action = 'approve'""",
    "audit_page": f"""{_AUDIT} SELECT event_id, contract_id, action, created_at, (SELECT count(*) FROM audit WHERE contract_id = 7) AS total
        FROM audit WHERE contract_id = 7 ORDER BY created_at DESC, event_id DESC LIMIT 5""",
    "review_queue": f"""{_state(_FIELD_CHANGE)} SELECT contract_id, field_key, confidence AS score, CASE review_status WHEN 'corrected' THEN '已修正'
        WHEN 'approved' THEN '已通过' WHEN 'rejected' THEN '已驳回' WHEN 'reviewed' THEN '已复核' ELSE '' END AS review_label
        FROM state WHERE confidence < 0.7""",
    "field_verdicts": f"{_VERDICTS} SELECT * FROM verdicts",
    "accuracy": _accuracy(""),
    "accuracy_by_field": _accuracy("field_key"),
    "accuracy_by_contract": _accuracy("contract_id"),
    "accuracy_report": f"""{_VERDICTS}, c AS (SELECT 'all' AS level, CAST(NULL AS BIGINT) AS contract_id, CAST(NULL AS VARCHAR) AS field_key, {_COUNTS} FROM verdicts
        UNION ALL SELECT 'field', NULL, field_key, {_COUNTS} FROM verdicts GROUP BY field_key
        UNION ALL SELECT 'contract', contract_id, NULL, {_COUNTS} FROM verdicts GROUP BY contract_id) SELECT *, {_F1} FROM c""",
    "quality_report": f"""{_state(_FIELD_CHANGE)}, golden AS (SELECT contract_id, field_key,
          trim(coalesce(CASE WHEN contract_id % 9 = 0 THEN value || 'x' WHEN contract_id % 8 = 0 THEN NULL ELSE value END, '')) AS golden FROM fields)
        SELECT s.field_key, count(*) AS fields, round(count(*) FILTER (WHERE coalesce(value, '') = '') / count(*), 4) AS null_rate,
          count(*) FILTER (WHERE golden <> '' AND (trim(coalesce(value, '')) = golden OR trim(coalesce(reviewed_value, '')) = golden)) AS hits,
          count(*) FILTER (WHERE golden <> '') AS scored
        FROM state s LEFT JOIN golden g ON g.contract_id = s.contract_id AND g.field_key = s.field_key GROUP BY s.field_key""",
    "clause_list": f"{CLAUSE_TITLES_SQL} SELECT contract_id, sort_order, clause_title FROM clauses WHERE contract_id = 3",
}
