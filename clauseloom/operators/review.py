"""Review events folded into current state.

Event lists are folded with mergeable aggregates (last event, last change), so
a target with very many events is reduced in every task before the shuffle.
Events are ordered by (created_at, event_id).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauseloom.functions.labels import review_label

K = "contract_id"
AT = "struct(created_at, event_id)"

_STATUS = "CASE WHEN {change} THEN 'corrected' WHEN action = 'approve' THEN 'approved' WHEN action = 'reject' THEN 'rejected' ELSE action END"


def _fold(fields: DataFrame, events: DataFrame, change: str) -> DataFrame:
    """Apply field events: status of the last one, value of the last change.

    The extracted ``value`` is never touched.
    """
    last = events.groupBy(K, "field_key").agg(
        F.expr(f"max_by(struct({_STATUS.format(change=change)} AS status, reviewer_id, created_at), {AT}) AS e"),
        F.expr(f"max_by(new_value, {AT}) FILTER (WHERE {change}) AS changed"),
    )
    swap = {
        "review_status": "coalesce(e.status, review_status) AS review_status",
        "reviewed_value": "coalesce(changed, reviewed_value) AS reviewed_value",
        "reviewer_id": "CASE WHEN e IS NOT NULL THEN e.reviewer_id ELSE reviewer_id END AS reviewer_id",
        "reviewed_at": "coalesce(e.created_at, reviewed_at) AS reviewed_at",
    }
    return fields.join(last, [K, "field_key"], "left").selectExpr(*[swap.get(c, c) for c in fields.columns])


def apply_field_reviews(fields: DataFrame, events: DataFrame) -> DataFrame:
    """Single-field reviews: a modify counts when it carries a value, even ''."""
    return _fold(fields, events, "coalesce(action = 'modify' AND new_value IS NOT NULL, false)")


def apply_batch_reviews(fields: DataFrame, events: DataFrame) -> DataFrame:
    """Batch reviews: a modify counts only with a non-empty value."""
    return _fold(fields, events, "coalesce(action = 'modify' AND new_value <> '', false)")


def field_audit(fields: DataFrame, events: DataFrame) -> DataFrame:
    """Audit rows of single-field reviews, with the extracted value as the old one."""
    known = fields.selectExpr(K, "field_key", "value AS old_value")
    return events.join(known, [K, "field_key"]).selectExpr(
        "event_id", K, "'field' AS target_type", "field_key AS target_id", "action", "old_value", "new_value",
        "reviewer_id", "created_at",
    )


def batch_audit(events: DataFrame) -> DataFrame:
    """Audit rows of batch reviews: no old value, unknown targets included."""
    return events.selectExpr(
        "event_id", K, "'field' AS target_type", "field_key AS target_id", "action", "CAST(NULL AS STRING) AS old_value",
        "new_value", "reviewer_id", "created_at",
    )


def apply_clause_reviews(clauses: DataFrame, events: DataFrame) -> DataFrame:
    """Status of the last event, where anything but approved or rejected means reviewed."""
    last = events.groupBy(K, "sort_order").agg(F.expr(f"max_by(action, {AT}) AS a"))
    status = (
        "CASE WHEN a IS NULL THEN review_status WHEN a IN ('approved', 'rejected') THEN a ELSE 'reviewed' END AS review_status"
    )
    swap = {"review_status": status}
    return clauses.join(last, [K, "sort_order"], "left").selectExpr(*[swap.get(c, c) for c in clauses.columns])


def apply_corrections(
    fields: DataFrame, requests: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Review requests that correct several fields at once.

    ``requests``: event_id, contract_id, action, comment, reviewer_id,
    created_at, corrections array<struct<field_key, corrected_value, comment>>.
    Returns (fields, audit rows, refused event_ids). A request naming a field
    its contract does not have is refused as a whole. Without corrections an
    approved or reviewed request, or any request with a comment, leaves one
    audit row on the contract.
    """
    items = requests.selectExpr(
        "event_id", K, "action", "reviewer_id", "created_at", "posexplode(corrections) AS (pos, c)"
    ).selectExpr(
        "event_id", K, "action", "reviewer_id", "created_at", "pos", "c.field_key AS field_key",
        "c.corrected_value AS new_value", "c.comment AS comment",
    )
    known = fields.selectExpr(K, "field_key", "value AS old_value")
    refused = items.join(known, [K, "field_key"], "left_anti").select("event_id").distinct()
    good = items.join(refused, "event_id", "left_anti")
    order = "struct(created_at, event_id, pos)"
    last = good.groupBy(K, "field_key").agg(
        F.expr(f"max_by(struct(new_value, action, reviewer_id, created_at), {order}) AS e")
    )
    swap = {
        "review_status": "coalesce(e.action, review_status) AS review_status",
        "reviewed_value": "CASE WHEN e IS NOT NULL THEN e.new_value ELSE reviewed_value END AS reviewed_value",
        "reviewer_id": "CASE WHEN e IS NOT NULL THEN e.reviewer_id ELSE reviewer_id END AS reviewer_id",
        "reviewed_at": "coalesce(e.created_at, reviewed_at) AS reviewed_at",
    }
    state = fields.join(last, [K, "field_key"], "left").selectExpr(*[swap.get(c, c) for c in fields.columns])
    audit = good.join(known, [K, "field_key"]).selectExpr(
        "event_id", K, "'field' AS target_type", "field_key AS target_id", "'modify' AS action", "old_value", "new_value",
        "comment", "reviewer_id", "created_at",
    )
    bare = requests.filter(
        "coalesce(size(corrections), 0) <= 0 AND (action IN ('approved', 'reviewed') OR comment <> '')"
    ).selectExpr(
        "event_id", K, "'contract' AS target_type", f"CAST({K} AS STRING) AS target_id", "action",
        "CAST(NULL AS STRING) AS old_value", "CAST(NULL AS STRING) AS new_value", "comment", "reviewer_id", "created_at",
    )
    return state, audit.unionByName(bare), refused


def approve_contracts(contracts: DataFrame, fields: DataFrame, approvals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Approved contracts, and their fields where only ``pending`` ones become approved."""
    ids = approvals.select(K).distinct().selectExpr(K, "true AS __ok")
    pending = "CASE WHEN __ok AND review_status = 'pending' THEN 'approved' ELSE review_status END AS review_status"
    swap = {"review_status": pending}
    out = fields.join(ids, K, "left").selectExpr(*[swap.get(c, c) for c in fields.columns])
    return _set_status(contracts, approvals, "approved"), out


def reject_contracts(contracts: DataFrame, rejections: DataFrame) -> DataFrame:
    return _set_status(contracts, rejections, "rejected")


def _set_status(contracts: DataFrame, chosen: DataFrame, status: str) -> DataFrame:
    ids = chosen.select(K).distinct().selectExpr(K, "true AS __ok")
    swap = {"status": f"CASE WHEN __ok THEN '{status}' ELSE status END AS status"}
    return contracts.join(ids, K, "left").selectExpr(*[swap.get(c, c) for c in contracts.columns])


def contract_audit(decisions: DataFrame, action: str) -> DataFrame:
    """One audit row per approval or rejection."""
    return decisions.selectExpr(
        "event_id", K, "'contract' AS target_type", f"CAST({K} AS STRING) AS target_id", f"'{action}' AS action",
        "reviewer_id", "created_at",
    )


def review_history(
    records: DataFrame, contract_id, target_type: str | None = None, page: int = 1, page_size: int = 50
) -> DataFrame:
    """One page of a contract's audit trail, newest first, with the total count."""
    if page < 1 or not 1 <= page_size <= 200:
        raise ValueError("page must be >= 1 and page_size within 1..200")
    rows = records.filter(F.col(K) == F.lit(contract_id))
    if target_type:
        rows = rows.filter(F.col("target_type") == target_type)
    total = rows.agg(F.expr("count(*) AS total")).scalar()
    shown = rows.orderBy(F.desc("created_at"), F.desc("event_id")).offset((page - 1) * page_size).limit(page_size)
    return shown.withColumn("total", total)


def review_queue(fields: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Fields of low confidence to look at first; a missing confidence is 0."""
    label = review_label("review_status")
    return fields.selectExpr("*", "coalesce(confidence, 0D) AS score", f"{label} AS review_label").filter(
        f"score < {threshold}"
    ).orderBy("score", K, "field_key")
