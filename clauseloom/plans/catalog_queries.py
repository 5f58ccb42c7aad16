"""Registered catalogue queries, each next to its reference SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from clauseloom.functions.boxes import rescale_box
from clauseloom.operators import catalog as Q
from clauseloom.operators import feed, grams, pages
from clauseloom.operators import rules as V
from clauseloom.plans import adapters as A
from clauseloom.plans.clause_queries import BLOCKS
from clauseloom.plans.rule_queries import ALL_FINDINGS, feed_sql
from clauseloom.schemas import DEFINITIONS, seed_patches
from clauseloom.streaming import jobs

NOW = "2000-06-15 00:00:00"


def latest_files(spark, sf_dir):
    return Q.latest_files(A.files(spark, sf_dir))


def contract_list(spark, sf_dir):
    return Q.list_contracts(A.contracts(spark, sf_dir), A.files(spark, sf_dir), status="reviewing", page=3, page_size=20)


def contract_detail(spark, sf_dir):
    fields = A.fields(spark, sf_dir).select("contract_id", "field_key", "value")
    found = V.validate(A.fields(spark, sf_dir), A.contracts(spark, sf_dir), rules=V.BUILTIN).select(
        "contract_id", "rule_order", "item_order", "field_key", "message"
    )
    detail = Q.contract_detail(A.contracts(spark, sf_dir), A.files(spark, sf_dir), fields, found)
    return detail.selectExpr(
        "contract_id", "status", "array_join(transform(files, f -> f.file_name), '|') AS files",
        "array_join(transform(fields, f -> concat(f.field_key, '=', coalesce(f.value, '~'))), '|') AS fields",
        "array_join(transform(violations, v -> v.message), '|') AS violations",
    )


def field_list(spark, sf_dir):
    return Q.list_fields(A.fields(spark, sf_dir), 5).select("contract_id", "field_key", "value")


def _stored_definitions(spark, sf_dir):
    """A definition table kept by users: parts as custom fields plus some edited defaults."""
    custom = A.table(spark, sf_dir, "part").selectExpr(
        "concat('custom-', p_partkey) AS field_key", "p_name AS field_name", "p_type AS description",
        "'string' AS value_type", "p_partkey % 7 = 0 AS required", "CAST(p_partkey + 100 AS INT) AS sort_order",
        "p_partkey % 5 <> 0 AS is_active", "CASE WHEN p_partkey % 3 = 0 THEN 'lease' END AS contract_type",
    )
    edited = A.definitions(spark, extra=False).filter("sort_order <= 20").selectExpr(
        "field_key", "concat(field_name, '*') AS field_name", "description", "'number' AS value_type", "sort_order % 4 = 0 AS required",
        "sort_order + 50 AS sort_order", "sort_order % 2 = 0 AS is_active",
        "CASE WHEN sort_order % 3 = 0 THEN 'sale' END AS contract_type",
    )
    return custom.unionByName(edited)


def _seeds(spark):
    return spark.createDataFrame(seed_patches(), DEFINITIONS)


def active_definitions(spark, sf_dir):
    return Q.active_definitions(_stored_definitions(spark, sf_dir)).select("field_key", "sort_order")


def seed_sync(spark, sf_dir):
    return Q.sync_definitions(_stored_definitions(spark, sf_dir), _seeds(spark))


def seed_reset(spark, sf_dir):
    return Q.reset_definitions(_stored_definitions(spark, sf_dir), _seeds(spark))


def add_definitions(spark, sf_dir):
    new = A.table(spark, sf_dir, "supplier").selectExpr(
        "concat('custom-', s_suppkey * 50) AS field_key", "s_name AS field_name", "'' AS description", "'string' AS value_type",
        "false AS required", "CAST(s_suppkey AS INT) AS sort_order", "true AS is_active", "CAST(NULL AS STRING) AS contract_type",
    )
    taken, refused = Q.add_definitions(_stored_definitions(spark, sf_dir), new)
    return taken.select("field_key", "field_name").withColumn("outcome", F.lit("kept")).unionByName(
        refused.select("field_key", "field_name").withColumn("outcome", F.lit("refused"))
    )


def update_definitions(spark, sf_dir):
    patches = A.table(spark, sf_dir, "part").filter("p_partkey % 2 = 0").selectExpr(
        "concat('custom-', p_partkey) AS field_key", "p_brand AS field_name", "CAST(NULL AS STRING) AS description",
        "CASE WHEN p_partkey % 4 = 0 THEN array('field_name') ELSE array('description') END AS set_cols",
    )
    return Q.update_definitions(_stored_definitions(spark, sf_dir), patches).select("field_key", "field_name", "description")


def deactivate_definitions(spark, sf_dir):
    keys = A.table(spark, sf_dir, "part").filter("p_size > 25").selectExpr("concat('custom-', p_partkey) AS field_key")
    return Q.deactivate_definitions(_stored_definitions(spark, sf_dir), keys).select("field_key", "is_active")


def search_definitions(spark, sf_dir):
    hits = Q.search_definitions(_stored_definitions(spark, sf_dir), "  ECONOMY ", page=2, page_size=15)
    return hits.select("field_key", "sort_order", "total", "required_total")


def add_from_library(spark, sf_dir):
    library = _stored_definitions(spark, sf_dir)
    chosen = library.filter("sort_order % 10 = 0")
    selected = library.filter("sort_order % 4 = 0")
    return Q.add_from_library(chosen, library, selected).select("field_key", "sort_order")


def align_results(spark, sf_dir):
    keys = A.definitions(spark, extra=False).filter("required OR sort_order >= 20")
    wanted = A.contracts(spark, sf_dir).selectExpr(
        "contract_id", "explode(array('party-a-name', 'party-b-name', 'payment-method', 'sign-date', 'effective-date', 'end-date')) AS field_key"
    )
    requested = wanted.join(keys.select("field_key", "field_name", "sort_order"), "field_key")
    fields = A.stored_fields(spark, sf_dir).selectExpr("*", "pos AS page_no")
    return Q.align_results(requested, fields).select(
        "contract_id", "sort_order", "field_key", "field_name", "value", "confidence", "page_no", "status", "review_status"
    )


def result_counts(spark, sf_dir):
    return Q.result_counts(A.fields(spark, sf_dir))


def result_report(spark, sf_dir):
    return Q.result_report(A.fields(spark, sf_dir), A.contracts(spark, sf_dir))


def tasks_of(spark, sf_dir):
    return Q.tasks_of(A.tasks(spark, sf_dir), 5).select("id", "contract_id", "status", "created_at")


def batch_outcomes(spark, sf_dir):
    return Q.batch_outcomes(A.batches(spark, sf_dir)).select("contract_id", "batch_id", "ocr_status", "extraction_status", "label")


def batch_summary(spark, sf_dir):
    return Q.batch_summary(A.batches(spark, sf_dir))


def expired_tasks(spark, sf_dir):
    return Q.expired_tasks(A.tasks(spark, sf_dir), NOW)


def due_tasks(spark, sf_dir):
    return Q.due_tasks(A.tasks(spark, sf_dir), NOW, 25).select("id", "priority", "queued_at")


def task_state(spark, sf_dir):
    return Q.fold_task_events(A.task_events(spark, sf_dir))


def ready_contracts(spark, sf_dir):
    docs = A.table(spark, sf_dir, "documents").selectExpr(
        "doc_id * 2 AS contract_id", "CASE WHEN doc_id % 3 <> 0 THEN TIMESTAMP_NTZ '2024-01-01 00:00:00' END AS ocr_completed_at"
    )
    return Q.ready_for_extraction(docs, A.blocks(spark, sf_dir)).select("contract_id")


def rescaled_boxes(spark, sf_dir):
    box = rescale_box("bbox", "600", "CASE WHEN contract_id % 6 = 0 THEN 0 ELSE 1200 END")
    return A.blocks(spark, sf_dir).filter("bbox IS NOT NULL").selectExpr(
        "contract_id", "page_no", "sort_order", f"{box} AS r"
    ).selectExpr("contract_id", "page_no", "sort_order", "r.left AS x", "r.top AS y", "r.width AS w", "r.height AS h")


def record_statuses(spark, sf_dir):
    from clauseloom.functions.labels import record_status

    return A.contracts(spark, sf_dir).groupBy("status").agg(F.expr("count(*) AS n")).selectExpr(
        "status", f"{record_status('status')} AS record_status", "n"
    )


def contract_page(spark, sf_dir):
    """A deep page of the contract list, read from the run it lies in."""
    rows = A.contracts(spark, sf_dir).filter("status = 'reviewing'")
    index = pages.paged(rows, [F.desc("created_at"), F.asc("contract_id")], jobs.work_folder(spark, "pages"), run=500)
    return index.page(31, 20)


def audit_page_indexed(spark, sf_dir):
    """The same for the audit trail of all contracts, newest first."""
    rows = A.reviews(spark, sf_dir).select("event_id", "contract_id", "field_key", "action", "reviewer_id", "created_at")
    index = pages.paged(rows, [F.desc("created_at"), F.desc("event_id")], jobs.work_folder(spark, "audit-pages"), run=1000)
    return index.page(17, 50)


def search_grams(spark, sf_dir):
    lists = grams.gram_lists(_stored_definitions(spark, sf_dir), jobs.work_folder(spark, "grams"))
    return lists.search("  ECONOMY ", page=2, page_size=15).select("field_key", "sort_order", "total", "required_total")


def search_grams_short(spark, sf_dir):
    """A query of two letters."""
    lists = grams.gram_lists(_stored_definitions(spark, sf_dir), jobs.work_folder(spark, "grams"))
    return lists.search("Ri", page=1, page_size=50).select("field_key", "sort_order", "total", "required_total")


def feed_definition_updates(spark, sf_dir):
    """What a partial update of the definitions changes."""
    old = _stored_definitions(spark, sf_dir).select("field_key", "field_name", "description")
    return feed.changes(old, update_definitions(spark, sf_dir), ["field_key"])


def feed_seed_sync(spark, sf_dir):
    """What a seed synchronisation changes."""
    old = _stored_definitions(spark, sf_dir)
    return feed.changes(old, seed_sync(spark, sf_dir), ["field_key"]).select("op", *old.columns)


QUERIES = {
    "latest_files": latest_files, "contract_list": contract_list, "contract_detail": contract_detail, "field_list": field_list,
    "active_definitions": active_definitions, "seed_sync": seed_sync, "seed_reset": seed_reset, "add_definitions": add_definitions,
    "update_definitions": update_definitions, "deactivate_definitions": deactivate_definitions,
    "search_definitions": search_definitions, "add_from_library": add_from_library, "align_results": align_results,
    "result_counts": result_counts, "result_report": result_report, "tasks_of": tasks_of, "batch_outcomes": batch_outcomes,
    "batch_summary": batch_summary, "expired_tasks": expired_tasks, "due_tasks": due_tasks, "task_state": task_state,
    "ready_contracts": ready_contracts, "rescaled_boxes": rescaled_boxes, "record_statuses": record_statuses,
    "contract_page": contract_page, "audit_page_indexed": audit_page_indexed, "search_grams": search_grams,
    "search_grams_short": search_grams_short, "feed_definition_updates": feed_definition_updates, "feed_seed_sync": feed_seed_sync,
}

# --- reference SQL -----------------------------------------------------------

_C = f"WITH contracts AS ({A.CONTRACTS_SQL}), files AS ({A.FILES_SQL})"
_LATEST = "latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY contract_id ORDER BY version DESC) AS rn FROM files) WHERE rn = 1)"
_RECORD = "CASE status WHEN 'processing' THEN 'PROCESSING' WHEN 'uploaded' THEN 'PROCESSING' WHEN 'reviewing' THEN 'COMPLETED' WHEN 'approved' THEN 'COMPLETED' WHEN 'failed' THEN 'FAILED' ELSE 'PROCESSING' END"
_STORED = f"""WITH seeds AS (SELECT * FROM {A.definitions_sql(extra=False)}), defs AS (
  SELECT concat('custom-', CAST(p_partkey AS VARCHAR)) AS field_key, p_name AS field_name, p_type AS description, 'string' AS value_type,
    p_partkey % 7 = 0 AS required, CAST(p_partkey + 100 AS INT) AS sort_order, p_partkey % 5 <> 0 AS is_active,
    CASE WHEN p_partkey % 3 = 0 THEN 'lease' END AS contract_type FROM part
  UNION ALL SELECT field_key, concat(field_name, '*'), description, 'number', sort_order % 4 = 0, CAST(sort_order + 50 AS INT), sort_order % 2 = 0,
    CASE WHEN sort_order % 3 = 0 THEN 'sale' END FROM seeds WHERE sort_order <= 20)"""
# A default leaves alone the required flag (other than of the names) and the value type of party fields.
_S_REQ = "CASE WHEN s.required THEN true ELSE coalesce(d.required, false) END"
_S_TYPE = "CASE WHEN s.sort_order > 16 THEN 'string' ELSE coalesce(d.value_type, 'string') END"
_TASKS = f"WITH tasks AS ({A.TASKS_SQL})"
_BATCH = f"""WITH items AS ({A.BATCH_SQL}), outcomes AS (SELECT contract_id, batch_id, ocr_status,
   CASE WHEN ocr_status = 'failed' THEN 'skipped' ELSE extraction_status END AS extraction_status FROM items)"""
_DONE = "('completed', 'failed', 'cancelled', 'timed_out')"

ORACLES = {
    "latest_files": f"{_C}, {_LATEST} SELECT contract_id, version, file_name, file_type FROM latest",
    "contract_list": f"""{_C}, {_LATEST}, page AS (SELECT * FROM contracts WHERE status = 'reviewing' ORDER BY created_at DESC, contract_id LIMIT 20 OFFSET 40)
        SELECT p.*, coalesce(file_name, '') AS file_name, coalesce(file_type, '') AS file_type, {_RECORD} AS record_status,
          (SELECT count(*) FROM contracts WHERE status = 'reviewing') AS total
        FROM page p LEFT JOIN latest l ON l.contract_id = p.contract_id""",
    "contract_detail": f"""{ALL_FINDINGS}, contracts AS ({A.CONTRACTS_SQL}), files AS ({A.FILES_SQL}),
        fl AS (SELECT contract_id, string_agg(file_name, '|' ORDER BY version) AS t FROM files GROUP BY contract_id),
        fd AS (SELECT contract_id, string_agg(concat(field_key, '=', coalesce(value, '~')), '|' ORDER BY field_key) AS t FROM fields GROUP BY contract_id),
        vi AS (SELECT contract_id, string_agg(message, '|' ORDER BY rule_order, item_order) AS t FROM found GROUP BY contract_id)
        SELECT c.contract_id, c.status, coalesce(fl.t, '') AS files, coalesce(fd.t, '') AS fields, coalesce(vi.t, '') AS violations FROM contracts c
        LEFT JOIN fl ON fl.contract_id = c.contract_id LEFT JOIN fd ON fd.contract_id = c.contract_id LEFT JOIN vi ON vi.contract_id = c.contract_id""",
    "field_list": f"WITH fields AS ({A.FIELDS_SQL}) SELECT contract_id, field_key, value FROM fields WHERE contract_id = 5",
    "active_definitions": f"{_STORED} SELECT field_key, sort_order FROM defs WHERE is_active",
    "seed_sync": f"""{_STORED} SELECT coalesce(d.field_key, s.field_key) AS field_key,
        CASE WHEN t THEN s.field_name ELSE d.field_name END AS field_name, CASE WHEN t THEN s.description ELSE d.description END AS description,
        CASE WHEN t THEN {_S_TYPE} ELSE d.value_type END AS value_type, CASE WHEN t THEN {_S_REQ} ELSE d.required END AS required,
        CASE WHEN t THEN s.sort_order ELSE d.sort_order END AS sort_order, t OR d.is_active AS is_active, d.contract_type
        FROM (SELECT *, true AS has_s FROM seeds) s FULL OUTER JOIN defs d ON d.field_key = s.field_key,
        LATERAL (SELECT coalesce(has_s, false) AND (d.field_key IS NULL OR NOT d.is_active) AS t) x""",
    "seed_reset": f"""{_STORED} SELECT coalesce(d.field_key, s.field_key) AS field_key,
        coalesce(s.field_name, d.field_name) AS field_name, coalesce(s.description, d.description) AS description,
        CASE WHEN s.field_key IS NULL THEN d.value_type ELSE {_S_TYPE} END AS value_type,
        CASE WHEN s.field_key IS NULL THEN d.required ELSE {_S_REQ} END AS required,
        coalesce(s.sort_order, d.sort_order) AS sort_order, s.field_key IS NOT NULL AS is_active, d.contract_type
        FROM seeds s FULL OUTER JOIN defs d ON d.field_key = s.field_key""",
    "add_definitions": f"""{_STORED}, new AS (SELECT concat('custom-', CAST(s_suppkey * 50 AS VARCHAR)) AS field_key, s_name AS field_name FROM supplier)
        SELECT field_key, field_name, 'kept' AS outcome FROM defs
        UNION ALL SELECT field_key, field_name, CASE WHEN field_key IN (SELECT field_key FROM defs) THEN 'refused' ELSE 'kept' END FROM new""",
    "update_definitions": f"""{_STORED} SELECT d.field_key, CASE WHEN p_partkey % 4 = 0 THEN p_brand ELSE d.field_name END AS field_name,
        CASE WHEN p_partkey % 4 <> 0 THEN NULL ELSE d.description END AS description
        FROM defs d LEFT JOIN part ON p_partkey % 2 = 0 AND d.field_key = concat('custom-', CAST(p_partkey AS VARCHAR))
        WHERE p_partkey IS NOT NULL UNION ALL SELECT field_key, field_name, description FROM defs
        WHERE field_key NOT IN (SELECT concat('custom-', CAST(p_partkey AS VARCHAR)) FROM part WHERE p_partkey % 2 = 0)""",
    "deactivate_definitions": f"""{_STORED} SELECT field_key, is_active AND field_key NOT IN
        (SELECT concat('custom-', CAST(p_partkey AS VARCHAR)) FROM part WHERE p_size > 25) AS is_active FROM defs""",
    "search_definitions": f"""{_STORED}, hits AS (SELECT * FROM defs WHERE is_active AND
          (contains(lower(field_name), 'economy') OR contains(lower(coalesce(description, '')), 'economy')))
        SELECT field_key, sort_order, (SELECT count(*) FROM hits) AS total, (SELECT count(*) FROM hits WHERE required) AS required_total
        FROM hits ORDER BY sort_order, field_key LIMIT 15 OFFSET 15""",
    "add_from_library": f"{_STORED} SELECT field_key, sort_order FROM defs WHERE sort_order % 10 = 0 OR sort_order % 4 = 0",
    "align_results": f"""WITH fields AS ({A.FIELDS_SQL}), seeds AS (SELECT * FROM {A.definitions_sql(extra=False)})
        SELECT o_orderkey AS contract_id, s.sort_order, s.field_key, s.field_name, coalesce(value, '') AS value, coalesce(confidence, 0.0) AS confidence,
          pos AS page_no, CASE WHEN coalesce(value, '') <> '' THEN 'found' ELSE 'not_found' END AS status, 'extracted' AS review_status
        FROM orders JOIN seeds s ON s.required OR s.sort_order >= 20 LEFT JOIN fields f ON f.contract_id = o_orderkey AND f.field_key = s.field_key""",
    "result_counts": f"""WITH fields AS ({A.FIELDS_SQL}) SELECT contract_id, count(*) AS field_count,
        count(*) FILTER (WHERE coalesce(value, '') <> '') AS found_count, count(*) FILTER (WHERE coalesce(value, '') = '') AS not_found_count
        FROM fields GROUP BY contract_id""",
    "result_report": f"""WITH fields AS ({A.FIELDS_SQL}), contracts AS ({A.CONTRACTS_SQL}),
        n AS (SELECT contract_id, count(*) AS a, count(*) FILTER (WHERE coalesce(value, '') <> '') AS b FROM fields GROUP BY contract_id),
        t AS (SELECT coalesce(contract_type, 'unknown') AS contract_type, a, b FROM n JOIN contracts USING (contract_id))
        SELECT coalesce(contract_type, '(all)') AS contract_type, count(*) AS contracts, CAST(sum(a) AS BIGINT) AS fields, CAST(sum(b) AS BIGINT) AS found
        FROM t GROUP BY ROLLUP (contract_type)""",
    "tasks_of": f"{_TASKS} SELECT id, contract_id, status, created_at FROM tasks WHERE contract_id = 5",
    "batch_outcomes": f"""{_BATCH} SELECT *, CASE extraction_status WHEN 'completed' THEN '已提取' WHEN 'failed' THEN '提取失败' WHEN 'skipped' THEN 'OCR失败'
        WHEN 'processing' THEN '提取中' ELSE CASE ocr_status WHEN 'completed' THEN 'OCR完成' WHEN 'failed' THEN 'OCR失败' WHEN 'processing' THEN 'OCR中'
        ELSE '等待OCR' END END AS label FROM outcomes""",
    "batch_summary": f"""{_BATCH} SELECT batch_id, count(*) FILTER (WHERE ocr_status IN ('processing', 'pending')) AS preparing,
        count(*) FILTER (WHERE ocr_status = 'completed') AS ocr_completed, count(*) FILTER (WHERE ocr_status = 'failed') AS ocr_failed,
        count(*) FILTER (WHERE extraction_status = 'completed') AS extraction_completed,
        count(*) FILTER (WHERE extraction_status = 'failed') AS extraction_failed,
        count(*) FILTER (WHERE extraction_status = 'skipped') AS extraction_skipped FROM outcomes GROUP BY batch_id""",
    "expired_tasks": f"""{_TASKS} SELECT id, contract_id, attempts, max_attempts, CASE WHEN attempts >= max_attempts THEN 'timed_out' ELSE 'retrying' END AS new_status,
        CASE WHEN attempts >= max_attempts THEN 'timed_out' ELSE 'queued' END AS new_stage,
        CASE WHEN attempts < max_attempts THEN TIMESTAMP '{NOW}' + to_seconds(least(60, pow(2, attempts))) END AS next_run_at
        FROM tasks WHERE status = 'running' AND lease_expires_at < TIMESTAMP '{NOW}'""",
    "due_tasks": f"""{_TASKS} SELECT id, priority, queued_at FROM tasks WHERE status IN ('pending', 'retrying') AND
        (next_run_at IS NULL OR next_run_at <= TIMESTAMP '{NOW}') ORDER BY priority DESC, queued_at, created_at, id LIMIT 25""",
    "task_state": f"""WITH ev AS ({A.TASK_EVENTS_SQL}), st AS (SELECT *, CASE WHEN event IN {_DONE} THEN event WHEN event LIKE '%\\_failed' ESCAPE '\\' THEN 'failed'
          ELSE 'running' END AS status, CASE WHEN event IN {_DONE} THEN event ELSE regexp_replace(event, '_failed$', '') END AS stage FROM ev)
        SELECT task_id, arg_max(status, (created_at, event_id)) AS status, arg_max(stage, (created_at, event_id)) AS stage,
          min(created_at) AS started_at, max(created_at) FILTER (WHERE status IN {_DONE}) AS completed_at FROM st GROUP BY task_id""",
    "ready_contracts": f"""{BLOCKS} SELECT doc_id * 2 AS contract_id FROM documents WHERE doc_id % 3 <> 0 AND doc_id * 2 IN (SELECT contract_id FROM blocks)""",
    "rescaled_boxes": f"""{BLOCKS} SELECT contract_id, page_no, sort_order, CASE WHEN contract_id % 6 = 0 THEN 0 ELSE x1 * 0.5 END AS x,
        CASE WHEN contract_id % 6 = 0 THEN 0 ELSE y1 * 0.5 END AS y, CASE WHEN contract_id % 6 = 0 THEN 0 ELSE greatest(1, (x2 - x1) * 0.5) END AS w,
        CASE WHEN contract_id % 6 = 0 THEN 0 ELSE greatest(1, (y2 - y1) * 0.5) END AS h FROM blocks WHERE x1 IS NOT NULL""",
    "record_statuses": f"WITH contracts AS ({A.CONTRACTS_SQL}) SELECT status, {_RECORD} AS record_status, count(*) AS n FROM contracts GROUP BY status",
}


_DEF = ["field_name", "description", "value_type", "required", "sort_order", "is_active", "contract_type"]
ORACLES |= {
    "contract_page": f"""{_C} SELECT *, (SELECT count(*) FROM contracts WHERE status = 'reviewing') AS total FROM contracts
        WHERE status = 'reviewing' ORDER BY created_at DESC, contract_id LIMIT 20 OFFSET 600""",
    "audit_page_indexed": f"""WITH reviews AS ({A.REVIEWS_SQL}) SELECT event_id, contract_id, field_key, action, reviewer_id, created_at,
        (SELECT count(*) FROM reviews) AS total FROM reviews ORDER BY created_at DESC, event_id DESC LIMIT 50 OFFSET 800""",
    "search_grams": ORACLES["search_definitions"],
    "search_grams_short": ORACLES["search_definitions"].replace("'economy'", "'ri'").replace("LIMIT 15 OFFSET 15", "LIMIT 50"),
    "feed_definition_updates": feed_sql(
        f"{_STORED} SELECT field_key, field_name, description FROM defs", ORACLES["update_definitions"], ["field_key"], ["field_name", "description"]
    ),
    "feed_seed_sync": feed_sql(f"{_STORED} SELECT * FROM defs", ORACLES["seed_sync"], ["field_key"], _DEF),
}
