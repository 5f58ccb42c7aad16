"""Registered queries of the extraction and tracing steps, each next to its reference SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from clauseloom.operators import evaluation as M
from clauseloom.operators import extraction as E
from clauseloom.operators import feed
from clauseloom.operators import trace as T
from clauseloom.plans import adapters as A
from clauseloom.plans import batch
from clauseloom.plans.clause_queries import BLOCKS
from clauseloom.plans.rule_queries import feed_sql

REQUESTED = ["party-a-name", "party-b-name", "contract-amount", "sign-date", "effective-date", "end-date", "payment-method"]


def recover_json(spark, sf_dir):
    out = E.recover_json(A.model_responses(spark, sf_dir))
    return out.selectExpr(
        "contract_id", "chunk_no", "json IS NOT NULL AS found", "coalesce(left(json, 1), '') AS opens",
        "coalesce(right(json, 1), '') AS closes", "coalesce(length(json) - length(replace(json, 'field_key', '')), 0) DIV 9 AS fields",
    )


def explode_fields(spark, sf_dir):
    return E.explode_fields(A.model_responses(spark, sf_dir)).select(
        "contract_id", "chunk_no", "pos", "field_key", "value", "source_text", "source_page", "confidence",
        F.expr("source_bbox[1] AS y1"), F.expr("source_bbox[2] AS x2"),
    )


def _typed(spark, sf_dir):
    return E.type_fields(E.explode_fields(A.model_responses(spark, sf_dir)), A.definitions(spark))


def type_fields(spark, sf_dir):
    return _typed(spark, sf_dir).select(
        "contract_id", "chunk_no", "field_key", "field_name", "value", "value_type", "page_no", "confidence"
    )


def unrequested_fields(spark, sf_dir):
    raw = E.explode_fields(A.model_responses(spark, sf_dir))
    return E.unrequested(raw, A.definitions(spark)).groupBy("field_key").agg(F.expr("count(*) AS n"))


def merge_chunks(spark, sf_dir):
    chunks = A.answered(spark, sf_dir).withColumnRenamed("source_page", "page_no")
    return E.merge_fields(chunks).select("contract_id", "field_key", "value", "confidence", "page_no", "chunk_no")


def merge_types(spark, sf_dir):
    return E.merge_contract_type(E.response_types(A.model_responses(spark, sf_dir)))


def _requested(spark, sf_dir):
    """Seven requested keys per contract with their definitions."""
    wanted = ", ".join(f"'{k}'" for k in REQUESTED)
    keys = A.contracts(spark, sf_dir).selectExpr("contract_id", f"explode(array({wanted})) AS field_key")
    defs = A.definitions(spark).select("field_key", "field_name", "value_type", "sort_order")
    return keys.join(defs, "field_key")


def _merged(spark, sf_dir):
    chunks = A.answered(spark, sf_dir).filter("contract_id % 5 <> 4").selectExpr(
        "contract_id", "field_key", "chunk_no", "pos", "CAST(NULL AS STRING) AS field_name", "value",
        "'string' AS value_type", "source_text", "source_page AS page_no",
        "CAST(NULL AS STRUCT<x1: DOUBLE, y1: DOUBLE, x2: DOUBLE, y2: DOUBLE>) AS bbox", "confidence",
    )
    return E.merge_fields(chunks)


def reconcile(spark, sf_dir):
    fields, _ = E.reconcile(_merged(spark, sf_dir), _requested(spark, sf_dir))
    return fields.select("contract_id", "field_key", "field_name", "value", "confidence", "missing")


def reconcile_failed(spark, sf_dir):
    return E.reconcile(_merged(spark, sf_dir), _requested(spark, sf_dir))[1]


def extraction_diagnostics(spark, sf_dir):
    merged, requested = _merged(spark, sf_dir), _requested(spark, sf_dir)
    fields, _ = E.reconcile(merged, requested)
    return E.extraction_diagnostics(fields, merged, requested)


def _approved(spark, sf_dir):
    return A.fields(spark, sf_dir).selectExpr(
        "contract_id", "field_key", "value", "confidence", "'approved' AS review_status", "'r' AS reviewed_value"
    )


def feed_upsert(spark, sf_dir):
    """What an upsert of extracted fields changes."""
    return feed.changes(_approved(spark, sf_dir), upsert_fields(spark, sf_dir), ["contract_id", "field_key"])


def upsert_fields(spark, sf_dir):
    stored = _approved(spark, sf_dir)
    new = A.fields(spark, sf_dir).filter("contract_id % 2 = 0 AND pos <= 3").selectExpr(
        "contract_id", "field_key", "concat(value, '!') AS value", "confidence"
    )
    return E.upsert_fields(new, stored)


def field_sets(spark, sf_dir):
    sets = E.fields_for_type(A.contracts(spark, sf_dir), A.definitions(spark))
    keys = "array_join(transform(array_sort(collect_list(struct(sort_order, field_key))), x -> x.field_key), ',')"
    return sets.groupBy("contract_id").agg(F.expr("count(*) AS n_fields"), F.expr(f"{keys} AS keys"))


def field_set_overrides(spark, sf_dir):
    sets = E.fields_for_type(A.contracts(spark, sf_dir), A.definitions(spark))
    custom = A.contracts(spark, sf_dir).filter("contract_id % 7 = 0").selectExpr(
        "contract_id", "'custom-only' AS field_key", "'自定义' AS field_name", "'' AS description",
        "'string' AS value_type", "1 AS sort_order",
    )
    out = E.effective_field_set(sets, custom)
    return out.groupBy("contract_id").agg(F.expr("count(*) AS n_fields"), F.expr("min(field_key) AS first_key"))


def resolve_type(spark, sf_dir):
    classified = A.contracts(spark, sf_dir).selectExpr("contract_id", "contract_type", "0.8D AS confidence")
    inline = E.merge_contract_type(E.response_types(A.model_responses(spark, sf_dir)))
    return E.resolve_type(classified, inline)


def trace_sources(spark, sf_dir):
    found = T.locate_sources(A.traces(spark, sf_dir), A.blocks(spark, sf_dir))
    return found.selectExpr(
        "contract_id", "field_key", "page_no", "bbox.x1", "bbox.y1", "bbox.x2", "bbox.y2",
        "round(score, 6) AS score", "span",
    )


def trace_scores(spark, sf_dir):
    """The counts a score is made of, which are whole numbers, and its rank."""
    scores = T.block_scores(A.traces(spark, sf_dir), A.blocks(spark, sf_dir))
    return scores.select("contract_id", "field_key", "page_no", "sort_order", "n", "ns", "nb", "rank")


def trace_attach(spark, sf_dir):
    out = T.attach_boxes(A.traces(spark, sf_dir), A.blocks(spark, sf_dir))
    return out.selectExpr("contract_id", "field_key", "page_no", "bbox.x1", "bbox.y1", "bbox.x2", "bbox.y2")


def line_answers(spark, sf_dir):
    """One model answer a document with all of its lines as fields; the documents' own field sets."""
    lines = A.traces(spark, sf_dir)
    field = "struct(field_key, concat('V', field_key) AS field_value, source_text, page_no AS source_page, 0.9D AS confidence)"
    responses = lines.groupBy("contract_id").agg(F.expr(f"to_json(struct(collect_list({field}) AS fields)) AS raw")).selectExpr(
        "contract_id", "0 AS chunk_no", "raw", "CAST(NULL AS STRING) AS error"
    )
    sets = lines.selectExpr(
        "contract_id", "field_key", "concat('Line ', field_key) AS field_name", "'' AS description", "'string' AS value_type", "1 AS sort_order"
    )
    contracts = A.table(spark, sf_dir, "documents").selectExpr("doc_id AS contract_id", "'done' AS ocr_completed_at").distinct()
    return contracts, responses, sets


def extracted_rows(fields):
    return fields.selectExpr(
        "contract_id", "field_key", "field_name", "value", "page_no", "bbox.x1", "bbox.y1", "bbox.x2", "bbox.y2", "confidence", "review_status"
    )


def extract_contracts(spark, sf_dir):
    """The whole batch plan: every line of every document answered, matched to the field set, traced and stored."""
    contracts, responses, sets = line_answers(spark, sf_dir)
    out = batch.extract(contracts, A.blocks(spark, sf_dir), responses, A.definitions(spark), overrides=sets)
    return extracted_rows(out.fields)


def extract_findings(spark, sf_dir):
    """The findings of the same plan."""
    contracts, responses, sets = line_answers(spark, sf_dir)
    out = batch.extract(contracts, A.blocks(spark, sf_dir), responses, A.definitions(spark), overrides=sets)
    return out.violations.select("contract_id", "rule_key", "field_key")


def quality_by_place(spark, sf_dir):
    """Null rate and hits of every line's field by where it was traced to; every fifth block is a table."""
    traces = A.traces(spark, sf_dir)
    blocks = A.blocks(spark, sf_dir).withColumn("block_type", F.expr("CASE WHEN sort_order % 5 = 0 THEN 'table' ELSE block_type END"))
    fields = traces.selectExpr("contract_id", "field_key", "CASE WHEN length(source_text) % 7 <> 0 THEN 'v' END AS value", "CAST(NULL AS STRING) AS reviewed_value")
    golden = traces.selectExpr("contract_id", "field_key", "CASE length(source_text) % 3 WHEN 0 THEN 'v' WHEN 1 THEN 'w' ELSE '' END AS expected")
    return M.quality_by_place(fields, golden, T.locate_sources(traces, blocks), blocks)


QUERIES = {
    "extract_contracts": extract_contracts, "extract_findings": extract_findings, "recover_json": recover_json, "explode_fields": explode_fields, "type_fields": type_fields,
    "unrequested_fields": unrequested_fields, "merge_chunks": merge_chunks, "merge_types": merge_types,
    "reconcile": reconcile, "reconcile_failed": reconcile_failed, "extraction_diagnostics": extraction_diagnostics,
    "upsert_fields": upsert_fields, "feed_upsert": feed_upsert, "field_sets": field_sets, "field_set_overrides": field_set_overrides,
    "resolve_type": resolve_type, "trace_scores": trace_scores, "trace_sources": trace_sources, "trace_attach": trace_attach,
    "quality_by_place": quality_by_place,
}


# --- reference SQL -----------------------------------------------------------

_ANSWERED = f"WITH answered AS ({A.ANSWERED_SQL}), readable AS (SELECT * FROM answered WHERE contract_id % 5 <> 4)"
_DEFS = f"defs AS (SELECT * FROM {A.definitions_sql()})"
_RANK = """ORDER BY CASE WHEN trim(coalesce(value, '')) = '' THEN 1 ELSE 0 END,
  CASE WHEN trim(coalesce(value, '')) <> '' THEN -confidence END, CASE WHEN trim(coalesce(value, '')) <> '' THEN source_page END, chunk_no, pos"""
_BEST = f"(SELECT *, row_number() OVER (PARTITION BY contract_id, field_key {_RANK}) AS rn FROM {{0}})"
_TYPES = """types AS (SELECT o_orderkey AS contract_id,
  CASE WHEN o_orderkey % 4 = 0 THEN 'lease' ELSE 'service' END AS contract_type,
  CASE WHEN o_orderkey % 5 = 3 THEN 0.0 ELSE 0.9 END::DOUBLE AS contract_type_confidence FROM orders WHERE o_orderkey % 5 <> 4)"""
_KEYS = "(VALUES " + ", ".join(f"('{k}')" for k in REQUESTED) + ") AS q(field_key)"
_RECONCILE = f"""{_ANSWERED}, {_DEFS}, best AS (SELECT * FROM {_BEST.format('readable')} WHERE rn = 1),
 requested AS (SELECT o_orderkey AS contract_id, q.field_key, d.field_name FROM orders, {_KEYS} JOIN defs d ON d.field_key = q.field_key),
 fields AS (SELECT r.contract_id, r.field_key, r.field_name, b.value, coalesce(b.confidence, 0.0) AS confidence, b.pos IS NULL AS missing
   FROM requested r LEFT JOIN best b ON b.contract_id = r.contract_id AND b.field_key = r.field_key),
 failed AS (SELECT contract_id FROM fields GROUP BY contract_id HAVING bool_and(missing)),
 kept AS (SELECT * FROM fields WHERE contract_id NOT IN (SELECT contract_id FROM failed))"""


def _keys(cond: str) -> str:
    return f"coalesce(string_agg(field_key, ',' ORDER BY field_key) FILTER (WHERE {cond}), '')"


_SETS = f"""WITH {_DEFS}, c AS ({A.CONTRACTS_SQL}),
 sets AS (SELECT c.contract_id, d.field_key, d.sort_order FROM c JOIN defs d ON d.is_active
   AND (coalesce(c.contract_type, 'unknown') = 'unknown' OR d.contract_type IS NULL OR d.contract_type = c.contract_type))"""

_NORM = r"regexp_replace({0}, '[\s\x{{0b}}\x{{1c}}-\x{{1f}}\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+', '', 'g')"


def _grams(text: str) -> str:
    return (
        f"CASE WHEN length({text}) < 2 THEN CASE WHEN {text} = '' THEN []::VARCHAR[] ELSE [{text}] END "
        f"ELSE list_distinct(list_transform(range(1, length({text})), lambda i: substring({text}, i, 2))) END"
    )


_TRACE = f"""{BLOCKS}, docs AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
 traces AS (SELECT doc_id AS contract_id, concat('f', CAST(pos AS VARCHAR)) AS field_key,
    CASE WHEN doc_id % 2 = 0 THEN ls[pos + 1] ELSE concat(ls[pos + 1], ' ', coalesce(ls[pos + 2], '')) END AS source_text,
    CASE WHEN doc_id % 3 <> 0 THEN CAST(floor(pos / 20) AS INT) + 1 END AS page_no
    FROM (SELECT *, unnest(range(0, len(ls))) AS pos FROM docs)),
 probes AS (SELECT contract_id, field_key, page_no, source, {_grams('source')} AS s FROM
    (SELECT *, {_NORM.format('source_text')} AS source FROM traces WHERE source_text <> '') WHERE length(source) >= 6),
 b AS (SELECT *, {_grams('norm')} AS g, row_number() OVER (PARTITION BY contract_id, page_no ORDER BY sort_order) AS idx
    FROM (SELECT *, {_NORM.format('text')} AS norm FROM blocks)),
 pairs AS (SELECT p.contract_id, p.field_key, p.page_no AS field_page, b.page_no, b.sort_order, b.idx, p.s, b.x1, b.y1, b.x2, b.y2,
    len(list_intersect(p.s, b.g)) AS n, len(p.s) AS ns, len(b.g) AS nb
    FROM probes p JOIN b ON b.contract_id = p.contract_id AND (p.page_no IS NULL OR p.page_no = b.page_no)),
 scored AS (SELECT *, n / ns * 0.7 + n / (ns + nb - n) * 0.3 AS score FROM pairs WHERE n > 0),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY contract_id, field_key ORDER BY score DESC, page_no, sort_order) AS rank FROM scored),
 top AS (SELECT *, bool_or(rank = 1 AND score >= 0.85 AND x1 IS NOT NULL) OVER (PARTITION BY contract_id, field_key) AS done
    FROM ranked WHERE rank <= 3),
 single AS (SELECT contract_id, field_key, page_no, sort_order, x1, y1, x2, y2, score, 1 AS span FROM top WHERE done AND rank = 1),
 wins AS (SELECT t.contract_id, t.field_key, t.page_no, t.sort_order, t.rank, sp.span, t.s,
    string_agg(w.norm, '' ORDER BY w.idx) AS text, min(w.x1) AS x1, min(w.y1) AS y1, max(w.x2) AS x2, max(w.y2) AS y2
    FROM top t, (VALUES (2), (3), (4)) AS sp(span) JOIN b w ON w.contract_id = t.contract_id AND w.page_no = t.page_no
      AND w.idx BETWEEN t.idx AND t.idx + sp.span - 1
    WHERE NOT t.done AND t.field_page IS NOT NULL GROUP BY ALL HAVING count(*) = sp.span),
 good AS (SELECT *, len(list_intersect(s, {_grams('text')})) / len(s) AS score FROM wins),
 merged AS (SELECT *, row_number() OVER (PARTITION BY contract_id, field_key ORDER BY rank, span) AS rn FROM good
    WHERE score >= 0.7 AND x1 IS NOT NULL),
 found AS (SELECT * FROM single UNION ALL
    SELECT contract_id, field_key, page_no, sort_order, x1, y1, x2, y2, score, span FROM merged WHERE rn = 1)"""

ORACLES = {
    "extract_contracts": f"""{_TRACE} SELECT t.contract_id, t.field_key, 'Line ' || t.field_key AS field_name, 'V' || t.field_key AS value,
        coalesce(t.page_no, f.page_no) AS page_no, f.x1, f.y1, f.x2, f.y2, 0.9::DOUBLE AS confidence, 'extracted' AS review_status
        FROM traces t LEFT JOIN found f ON f.contract_id = t.contract_id AND f.field_key = t.field_key""",
    "extract_findings": """SELECT DISTINCT doc_id AS contract_id, 'required_fields' AS rule_key, k AS field_key
        FROM documents, (VALUES ('party-a-name'), ('party-b-name')) q(k) WHERE text IS NOT NULL""",
    "recover_json": f"""{_ANSWERED}, n AS (SELECT contract_id, chunk_no, count(*) AS fields FROM readable GROUP BY ALL)
        SELECT o_orderkey AS contract_id, c.chunk_no, o_orderkey % 5 <> 4 AS found, CASE WHEN o_orderkey % 5 <> 4 THEN '{{' ELSE '' END AS opens,
          CASE WHEN o_orderkey % 5 <> 4 THEN '}}' ELSE '' END AS closes, coalesce(n.fields, 0) AS fields
        FROM orders CROSS JOIN (VALUES (0), (1)) AS c(chunk_no) LEFT JOIN n ON n.contract_id = o_orderkey AND n.chunk_no = c.chunk_no""",
    "explode_fields": f"""{_ANSWERED} SELECT contract_id, chunk_no, CAST(row_number() OVER (PARTITION BY contract_id, chunk_no
        ORDER BY pos) - 1 AS INT) AS pos, field_key, value, source_text, source_page, confidence,
        CAST(readable.pos + 1 AS DOUBLE) AS y1, readable.pos + CAST(0.5 AS DOUBLE) AS x2 FROM readable""",
    "type_fields": f"""{_ANSWERED}, {_DEFS} SELECT contract_id, chunk_no, r.field_key, d.field_name, value, d.value_type,
        source_page AS page_no, confidence FROM readable r JOIN defs d ON d.field_key = r.field_key""",
    "unrequested_fields": f"""{_ANSWERED}, {_DEFS} SELECT field_key, count(*) AS n FROM readable
        WHERE field_key NOT IN (SELECT field_key FROM defs) GROUP BY field_key""",
    "merge_chunks": f"""{_ANSWERED} SELECT contract_id, field_key, value, confidence, source_page AS page_no, chunk_no
        FROM {_BEST.format('answered')} WHERE rn = 1""",
    "merge_types": f"WITH {_TYPES} SELECT * FROM types",
    "reconcile": f"{_RECONCILE} SELECT * FROM kept",
    "reconcile_failed": f"{_RECONCILE} SELECT contract_id FROM failed",
    "extraction_diagnostics": f"""{_RECONCILE}, extra AS (SELECT contract_id, string_agg(DISTINCT field_key, ',' ORDER BY field_key) AS unknown_keys
          FROM best WHERE field_key NOT IN (SELECT field_key FROM {_KEYS}) GROUP BY contract_id)
        SELECT k.contract_id, {_keys('NOT missing')} AS returned_keys, {_keys("coalesce(value, '') <> ''")} AS non_null_keys,
          {_keys("coalesce(value, '') = ''")} AS null_keys, {_keys('missing')} AS missing_keys,
          max(trim(value)) FILTER (WHERE field_key = 'party-a-name') AS party_a,
          max(trim(value)) FILTER (WHERE field_key = 'party-b-name') AS party_b, coalesce(any_value(unknown_keys), '') AS unknown_keys
        FROM kept k LEFT JOIN extra e ON e.contract_id = k.contract_id GROUP BY k.contract_id""",
    "upsert_fields": f"""WITH fields AS ({A.FIELDS_SQL}
        ) SELECT contract_id, field_key, value, confidence, 'approved' AS review_status, 'r' AS reviewed_value FROM fields
          WHERE NOT (contract_id % 2 = 0 AND pos <= 3)
        UNION ALL SELECT contract_id, field_key, value || '!', confidence, 'extracted', NULL FROM fields WHERE contract_id % 2 = 0 AND pos <= 3""",
    "field_sets": f"""{_SETS} SELECT contract_id, count(*) AS n_fields, string_agg(field_key, ',' ORDER BY sort_order, field_key) AS keys
        FROM sets GROUP BY contract_id""",
    "field_set_overrides": f"""{_SETS}, final AS (SELECT contract_id, field_key FROM sets WHERE contract_id % 7 <> 0
          UNION ALL SELECT contract_id, 'custom-only' FROM c WHERE contract_id % 7 = 0)
        SELECT contract_id, count(*) AS n_fields, min(field_key) AS first_key FROM final GROUP BY contract_id""",
    "resolve_type": f"""WITH c AS ({A.CONTRACTS_SQL}), {_TYPES} SELECT c.contract_id,
        CASE WHEN coalesce(c.contract_type, 'unknown') <> 'unknown' THEN c.contract_type ELSE t.contract_type END AS contract_type,
        CASE WHEN coalesce(c.contract_type, 'unknown') <> 'unknown' THEN 0.8::DOUBLE ELSE t.contract_type_confidence END AS contract_type_confidence
        FROM c LEFT JOIN types t ON t.contract_id = c.contract_id""",
    "trace_scores": f"{_TRACE} SELECT contract_id, field_key, page_no, sort_order, n, ns, nb, CAST(rank AS INT) AS rank FROM top",
    "trace_sources": f"{_TRACE} SELECT contract_id, field_key, page_no, x1, y1, x2, y2, round(score, 6) AS score, span FROM found",
    "trace_attach": f"""{_TRACE} SELECT t.contract_id, t.field_key, coalesce(t.page_no, f.page_no) AS page_no, f.x1, f.y1, f.x2, f.y2
        FROM traces t LEFT JOIN found f ON f.contract_id = t.contract_id AND f.field_key = t.field_key""",
}
ORACLES["feed_upsert"] = feed_sql(
    f"WITH fields AS ({A.FIELDS_SQL}) SELECT contract_id, field_key, value, confidence, 'approved' AS review_status, 'r' AS reviewed_value FROM fields",
    ORACLES["upsert_fields"], ["contract_id", "field_key"], ["value", "confidence", "review_status", "reviewed_value"],
)
ORACLES["quality_by_place"] = f"""{_TRACE}, f AS (SELECT t.*, CASE WHEN sort_order IS NULL THEN 'none' WHEN sort_order % 5 = 0 THEN 'table' ELSE 'text' END AS place,
    CASE WHEN length(source_text) % 7 <> 0 THEN 'v' END AS value, CASE length(source_text) % 3 WHEN 0 THEN 'v' WHEN 1 THEN 'w' ELSE '' END AS golden
    FROM traces t LEFT JOIN found f ON f.contract_id = t.contract_id AND f.field_key = t.field_key)
  SELECT place, count(*) AS fields, round(count(*) FILTER (WHERE value IS NULL) / count(*), 4) AS null_rate,
    count(*) FILTER (WHERE golden <> '' AND value = golden) AS hits, count(*) FILTER (WHERE golden <> '') AS scored FROM f GROUP BY place"""
