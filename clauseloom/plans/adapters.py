"""Views of the given tables in the engine's schemas.

Each adapter is SQL text. ``FIELDS_SQL`` and ``REVIEWS_SQL`` read the same in
Spark and in the checking engine; for blocks only the line split differs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseloom.functions.boxes import make_box
from clauseloom.functions.text import quote
from clauseloom.schemas import DEFINITIONS, seed_rows

LINES_SPARK = "SELECT doc_id, pos, line FROM documents LATERAL VIEW posexplode(split(text, '\\n')) t AS pos, line"
LINES_DUCK = (
    "SELECT doc_id, u.p - 1 AS pos, u.line "
    "FROM documents, unnest(string_split(text, chr(10))) WITH ORDINALITY AS u(line, p)"
)

BLOCKS_SQL = """
SELECT doc_id AS contract_id,
  CAST(floor(pos / 20) AS INT) + 1 AS page_no,
  CAST(pos % 20 AS INT) + 1 AS sort_order,
  CASE WHEN pos % 11 = 5 THEN 'title' ELSE 'text' END AS block_type,
  CASE WHEN pos % 7 = 0 THEN concat('第', CAST(CAST(floor(pos / 7) AS INT) + 1 AS STRING), '条 ',
         CASE CAST(floor(pos / 7) AS INT) % 6 WHEN 0 THEN '付款方式' WHEN 1 THEN '交付' WHEN 2 THEN '验收标准'
           WHEN 3 THEN '知识产权' WHEN 4 THEN '违约责任' ELSE '争议解决' END)
       WHEN pos % 7 = 3 THEN concat('（', CAST(pos % 9 + 1 AS STRING), '）', line)
       ELSE line END AS text,
  CASE WHEN pos % 13 = 12 THEN NULL ELSE CAST(50 AS DOUBLE) END AS x1,
  CASE WHEN pos % 13 = 12 THEN NULL ELSE CAST((pos % 20) * 70 - CASE WHEN pos % 3 = 0 THEN 25 ELSE 0 END AS DOUBLE) END AS y1,
  CASE WHEN pos % 13 = 12 THEN NULL ELSE CAST(50 + 8 * least(length(line), 90) AS DOUBLE) END AS x2,
  CASE WHEN pos % 13 = 12 THEN NULL ELSE CAST((pos % 20) * 70 + 30 - CASE WHEN pos % 3 = 0 THEN 25 ELSE 0 END AS DOUBLE) END AS y2,
  CAST((pos * 37 + doc_id) % 100 AS DOUBLE) / 100 AS confidence
FROM lines"""

FIELDS_SQL = """
WITH b AS (SELECT o_orderkey AS k, c_name, o_orderpriority AS pr, o_totalprice AS tp, CAST(o_orderdate AS DATE) AS d
           FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT k AS contract_id, 'party-a-name' AS field_key, 1 AS pos,
       CASE WHEN k % 11 = 0 THEN NULL WHEN k % 13 = 0 THEN '  ' ELSE c_name END AS value,
       CAST(NULL AS STRING) AS source_text, CAST((k * 7 + 13) % 100 AS DOUBLE) / 100 AS confidence FROM b WHERE k % 17 <> 0
UNION ALL SELECT k, 'party-b-name', 2, pr, NULL, CAST((k * 7 + 26) % 100 AS DOUBLE) / 100 FROM b WHERE k % 19 <> 0
UNION ALL SELECT k, 'contract-amount', 3,
       CASE WHEN k % 10 = 0 THEN '0' WHEN k % 10 = 1 THEN concat('-', CAST(CAST(floor(tp) AS BIGINT) AS STRING))
            WHEN k % 10 = 2 THEN '人民币若干元' ELSE CAST(CAST(floor(tp) AS BIGINT) AS STRING) END,
       CASE k % 4 WHEN 0 THEN '人民币壹佰贰拾万元整（¥1,200,000.00）' WHEN 1 THEN '人民币叁万元整（¥30,500.00）'
            WHEN 2 THEN '人民币壹拾万元整' ELSE NULL END, CAST((k * 7 + 39) % 100 AS DOUBLE) / 100 FROM b
UNION ALL SELECT k, 'sign-date', 4, CASE WHEN k % 2 = 0 THEN CAST(d AS STRING)
       ELSE concat(CAST(year(d) AS STRING), '年', CAST(month(d) AS STRING), '月', CAST(day(d) AS STRING), '日') END,
       NULL, CAST((k * 7 + 52) % 100 AS DOUBLE) / 100 FROM b
UNION ALL SELECT k, 'effective-date', 5, CAST(d + CAST(k % 40 AS INT) AS STRING), NULL, CAST((k * 7 + 65) % 100 AS DOUBLE) / 100 FROM b
UNION ALL SELECT k, 'end-date', 6, CAST(d + 20 AS STRING), NULL, CAST((k * 7 + 78) % 100 AS DOUBLE) / 100 FROM b WHERE k % 23 <> 0
UNION ALL SELECT k, 'ratio-first', 7, '30%', NULL, CAST(0.9 AS DOUBLE) FROM b
UNION ALL SELECT k, 'ratio-second', 8, CASE WHEN k % 5 = 0 THEN '60%' ELSE '70％' END, NULL, CAST(0.9 AS DOUBLE) FROM b WHERE k % 3 <> 0"""

REVIEWS_SQL = """
SELECT event_id, event_id % 1500 AS contract_id,
  CASE user_id % 3 WHEN 0 THEN 'party-a-name' WHEN 1 THEN 'contract-amount' ELSE 'end-date' END AS field_key,
  CASE event_type WHEN 'click' THEN 'approve' WHEN 'error' THEN 'reject' WHEN 'view' THEN 'reviewed' ELSE 'modify' END AS action,
  CASE event_type WHEN 'purchase' THEN props WHEN 'signup' THEN '' ELSE NULL END AS new_value,
  CAST(user_id AS STRING) AS reviewer_id, ts AS created_at
FROM events"""

CONTRACTS_SQL = """
SELECT o_orderkey AS contract_id,
  CASE o_orderkey % 5 WHEN 0 THEN 'service' WHEN 1 THEN 'lease' WHEN 2 THEN 'unknown' WHEN 3 THEN 'purchase' ELSE NULL END AS contract_type,
  CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'reviewing' ELSE 'processing' END AS status,
  CAST(o_orderdate AS DATE) AS created_at
FROM orders"""

FILES_SQL = """
SELECT o_orderkey AS contract_id, 1 AS version, concat('contract-', CAST(o_orderkey AS STRING), '.pdf') AS file_name, 'pdf' AS file_type FROM orders
UNION ALL SELECT o_orderkey, 2, concat('contract-', CAST(o_orderkey AS STRING), '-v2.png'), 'png' FROM orders WHERE o_orderkey % 2 = 0"""


# The rows of FIELDS_SQL from one pass over the joined orders.
_FIELD_ROWS = """
stack(8,
  'party-a-name', 1, CASE WHEN k % 11 = 0 THEN NULL WHEN k % 13 = 0 THEN '  ' ELSE c_name END,
         CAST(NULL AS STRING), CAST((k * 7 + 13) % 100 AS DOUBLE) / 100, k % 17 <> 0,
  'party-b-name', 2, pr, NULL, CAST((k * 7 + 26) % 100 AS DOUBLE) / 100, k % 19 <> 0,
  'contract-amount', 3, CASE WHEN k % 10 = 0 THEN '0' WHEN k % 10 = 1 THEN concat('-', tp) WHEN k % 10 = 2 THEN '人民币若干元' ELSE tp END,
         CASE k % 4 WHEN 0 THEN '人民币壹佰贰拾万元整（¥1,200,000.00）' WHEN 1 THEN '人民币叁万元整（¥30,500.00）' WHEN 2 THEN '人民币壹拾万元整' END,
         CAST((k * 7 + 39) % 100 AS DOUBLE) / 100, true,
  'sign-date', 4, CASE WHEN k % 2 = 0 THEN CAST(d AS STRING) ELSE concat(year(d), '年', month(d), '月', day(d), '日') END, NULL,
         CAST((k * 7 + 52) % 100 AS DOUBLE) / 100, true,
  'effective-date', 5, CAST(d + CAST(k % 40 AS INT) AS STRING), NULL, CAST((k * 7 + 65) % 100 AS DOUBLE) / 100, true,
  'end-date', 6, CAST(d + 20 AS STRING), NULL, CAST((k * 7 + 78) % 100 AS DOUBLE) / 100, k % 23 <> 0,
  'ratio-first', 7, '30%', NULL, CAST(0.9 AS DOUBLE), true,
  'ratio-second', 8, CASE WHEN k % 5 = 0 THEN '60%' ELSE '70％' END, NULL, CAST(0.9 AS DOUBLE), k % 3 <> 0) AS (field_key, pos, value, source_text, confidence, keep)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def adapted(spark: SparkSession, sf_dir: str, sql: str, name: str) -> DataFrame:
    """Run adapter SQL with one named table bound as its input."""
    return spark.sql(sql.replace(f"FROM {name}", f"FROM {{{name}}}"), **{name: table(spark, sf_dir, name)})


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr("doc_id", r"posexplode(split(text, '\n')) AS (pos, line)")


def flat_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks with the box as four columns."""
    return spark.sql(BLOCKS_SQL.replace("FROM lines", "FROM {lines}"), lines=lines(spark, sf_dir))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = f"CASE WHEN x1 IS NOT NULL THEN {make_box('x1', 'y1', 'x2', 'y2')} END AS bbox"
    return flat_blocks(spark, sf_dir).selectExpr(
        "contract_id", "page_no", "sort_order", "block_type", "text", "confidence", box
    )


def fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS k", "o_custkey", "o_orderpriority AS pr", "CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING) AS tp",
        "CAST(o_orderdate AS DATE) AS d",
    )
    customer = table(spark, sf_dir, "customer").selectExpr("c_custkey AS o_custkey", "c_name")
    rows = orders.join(customer, "o_custkey").selectExpr("k AS contract_id", _FIELD_ROWS)
    return rows.filter("keep").drop("keep")


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapted(spark, sf_dir, REVIEWS_SQL, "events")


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapted(spark, sf_dir, CONTRACTS_SQL, "orders")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapted(spark, sf_dir, FILES_SQL, "orders")


# The fields inside the model answers: chunk 1 repeats them with other
# confidences and drops every third value.
ANSWERED_SQL = f"""
SELECT contract_id, 0 AS chunk_no, pos, field_key, value, source_text, pos AS source_page, confidence FROM ({FIELDS_SQL}) f
UNION ALL SELECT contract_id, 1, pos, field_key, CASE WHEN (contract_id + pos) % 3 = 0 THEN NULL ELSE value END, source_text,
  pos + 6, round(1 - confidence, 2) FROM ({FIELDS_SQL}) f"""


def answered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``ANSWERED_SQL``, two chunks per contract."""
    return fields(spark, sf_dir).selectExpr(
        "contract_id", "pos", "field_key", "source_text",
        "inline(array(struct(0 AS chunk_no, value AS value, pos AS source_page, confidence AS confidence), "
        "struct(1 AS chunk_no, CASE WHEN (contract_id + pos) % 3 = 0 THEN NULL ELSE value END AS value, "
        "pos + 6 AS source_page, round(1 - confidence, 2) AS confidence)))",
    )


def model_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw model answers built from the fields, in five wrappings by contract.

    Pages come as numbers, texts and numbers with a point; boxes mix numbers and texts of numbers.
    """
    plain_members = (
        "to_json(struct(field_key, value AS field_value, source_text, confidence), map('ignoreNullFields', 'false'))"
    )
    page = "CASE pos % 3 WHEN 0 THEN CAST(source_page AS STRING) WHEN 1 THEN concat('\"', source_page, '\"') ELSE concat(source_page, '.0') END"
    box = "concat('[', pos, ',\"', pos + 1, '\",', pos, '.5,', pos + 4, ']')"
    element = f"concat(rtrim('}}', {plain_members}), ',\"source_page\":', {page}, ',\"source_bbox\":', {box}, '}}')"
    packed = answered(spark, sf_dir).selectExpr(
        "contract_id", "chunk_no", "pos", "field_key", f"{element} AS j"
    ).groupBy("contract_id", "chunk_no").agg(F.expr("array_sort(collect_list(struct(pos, field_key, j))) AS items"))
    listed = "array_join(transform(items, x -> x.j), ',')"
    mapped = "array_join(transform(items, x -> concat('\"', x.field_key, '\":', x.j)), ',')"
    kind = "CASE WHEN chunk_no = 1 THEN 'lease' WHEN contract_id % 4 = 0 THEN 'unknown' ELSE 'service' END"
    plain = f"concat('{{\"fields\":[', {listed}, '],\"contract_type\":\"', {kind}, '\",\"contract_type_confidence\":0.9}}')"
    return packed.selectExpr(
        "contract_id", "chunk_no",
        f"CASE contract_id % 5 WHEN 0 THEN {plain} WHEN 1 THEN concat('```json\\n', {plain}, '\\n```') "
        f"WHEN 2 THEN concat('结果如下：', {plain}, ' 以上。') "
        f"WHEN 3 THEN concat('{{', {mapped}, ',\"contract_type\":\"', {kind}, '\"}}') "
        f"ELSE left({plain}, length({plain}) - 5) END AS raw",
        "CAST(NULL AS STRING) AS error",
    )


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every document as a field to trace, in odd documents two lines each.

    Every third document does not know its pages.
    """
    docs = table(spark, sf_dir, "documents").selectExpr("doc_id", r"split(text, '\\n') AS ls")
    return docs.selectExpr("doc_id", "ls", "posexplode(ls) AS (pos, line)").selectExpr(
        "doc_id AS contract_id", "concat('f', pos) AS field_key", "'v' AS value",
        "CASE WHEN doc_id % 2 = 0 THEN line ELSE concat(line, ' ', coalesce(get(ls, pos + 1), '')) END AS source_text",
        "CASE WHEN doc_id % 3 <> 0 THEN CAST(floor(pos / 20) AS INT) + 1 END AS page_no",
        "CAST(NULL AS STRUCT<x1: DOUBLE, y1: DOUBLE, x2: DOUBLE, y2: DOUBLE>) AS bbox",
    )


# The 23 default definitions plus two type-specific and one inactive row.
EXTRA_DEFINITIONS = [
    ("lease-term", "租赁期限", "租赁起止", "string", False, 30, True, "lease"),
    ("service-scope", "服务范围", "服务内容", "string", False, 31, True, "service"),
    ("old-field", "旧字段", "停用", "string", False, 32, False, None),
]


def definitions(spark: SparkSession, extra: bool = True) -> DataFrame:
    """The definitions as literals, whose size the planner knows: it broadcasts them and leaves the other side unshuffled."""
    rows = seed_rows() + (EXTRA_DEFINITIONS if extra else [])
    cell = lambda v: "NULL" if v is None else quote(v) if isinstance(v, str) else str(v).lower()
    shape = [f.split() for f in DEFINITIONS.split(",")]
    listed = ", ".join(f"({', '.join(map(cell, r))})" for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {listed} AS d({', '.join(n for n, _ in shape)})").selectExpr(
        *[f"CAST({n} AS {t}) AS {n}" for n, t in shape]
    )


def definitions_sql(extra: bool = True) -> str:
    """The same rows as a VALUES list."""
    def cell(v):
        if v is None:
            return "CAST(NULL AS VARCHAR)"
        return str(v).lower() if isinstance(v, (bool, int)) else "'" + v + "'"

    rows = seed_rows() + (EXTRA_DEFINITIONS if extra else [])
    names = "field_key, field_name, description, value_type, required, sort_order, is_active, contract_type"
    return f"(VALUES {', '.join('(' + ', '.join(cell(v) for v in r) + ')' for r in rows)}) AS d({names})"


# Fields in their freshly extracted state, with the review columns.
_FRESH = ["'extracted' AS review_status", "CAST(NULL AS STRING) AS reviewed_value", "CAST(NULL AS STRING) AS reviewer_id",
          "CAST(NULL AS TIMESTAMP_NTZ) AS reviewed_at"]


def stored_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields(spark, sf_dir).selectExpr("*", *_FRESH)


TASKS_SQL = """
SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS contract_id,
  CASE l_returnflag WHEN 'A' THEN 'running' WHEN 'N' THEN 'pending' ELSE 'retrying' END AS status,
  l_linenumber % 5 AS attempts, 3 AS max_attempts, CAST(l_quantity AS INT) % 10 AS priority,
  l_shipdate AS queued_at, l_shipdate AS lease_expires_at,
  CASE WHEN l_linenumber % 3 = 0 THEN l_shipdate END AS next_run_at, l_shipdate AS created_at
FROM lineitem"""

TASK_EVENTS_SQL = """
SELECT event_id, user_id AS task_id, ts AS created_at,
  CASE event_type WHEN 'click' THEN 'ocr' WHEN 'view' THEN 'extracting' WHEN 'error' THEN 'ocr_failed'
    WHEN 'purchase' THEN 'completed' ELSE 'extraction_failed' END AS event
FROM events"""

BATCH_SQL = """
SELECT o_orderkey AS contract_id, o_custkey AS batch_id,
  CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'completed' ELSE 'processing' END AS ocr_status,
  CASE o_orderkey % 4 WHEN 0 THEN 'completed' WHEN 1 THEN 'failed' WHEN 2 THEN 'processing' ELSE 'pending' END AS extraction_status
FROM orders"""


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapted(spark, sf_dir, TASKS_SQL, "lineitem")


def task_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapted(spark, sf_dir, TASK_EVENTS_SQL, "events")


def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapted(spark, sf_dir, BATCH_SQL, "orders")


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as uploaded files, with the leading bytes of several types."""
    head = """CASE page_id % 8 WHEN 0 THEN X'25504446' WHEN 1 THEN X'89504E47' WHEN 2 THEN X'FFD8FF' WHEN 3 THEN X'474946383961'
      WHEN 4 THEN X'424D' WHEN 5 THEN X'49492A00' ELSE X'' END"""
    name = "concat(split_part(url, '?', 1), CASE page_id % 5 WHEN 0 THEN '.pdf' WHEN 1 THEN '.JPG' WHEN 2 THEN '.txt' WHEN 3 THEN '' ELSE '.bmp' END)"
    return table(spark, sf_dir, "pages").selectExpr(
        "page_id", "page_id % 97 AS batch_id", f"{name} AS file_name",
        f"CASE WHEN page_id % 31 = 7 THEN X'' ELSE concat({head}, CAST(html AS BINARY)) END AS content",
    ).selectExpr("*", "CAST(length(content) AS BIGINT) AS file_size")


def layout_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks wrapped as layout-OCR answers; every seventh item is a seal, every third document has no outer result."""
    label = """CASE WHEN (contract_id + sort_order) % 7 = 0 THEN 'seal' WHEN block_type = 'title' THEN 'doc_title'
      WHEN sort_order % 5 = 0 THEN 'table' ELSE 'paragraph' END AS block_label"""
    box = "CASE WHEN bbox IS NULL THEN array(1D, 2D) ELSE array(bbox.x1, bbox.y1, bbox.x2, bbox.y2) END AS block_bbox"
    items = blocks(spark, sf_dir).selectExpr("contract_id", "page_no", "sort_order", label, "text AS block_content", box)
    pages = items.groupBy("contract_id", "page_no").agg(
        F.expr("transform(array_sort(collect_list(struct(sort_order, block_label, block_content, block_bbox))), "
               "x -> struct(x.block_label, x.block_content, x.block_bbox)) AS parsing_res_list")
    )
    docs = pages.groupBy("contract_id").agg(
        F.expr("transform(array_sort(collect_list(struct(page_no, parsing_res_list))), "
               "p -> struct(struct(1192 AS width, 1636 AS height, p.parsing_res_list) AS prunedResult)) AS layoutParsingResults")
    )
    body = "to_json(struct(layoutParsingResults))"
    return docs.selectExpr(
        "contract_id", f"CASE contract_id % 3 WHEN 0 THEN {body} ELSE concat('{{\"result\":', {body}, '}}') END AS body"
    )


def text_ocr_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks as text-OCR answers in five shapes by document, all pages of it; documents divisible by 11 report an error.

    Documents of one page come without a page list, but for those of the first shape. Some texts read 0 or false.
    """
    rows = blocks(spark, sf_dir).selectExpr(
        "contract_id", "page_no", "sort_order", "CASE sort_order % 19 WHEN 7 THEN '0' WHEN 11 THEN 'false' ELSE text END AS text",
        "confidence AS score",
        "CASE WHEN bbox IS NOT NULL THEN array(array(bbox.x1, bbox.y1), array(bbox.x2, bbox.y1), array(bbox.x2, bbox.y2), array(bbox.x1, bbox.y2)) END AS poly",
        "CASE WHEN bbox IS NOT NULL THEN array(bbox.x1, bbox.y1, bbox.x2, bbox.y2) END AS flat",
    )
    pages = rows.groupBy("contract_id", "page_no").agg(
        F.expr("array_sort(collect_list(struct(sort_order, text, score, poly, flat))) AS l")
    )
    keep = "map('ignoreNullFields', 'false')"
    pages = pages.selectExpr(
        "contract_id", "page_no",
        f"to_json(struct(transform(l, x -> x.text) AS rec_texts, transform(l, x -> x.poly) AS rec_polys, transform(l, x -> x.score) AS rec_scores), {keep}) AS lists",
        f"to_json(transform(l, x -> struct(x.text AS transcription, x.poly AS points, x.score AS score)), {keep}) AS objects",
        f"to_json(transform(l, x -> struct(x.text AS text, x.flat AS bbox, x.score AS confidence)), {keep}) AS flats",
        f"concat('[', array_join(transform(l, x -> concat('[', coalesce(to_json(x.poly), 'null'), ',[', substring(to_json(array(x.text)), 2, length(to_json(array(x.text))) - 2), ',', x.score, ']]')), ','), ']') AS pairs",
    )
    docs = pages.groupBy("contract_id").agg(F.expr("array_sort(collect_list(struct(page_no, lists, objects, flats, pairs))) AS p"))
    paged = "concat('{\"errorCode\":0,\"result\":{\"ocrResults\":[', array_join(transform(p, x -> concat('{\"prunedResult\":', x.lists, '}')), ','), '],\"dataInfo\":{\"width\":800,\"height\":1100}}}')"
    page = """CASE contract_id % 5 WHEN 1 THEN concat('{"data":', x.objects, '}') WHEN 2 THEN concat('{"results":', x.lists, '}')
      WHEN 3 THEN concat('{"result":', x.flats, '}') ELSE concat('{"ocr_results":', x.pairs, '}') END"""
    several = f"concat('{{\"errorCode\":null,\"result\":{{\"ocrResults\":[', array_join(transform(p, x -> concat('{{\"prunedResult\":', {page}, '}}')), ','), ']}}}}')"
    return docs.selectExpr(
        "contract_id",
        f"""CASE WHEN contract_id % 11 = 0 THEN concat('{{"errorCode":', CASE WHEN contract_id % 2 = 0 THEN '5' ELSE '"E5"' END, ',"errorMsg":"busy"}}')
          WHEN contract_id % 5 = 0 THEN {paged}
          WHEN size(p) = 1 THEN transform(p, x -> {page})[0] ELSE {several} END AS body""",
    )


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of document lines as text spans of varying size."""
    words = r"posexplode(split(line, ' ')) AS (span_no, text)"
    return lines(spark, sf_dir).selectExpr("doc_id", "pos", words).selectExpr(
        "doc_id AS contract_id", "CAST(floor(pos / 20) AS INT) + 1 AS page_no", "CAST(floor(pos / 2) AS INT) AS block_no",
        "pos % 2 AS line_no", "span_no", "text", "CAST(9 + (pos * 3 + span_no + doc_id) % 6 AS DOUBLE) AS size",
    )
