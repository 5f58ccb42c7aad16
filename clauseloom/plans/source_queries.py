"""Registered queries of intake, OCR responses and exports, each next to its reference SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from clauseloom.functions.boxes import decode_box
from clauseloom.plans import adapters as A
from clauseloom.plans.clause_queries import BLOCKS, strip_sql
from clauseloom.sources import definitions as D
from clauseloom.sources import exports as X
from clauseloom.sources import files as S
from clauseloom.sources import ocr as O
from clauseloom.sources import tables as T
from clauseloom.sources.store import Store
from clauseloom.streaming.jobs import work_folder

KEYS = ["party-a-name", "contract-amount", "end-date", "no-such-key"]
NAMES = ["甲方名称", "合同金额", "终止日期", "备注,其他"]


def intake_checks(spark, sf_dir):
    out = S.validate_intake(A.uploads(spark, sf_dir), max_size=20000)
    return out.select("page_id", "file_type", "content_hash", "stored_name", "reason")


def duplicate_files(spark, sf_dir):
    return S.duplicate_report(S.validate_intake(A.uploads(spark, sf_dir)))


def batch_checks(spark, sf_dir):
    scaled = A.uploads(spark, sf_dir).selectExpr("page_id", "batch_id", "file_name", "file_size * 1000 AS file_size")
    return S.validate_batch(scaled).select("page_id", "n_files", "reason")


def layout_blocks(spark, sf_dir):
    return O.blocks_from_layout(A.layout_responses(spark, sf_dir)).selectExpr(
        "contract_id", "page_no", "sort_order", "block_type", "text", "bbox.x1", "bbox.y2", "page_width", "page_height"
    )


def text_ocr_blocks(spark, sf_dir):
    return O.blocks_from_text_ocr(A.text_ocr_responses(spark, sf_dir)).selectExpr(
        "contract_id", "page_no", "sort_order", "text", "bbox.x1", "bbox.y1", "bbox.x2", "bbox.y2", "confidence"
    )


def text_ocr_errors(spark, sf_dir):
    responses = A.text_ocr_responses(spark, sf_dir)
    return O.text_ocr_errors(responses, O.blocks_from_text_ocr(responses))


def text_ocr_pages(spark, sf_dir):
    templates = A.blocks(spark, sf_dir).select("contract_id", "page_no").distinct().filter("contract_id % 3 <> 0").selectExpr(
        "contract_id", "page_no - 1 AS idx", "page_no + 10 AS page_no", "500 AS width", "700 AS height"
    )
    return O.pages_from_text_ocr(A.text_ocr_responses(spark, sf_dir), templates)


def span_blocks(spark, sf_dir):
    return O.block_types_from_spans(A.spans(spark, sf_dir))


def route_documents(spark, sf_dir):
    pages = A.lines(spark, sf_dir).selectExpr(
        "doc_id AS contract_id", "CAST(floor(pos / 4) AS INT) + 1 AS page_no", "pos",
        "CASE WHEN (pos + doc_id) % 3 = 0 THEN '' ELSE line END AS line",
    ).groupBy("contract_id", "page_no").agg(
        F.expr("array_join(transform(array_sort(collect_list(struct(pos, line))), x -> x.line), '') AS text")
    )
    return O.route_documents(pages)


def assign_keys(spark, sf_dir):
    """Parts as imported rows: every third names its key, names repeat."""
    rows = A.table(spark, sf_dir, "part").selectExpr(
        "CASE WHEN p_partkey % 3 = 0 THEN concat('key-', p_partkey % 60) END AS field_key", "p_name AS field_name",
        "p_type AS description", "'string' AS value_type", "p_partkey AS pos",
    )
    existing = A.table(spark, sf_dir, "part").filter("p_partkey < 30").selectExpr("concat('key-', p_partkey) AS field_key")
    return D.assign_field_keys(rows, existing, 23)


def _batch(spark, sf_dir):
    return A.batches(spark, sf_dir).selectExpr(
        "contract_id", "concat('contract-', contract_id, '.pdf') AS file_name",
        "CASE WHEN ocr_status = 'failed' THEN 'skipped' ELSE extraction_status END AS status",
        "CASE WHEN ocr_status = 'failed' THEN 'OCR \"x\", y' END AS error",
    )


def _fields(spark, sf_dir):
    return A.stored_fields(spark, sf_dir).selectExpr(
        "contract_id", "field_key", "value", "confidence", "pos AS page_no", "review_status",
        "CASE WHEN contract_id % 4 = 0 THEN 'a,\"b\"' WHEN contract_id % 4 = 1 THEN '' END AS reviewed_value",
    )


def export_wide(spark, sf_dir):
    return X.wide_results(_fields(spark, sf_dir), _batch(spark, sf_dir), KEYS)


def export_csv_lines(spark, sf_dir):
    return X.csv_lines(_fields(spark, sf_dir), _batch(spark, sf_dir), KEYS, NAMES)


def export_json_rows(spark, sf_dir):
    rows = X.json_rows(_fields(spark, sf_dir), _batch(spark, sf_dir), KEYS)
    cell = "element_at(fields, '{0}')"
    return rows.selectExpr(
        "index", "fileName AS file_name", "status", "error", "size(fields) AS n_fields",
        f"{cell.format('party-a-name')}.value AS a_value", f"{cell.format('party-a-name')}.reviewed_value AS a_reviewed",
        f"{cell.format('contract-amount')}.confidence AS amount_confidence", f"{cell.format('end-date')}.page_no AS end_page",
        f"{cell.format('no-such-key')} IS NULL AS absent_is_null",
    )


def replace_contracts(spark, sf_dir):
    old = A.blocks(spark, sf_dir).selectExpr("contract_id", "page_no", "sort_order", "text")
    new = old.filter("contract_id % 3 = 0 AND page_no = 1").selectExpr("contract_id", "page_no", "sort_order", "concat('NEW ', text) AS text")
    return T.replace_contracts(old, new)


def import_definitions(spark, sf_dir):
    """Parts written as one delimited text, with quotes and line ends inside cells, and read as definitions."""
    folder = work_folder(spark, "definitions")
    quoted = lambda e: f"concat('\"', replace({e}, '\"', '\"\"'), '\"')"
    name = "concat(p_name, CASE WHEN p_partkey % 7 = 0 THEN ' \"x\"' ELSE '' END, CASE WHEN p_partkey % 5 = 0 THEN '\\nsecond; line' ELSE '' END)"
    rows = A.table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS k",
        f"concat_ws(';', CASE WHEN p_partkey % 4 = 0 THEN '' ELSE concat('custom-', p_partkey) END, {quoted(name)}, {quoted('p_type')}, "
        "CASE WHEN p_partkey % 3 = 0 THEN 'number' ELSE '' END) AS value",
    )
    head = spark.range(1).selectExpr("-1L AS k", "'key;name;desc;type' AS value")
    rows.unionByName(head).repartition(1).sortWithinPartitions("k").select("value").write.text(f"{folder}/text")
    return D.read_field_definitions(spark, f"{folder}/text")


def decoded_boxes(spark, sf_dir):
    """Boxes kept as JSON text, as objects, lists, incomplete ones and none."""
    stored = A.blocks(spark, sf_dir).selectExpr(
        "contract_id", "page_no", "sort_order",
        "CASE sort_order % 4 WHEN 0 THEN to_json(bbox) WHEN 1 THEN to_json(array(bbox.x1, bbox.y1, bbox.x2, bbox.y2)) "
        "WHEN 2 THEN concat('{\"x1\":', bbox.x1, '}') ELSE concat('[', bbox.x1, ',2,3]') END AS stored",
    )
    return stored.selectExpr("contract_id", "page_no", "sort_order", f"{decode_box('stored')} AS b").selectExpr(
        "contract_id", "page_no", "sort_order", "b.x1", "b.y1", "b.x2", "b.y2"
    )


#: Batches of the stored table: batch b replaces every (b + 2)th contract; every fifth of those loses its rows.
_BATCHES = 6


def _stored_batches(spark, sf_dir):
    store = Store(spark, work_folder(spark, "store"), fan=3)
    fields = A.fields(spark, sf_dir).select("contract_id", "field_key", "value")
    for b in range(_BATCHES):
        touched = A.contracts(spark, sf_dir).filter(f"contract_id % {b + 2} = 0").select("contract_id")
        rows = fields.filter(f"contract_id % {b + 2} = 0 AND contract_id % 5 <> {b % 5}").withColumn("batch", F.lit(b))
        with store.batch(b) as made:
            made.write("fields", rows, touched)
    return store


def stored_batches(spark, sf_dir):
    """The current rows of a table replaced in batches, through merged runs."""
    return _stored_batches(spark, sf_dir).read("fields")


def stored_look_up(spark, sf_dir):
    """The current rows of the contracts that have a review, from the files that can hold them."""
    keys = A.reviews(spark, sf_dir).select("contract_id")
    return _stored_batches(spark, sf_dir).read("fields", keys)


QUERIES = {
    "intake_checks": intake_checks, "duplicate_files": duplicate_files, "batch_checks": batch_checks,
    "layout_blocks": layout_blocks, "text_ocr_blocks": text_ocr_blocks, "text_ocr_errors": text_ocr_errors,
    "text_ocr_pages": text_ocr_pages, "span_blocks": span_blocks, "route_documents": route_documents, "assign_keys": assign_keys,
    "export_wide": export_wide, "export_csv_lines": export_csv_lines, "export_json_rows": export_json_rows,
    "replace_contracts": replace_contracts, "import_definitions": import_definitions, "decoded_boxes": decoded_boxes,
    "stored_batches": stored_batches, "stored_look_up": stored_look_up,
}

# --- reference SQL -----------------------------------------------------------

_UP = """WITH named AS (SELECT page_id, page_id % 97 AS batch_id, concat(split_part(url, '?', 1),
    CASE page_id % 5 WHEN 0 THEN '.pdf' WHEN 1 THEN '.JPG' WHEN 2 THEN '.txt' WHEN 3 THEN '' ELSE '.bmp' END) AS file_name,
   CASE WHEN page_id % 31 = 7 THEN ''::BLOB ELSE CASE page_id % 8 WHEN 0 THEN unhex('25504446') WHEN 1 THEN unhex('89504E47') WHEN 2 THEN unhex('FFD8FF')
     WHEN 3 THEN unhex('474946383961') WHEN 4 THEN unhex('424D') WHEN 5 THEN unhex('49492A00') ELSE ''::BLOB END || encode(html) END AS content FROM pages),
 up AS (SELECT *, octet_length(content) AS file_size,
   CASE WHEN contains(file_name, '.') THEN lower(split_part(file_name, '.', -1)) ELSE '' END AS ext FROM named),
 typed AS (SELECT *, CASE WHEN page_id % 31 <> 7 AND page_id % 8 < 6 THEN ['pdf', 'png', 'jpg', 'gif', 'bmp', 'tiff'][page_id % 8 + 1]
   WHEN ext IN ('pdf', 'png', 'jpg', 'jpeg', 'gif', 'bmp', 'tiff', 'tif') THEN ext END AS file_type FROM up),
 stemmed AS (SELECT *, sha256(content) AS content_hash,
   coalesce(nullif(regexp_replace(regexp_replace(split_part(regexp_replace(file_name, '/+$', ''), '/', -1), '[^\\p{L}\\p{N}\\-_.]', '', 'g'), '^\\.+', ''), ''), 'upload') AS stem,
   CASE file_type WHEN 'pdf' THEN '.pdf' WHEN 'png' THEN '.png' WHEN 'jpg' THEN '.jpg' WHEN 'jpeg' THEN '.jpg' WHEN 'gif' THEN '.gif'
     WHEN 'bmp' THEN '.bmp' WHEN 'tiff' THEN '.tiff' WHEN 'tif' THEN '.tiff' ELSE '.bin' END AS dot FROM typed)"""
_LABEL = """CASE WHEN block_type = 'title' THEN 'title' WHEN sort_order % 5 = 0 THEN 'table' ELSE 'text' END"""
_OCR_DOCS = f"{BLOCKS}, src AS (SELECT * REPLACE (CASE sort_order % 19 WHEN 7 THEN '0' WHEN 11 THEN 'false' ELSE text END AS text), contract_id % 5 AS shape FROM blocks WHERE contract_id % 11 <> 0)"
_STATUS = "CASE status WHEN 'completed' THEN '完成' WHEN 'failed' THEN '失败' WHEN 'skipped' THEN '跳过' WHEN 'processing' THEN '处理中' ELSE '未处理' END"
_EXPORT = f"""WITH raw AS ({A.FIELDS_SQL}), fields AS (SELECT *, CASE WHEN contract_id % 4 = 0 THEN 'a,"b"' WHEN contract_id % 4 = 1 THEN '' END AS reviewed_value FROM raw),
 items AS ({A.BATCH_SQL}), batch AS (SELECT contract_id, row_number() OVER (ORDER BY contract_id) AS idx, concat('contract-', CAST(contract_id AS VARCHAR), '.pdf') AS file_name,
   CASE WHEN ocr_status = 'failed' THEN 'skipped' ELSE extraction_status END AS status, CASE WHEN ocr_status = 'failed' THEN 'OCR "x", y' END AS error FROM items)"""


def _cell(key: str, e: str) -> str:
    return f"coalesce(max(CASE WHEN field_key = '{key}' THEN {e} END), '')"


def _wide(e: str) -> str:
    cells = ", ".join(f"{_cell(k, e)} AS c{i}" for i, k in enumerate(KEYS))
    return f"wide AS (SELECT idx, any_value(file_name) AS file_name, any_value(status) AS status, any_value(error) AS error, {cells} FROM batch b LEFT JOIN fields f ON f.contract_id = b.contract_id GROUP BY idx)"


def _q(e: str) -> str:
    return f"""CASE WHEN regexp_matches({e}, '[",\\n]') THEN concat('"', replace({e}, '"', '""'), '"') ELSE {e} END"""


_REVIEWED = "coalesce(nullif(reviewed_value, ''), value)"
_LINE = "concat_ws(',', CAST(idx AS VARCHAR), " + ", ".join(
    _q(c) for c in ["file_name", "c0", "c1", "c2", "c3", f"({_STATUS})", "coalesce(error, '')"]
) + ")"

ORACLES = {
    "intake_checks": f"""{_UP} SELECT page_id, file_type, content_hash, CASE WHEN ends_with(lower(stem), dot) THEN stem ELSE concat(stem, dot) END AS stored_name,
        CASE WHEN file_name = '' THEN 'missing_name' WHEN file_size = 0 THEN 'empty_file' WHEN file_size > 20000 THEN 'too_large'
          WHEN file_type IS NULL THEN 'unsupported_type' END AS reason FROM stemmed""",
    "duplicate_files": f"{_UP} SELECT content_hash, count(*) AS copies, min(file_name) AS first_name FROM stemmed GROUP BY content_hash HAVING count(*) > 1",
    "batch_checks": f"""{_UP}, n AS (SELECT *, count(*) OVER (PARTITION BY batch_id) AS n_files FROM up) SELECT page_id, n_files,
        CASE WHEN n_files > 5 THEN 'too_many_files' WHEN ext NOT IN ('pdf', 'png', 'jpg', 'jpeg', 'bmp') THEN 'unsupported_type'
          WHEN file_size * 1000 > CASE WHEN ext = 'pdf' THEN 62914560 ELSE 5242880 END THEN 'too_large' END AS reason FROM n""",
    "layout_blocks": f"""{BLOCKS}, items AS (SELECT *, row_number() OVER (PARTITION BY contract_id ORDER BY page_no, sort_order) AS r,
          CAST(row_number() OVER (PARTITION BY contract_id, page_no ORDER BY sort_order) AS INT) AS i FROM blocks)
        SELECT contract_id, page_no, i AS sort_order, {_LABEL} AS block_type, {strip_sql('text')} AS text, x1, y2, 1192 AS page_width, 1636 AS page_height
        FROM items WHERE (contract_id + sort_order) % 7 <> 0 AND {strip_sql('text')} <> ''""",
    "text_ocr_blocks": f"""{_OCR_DOCS} SELECT contract_id, page_no, CAST(row_number() OVER (PARTITION BY contract_id, page_no
          ORDER BY coalesce(y1, 0), coalesce(x1, 0), sort_order) AS INT) AS sort_order, {strip_sql('text')} AS text, x1, y1, x2, y2, confidence
        FROM src WHERE {strip_sql('text')} <> ''""",
    "text_ocr_errors": "SELECT doc_id AS contract_id, CASE WHEN doc_id % 2 = 0 THEN 'OCR error 5: busy' ELSE 'OCR error E5: busy' END AS error FROM documents WHERE doc_id % 11 = 0",
    "text_ocr_pages": f"""{BLOCKS}, p AS (SELECT DISTINCT contract_id, page_no FROM blocks WHERE contract_id % 11 <> 0)
        SELECT contract_id, page_no AS position, CASE WHEN contract_id % 3 <> 0 THEN page_no + 10 ELSE page_no END AS page_no,
          CASE WHEN contract_id % 5 = 0 AND page_no = 1 THEN 800 WHEN contract_id % 3 <> 0 THEN 500 END AS page_width,
          CASE WHEN contract_id % 5 = 0 AND page_no = 1 THEN 1100 WHEN contract_id % 3 <> 0 THEN 700 END AS page_height FROM p""",
    "span_blocks": f"""WITH lines AS ({A.LINES_DUCK}), spans AS (SELECT doc_id, pos, line, u.k - 1 AS k FROM lines,
          unnest(range(1, len(string_split(line, ' ')) + 1)) AS u(k)),
        sized AS (SELECT doc_id, pos, any_value(line) AS line, max(9 + (pos * 3 + k + doc_id) % 6)::DOUBLE AS size FROM spans GROUP BY doc_id, pos)
        SELECT doc_id AS contract_id, CAST(floor(pos / 20) AS INT) + 1 AS page_no, CAST(floor(pos / 2) AS INT) AS block_no,
          {strip_sql("string_agg(replace(line, ' ', ''), chr(10) ORDER BY pos)")} AS text, max(size) AS font_size,
          CASE WHEN max(size) >= 14 THEN 'title' ELSE 'text' END AS block_type FROM sized GROUP BY ALL""",
    "route_documents": f"""WITH lines AS ({A.LINES_DUCK}), p AS (SELECT doc_id, floor(pos / 4) AS page, length({strip_sql("string_agg(CASE WHEN (pos + doc_id) % 3 = 0 THEN '' ELSE line END, '' ORDER BY pos)")}) AS n
          FROM lines GROUP BY doc_id, floor(pos / 4))
        SELECT doc_id AS contract_id, CAST(sum(n) AS BIGINT) AS text_length, count(*) FILTER (WHERE n > 0) AS text_pages, count(*) AS pages,
          CASE WHEN sum(n) >= 100 AND count(*) FILTER (WHERE n > 0) / count(*) >= 0.8 THEN 'text' ELSE 'ocr' END AS route FROM p GROUP BY doc_id""",
    "assign_keys": """WITH r AS (SELECT CASE WHEN p_partkey % 3 = 0 THEN concat('key-', CAST(p_partkey % 60 AS VARCHAR)) END AS given, p_name, p_type, p_partkey AS pos,
          coalesce(nullif(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'field') AS slug FROM part),
        m AS (SELECT *, given IS NOT NULL AND given NOT IN (SELECT concat('key-', CAST(p_partkey AS VARCHAR)) FROM part WHERE p_partkey < 30)
          AND row_number() OVER (PARTITION BY given ORDER BY pos) = 1 AS keeps FROM r),
        k AS (SELECT *, row_number() OVER (PARTITION BY slug, keeps ORDER BY pos) AS n FROM m)
        SELECT CASE WHEN keeps THEN given ELSE concat('custom-', slug, '-', CAST(n AS VARCHAR)) END AS field_key, p_name AS field_name, p_type AS description,
          'string' AS value_type, false AS required, CAST(23 + pos AS INT) AS sort_order, true AS is_active FROM k""",
    "export_wide": f"""{_EXPORT}, {_wide('value')} SELECT idx AS "序号", file_name AS "文件名", {', '.join(f'c{i} AS "{k}"' for i, k in enumerate(KEYS))},
        {_STATUS} AS "处理状态", coalesce(error, '') AS "错误信息" FROM wide""",
    "export_csv_lines": f"""{_EXPORT}, {_wide(_REVIEWED)} SELECT 0 AS idx, concat(chr(65279), '序号,文件名,甲方名称,合同金额,终止日期,"备注,其他",处理状态,错误信息') AS line
        UNION ALL SELECT idx, {_LINE} FROM wide""",
    "export_json_rows": f"""{_EXPORT} SELECT idx AS index, any_value(file_name) AS file_name, any_value(status) AS status, any_value(error) AS error, 4 AS n_fields,
        max(CASE WHEN field_key = 'party-a-name' THEN coalesce(value, '') END) AS a_value,
        max(CASE WHEN field_key = 'party-a-name' THEN reviewed_value END) AS a_reviewed,
        max(CASE WHEN field_key = 'contract-amount' THEN confidence END) AS amount_confidence,
        max(CASE WHEN field_key = 'end-date' THEN pos END) AS end_page, true AS absent_is_null
        FROM batch b LEFT JOIN fields f ON f.contract_id = b.contract_id GROUP BY idx""",
    "replace_contracts": f"""{BLOCKS} SELECT contract_id, page_no, sort_order, text FROM blocks WHERE contract_id NOT IN (SELECT contract_id FROM blocks WHERE contract_id % 3 = 0 AND page_no = 1)
        UNION ALL SELECT contract_id, page_no, sort_order, concat('NEW ', text) FROM blocks WHERE contract_id % 3 = 0 AND page_no = 1""",
}
_NEWEST = f"""WITH fields AS ({A.FIELDS_SQL}), reviews AS ({A.REVIEWS_SQL}),
 newest AS (SELECT o_orderkey AS contract_id, max(b) AS batch FROM orders, range({_BATCHES}) r(b) WHERE o_orderkey % (b + 2) = 0 GROUP BY 1)
 SELECT contract_id, field_key, value, CAST(batch AS INT) AS batch FROM fields JOIN newest USING (contract_id) WHERE contract_id % 5 <> batch % 5"""
ORACLES |= {
    "import_definitions": """SELECT CASE WHEN p_partkey % 4 <> 0 THEN concat('custom-', CAST(p_partkey AS VARCHAR)) END AS field_key,
        concat(p_name, CASE WHEN p_partkey % 7 = 0 THEN ' "x"' ELSE '' END, CASE WHEN p_partkey % 5 = 0 THEN concat(chr(10), 'second; line') ELSE '' END) AS field_name,
        p_type AS description, CASE WHEN p_partkey % 3 = 0 THEN 'number' ELSE 'string' END AS value_type FROM part""",
    "decoded_boxes": f"""{BLOCKS} SELECT contract_id, page_no, sort_order, CASE WHEN sort_order % 4 < 2 THEN x1 END AS x1, CASE WHEN sort_order % 4 < 2 THEN y1 END AS y1,
        CASE WHEN sort_order % 4 < 2 THEN x2 END AS x2, CASE WHEN sort_order % 4 < 2 THEN y2 END AS y2 FROM blocks""",
    "stored_batches": _NEWEST,
    "stored_look_up": f"{_NEWEST} AND contract_id IN (SELECT contract_id FROM reviews)",
}
