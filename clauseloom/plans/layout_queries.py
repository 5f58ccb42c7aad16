"""Registered queries over block text and pages, each next to its reference SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from clauseloom.operators import extraction as E
from clauseloom.operators import layout as L
from clauseloom.operators.ordered import reading_order as order_blocks
from clauseloom.plans import adapters as A
from clauseloom.plans.clause_queries import BLOCKS, strip_sql


def document_text(spark, sf_dir):
    return L.document_text(A.blocks(spark, sf_dir))


def document_markdown(spark, sf_dir):
    return L.document_markdown(A.blocks(spark, sf_dir))


def load_pages(spark, sf_dir):
    sized = A.blocks(spark, sf_dir).selectExpr(
        "*", "1000 + sort_order AS page_width", "2000 - sort_order AS page_height",
        "CAST(NULL AS INT) AS paragraph_id", "CAST(NULL AS DOUBLE) AS font_size",
    )
    return L.load_pages(sized).selectExpr(
        "contract_id", "page_no", "page_width", "page_height", "size(blocks) AS n_blocks",
        "array_join(transform(blocks, b -> b.text), '|') AS texts", "round(aggregate(blocks, 0D, (s, b) -> s + b.confidence), 4) AS confidence",
    )


def titles(spark, sf_dir):
    return L.extract_title(A.blocks(spark, sf_dir))


def page_counts(spark, sf_dir):
    return L.page_count(A.blocks(spark, sf_dir))


_PARTIES = """CASE doc_id % 5 WHEN 0 THEN concat(substring(text, 1, 300), '甲方名称：', substring(text, 301))
  WHEN 1 THEN concat('乙方 ', text) WHEN 2 THEN concat(text, '甲方') ELSE text END"""


def keyword_contexts(spark, sf_dir):
    docs = A.table(spark, sf_dir, "documents").selectExpr("doc_id AS contract_id", f"{_PARTIES} AS text")
    return L.keyword_contexts(docs)


def ocr_diagnostics(spark, sf_dir):
    flat = A.blocks(spark, sf_dir)
    named = "CASE WHEN contract_id % 4 = 1 AND sort_order = 3 THEN concat(text, '甲方') ELSE text END AS text"
    return L.ocr_diagnostics(flat.selectExpr("contract_id", "page_no", "sort_order", named))


def page_chunks(spark, sf_dir):
    return L.page_chunks(L.page_markdown(A.blocks(spark, sf_dir)), pages_per_chunk=2, overlap=1)


def markdown_chunks(spark, sf_dir):
    docs = L.document_markdown(A.blocks(spark, sf_dir))
    cut = f"posexplode({L.chunk_markdown('markdown', 2, 1)}) AS (chunk_no, text)"
    return docs.selectExpr("contract_id", cut)


_TYPED = """concat(text, CASE doc_id % 6 WHEN 0 THEN '技术开发' WHEN 1 THEN '采购合同' WHEN 2 THEN '租赁' WHEN 3 THEN '购买技术' ELSE '' END)"""


def classify(spark, sf_dir):
    docs = A.table(spark, sf_dir, "documents")
    guess = L.classify_contract_type(_TYPED)
    return docs.selectExpr("doc_id AS contract_id", f"{guess} AS g").select("contract_id", "g.contract_type", "g.confidence")


# One sentence per contract type, as a caller would supply them.
HINTS = {"service": "看服务做什么、怎样算完成。", "purchase": "看买什么、何时交付。", "lease": "看租什么、租多久。"}


def classifier_samples(spark, sf_dir):
    docs = L.document_text(A.blocks(spark, sf_dir))
    return docs.selectExpr("contract_id", f"{L.classifier_sample('text')} AS sample")


def prompts(spark, sf_dir):
    docs = A.table(spark, sf_dir, "documents").selectExpr(
        "doc_id AS contract_id", "CASE doc_id % 4 WHEN 0 THEN 'service' WHEN 1 THEN 'lease' WHEN 2 THEN 'unknown' END AS contract_type"
    )
    chunks = L.page_chunks(L.page_markdown(A.blocks(spark, sf_dir)))
    hints = spark.createDataFrame(list(HINTS.items()), "contract_type STRING, hint STRING")
    return L.build_prompts(chunks, E.fields_for_type(docs, A.definitions(spark)), docs, hints)


def inference_status(spark, sf_dir):
    """Answers by order line; every seventh of an order's parts failed."""
    failed = "CASE WHEN l_partkey % 7 = 0 THEN 'timeout' END AS error"
    return L.inference_status(A.table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS contract_id", failed))


def reading_order(spark, sf_dir):
    return order_blocks(_shuffled(spark, sf_dir)).selectExpr("contract_id", "page_no", "sort_order", "text")


def _shuffled(spark, sf_dir):
    """Blocks whose recorded order differs from their place on the page."""
    return A.blocks(spark, sf_dir).selectExpr(
        "contract_id", "page_no", "(sort_order * 7) % 23 AS sort_order", "text", "bbox"
    )


QUERIES = {
    "document_text": document_text, "document_markdown": document_markdown, "load_pages": load_pages, "titles": titles,
    "page_counts": page_counts, "keyword_contexts": keyword_contexts, "ocr_diagnostics": ocr_diagnostics,
    "page_chunks": page_chunks, "markdown_chunks": markdown_chunks, "classify": classify,
    "classifier_samples": classifier_samples, "prompts": prompts,
    "inference_status": inference_status, "reading_order": reading_order,
}

# --- reference SQL -----------------------------------------------------------

_TEXT = f"""{BLOCKS}, doc AS (SELECT contract_id, string_agg(text, chr(10) ORDER BY page_no, sort_order) AS text
  FROM blocks GROUP BY contract_id)"""
_PAGES = f"""{BLOCKS}, pages AS (SELECT contract_id, page_no, concat('<!-- page: ', CAST(page_no AS VARCHAR), ' -->', chr(10), chr(10),
    string_agg(text, concat(chr(10), chr(10)) ORDER BY sort_order)) AS text FROM blocks GROUP BY contract_id, page_no)"""


def _chunks(p: int, step: int) -> str:
    return f"""{_PAGES}, idx AS (SELECT *, row_number() OVER (PARTITION BY contract_id ORDER BY page_no) - 1 AS i,
    count(*) OVER (PARTITION BY contract_id) AS n FROM pages),
 lasts AS (SELECT *, CASE WHEN n <= {p} THEN 0 ELSE CAST(ceil((n - {p}) / {step}) AS BIGINT) END AS last FROM idx),
 chunks AS (SELECT contract_id, CAST(k.k AS INT) AS chunk_no, min(page_no) AS first_page, max(page_no) AS last_page,
   concat(string_agg(text, concat(chr(10), chr(10)) ORDER BY page_no), CASE WHEN k.k < last THEN concat(chr(10), chr(10)) ELSE '' END) AS text
   FROM lasts, range(0, 100000) AS k(k) WHERE k.k <= last AND i >= k.k * {step} AND i < k.k * {step} + {p}
   GROUP BY contract_id, k.k, last)"""


_WORDS = "(VALUES ('甲方名称'), ('乙方名称'), ('甲方'), ('乙方')) AS w(keyword)"
_CTX = f"""WITH docs AS (SELECT doc_id AS contract_id, {_PARTIES} AS text FROM documents),
 hits AS (SELECT contract_id, keyword, text, strpos(text, keyword) AS hit FROM docs, {_WORDS}),
 cut AS (SELECT contract_id, keyword, substring(text, greatest(1, hit - 80), hit + length(keyword) + 120 - greatest(1, hit - 80)) AS t FROM hits WHERE hit > 0),
 flat AS (SELECT contract_id, keyword, regexp_replace({strip_sql('t')}, '\\s+', ' ', 'g') AS t FROM cut)"""

_HINTS = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in HINTS.items())

ORACLES = {
    "document_text": f"{_TEXT} SELECT * FROM doc",
    "document_markdown": f"""{_PAGES} SELECT contract_id, string_agg(text, concat(chr(10), chr(10)) ORDER BY page_no) AS markdown
        FROM pages GROUP BY contract_id""",
    "load_pages": f"""{BLOCKS} SELECT contract_id, page_no, 1000 + max(sort_order) AS page_width, 2000 - max(sort_order) AS page_height,
        CAST(count(*) AS INT) AS n_blocks, string_agg(text, '|' ORDER BY sort_order) AS texts, round(sum(confidence), 4) AS confidence
        FROM blocks GROUP BY contract_id, page_no""",
    "titles": f"""{BLOCKS}, l AS (SELECT *, {strip_sql('text')} AS t FROM blocks) SELECT contract_id,
        left(arg_min(t, page_no * 100 + sort_order) FILTER (WHERE length(t) > 3), 200) AS title FROM l GROUP BY contract_id""",
    "page_counts": f"{BLOCKS} SELECT contract_id, CAST(count(DISTINCT page_no) AS INT) AS page_count FROM blocks GROUP BY contract_id",
    "keyword_contexts": f"""{_CTX} SELECT contract_id, keyword, CASE WHEN length(t) <= 200 THEN t ELSE concat(left(t, 200), '...') END AS context
        FROM flat""",
    "ocr_diagnostics": f"""{BLOCKS} SELECT contract_id, count(DISTINCT page_no) AS page_count, count(*) AS block_count,
        CAST(sum(length(text) + CASE WHEN contract_id % 4 = 1 AND sort_order = 3 THEN 2 ELSE 0 END) + count(*) - 1 AS BIGINT) AS text_length,
        CASE WHEN contract_id % 4 = 1 AND bool_or(sort_order = 3) THEN '甲方' ELSE '' END AS keyword_hits,
        NOT (contract_id % 4 = 1 AND bool_or(sort_order = 3)) AS no_keyword FROM blocks GROUP BY contract_id""",
    "page_chunks": f"{_chunks(2, 1)} SELECT * FROM chunks",
    "markdown_chunks": f"{_chunks(2, 1)} SELECT contract_id, chunk_no, text FROM chunks",
    "classify": """SELECT doc_id AS contract_id,
        CASE doc_id % 6 WHEN 0 THEN 'service' WHEN 1 THEN 'purchase' WHEN 2 THEN 'lease' WHEN 3 THEN 'service' ELSE 'sale' END AS contract_type,
        CASE doc_id % 6 WHEN 0 THEN 0.85 WHEN 1 THEN 0.8 WHEN 2 THEN 0.8 WHEN 3 THEN 0.85 ELSE 0.7 END::DOUBLE AS confidence FROM documents""",
    "classifier_samples": f"{_TEXT} SELECT contract_id, text AS sample FROM doc",
    "prompts": f"""{_chunks(6, 5)}, defs AS (SELECT * FROM {A.definitions_sql()}),
     c AS (SELECT doc_id AS contract_id, CASE doc_id % 4 WHEN 0 THEN 'service' WHEN 1 THEN 'lease' WHEN 2 THEN 'unknown' END AS t FROM documents),
     deflines AS (SELECT c.contract_id, any_value(c.t) AS t, string_agg(concat('- field_key=', field_key, '；field_name=', field_name, '；value_type=', value_type,
         '；description=', description), chr(10) ORDER BY sort_order, field_key) AS field_lines FROM c JOIN defs d ON d.is_active AND
         (coalesce(c.t, 'unknown') = 'unknown' OR d.contract_type IS NULL OR d.contract_type = c.t) GROUP BY c.contract_id)
     SELECT ch.contract_id, chunk_no, concat_ws(concat(chr(10), chr(10)), '合同类型参考：' || CASE t {_HINTS} END,
       '需要抽取的字段：', field_lines, '下面是合同全文：', text) AS prompt FROM chunks ch JOIN deflines l ON l.contract_id = ch.contract_id""",
    "inference_status": """SELECT l_orderkey AS contract_id, count(*) AS chunks, count(*) FILTER (WHERE l_partkey % 7 = 0) AS failed_chunks,
        bool_or(l_partkey % 7 <> 0) AS ok FROM lineitem GROUP BY l_orderkey""",
    "reading_order": f"""{BLOCKS} SELECT contract_id, page_no, CAST(row_number() OVER (PARTITION BY contract_id, page_no
        ORDER BY coalesce(y1, 0), coalesce(x1, 0), (sort_order * 7) % 23) AS INT) AS sort_order, text FROM blocks""",
}
