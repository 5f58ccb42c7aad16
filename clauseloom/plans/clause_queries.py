"""Registered queries over blocks and clauses, each next to its reference SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from clauseloom.operators import clauses as C
from clauseloom.operators.clauses import SECTION_TITLES, TYPE_KEYWORDS
from clauseloom.plans import adapters as A


def clause_markers(spark, sf_dir):
    return C.clause_markers(A.blocks(spark, sf_dir))


def clause_segments(spark, sf_dir):
    return C.split_clauses(A.blocks(spark, sf_dir)).selectExpr(
        "contract_id", "sort_order", "clause_type", "clause_title", "content", "page_no", "page_end",
        "bbox.x1", "bbox.y1", "bbox.x2", "bbox.y2", "round(confidence, 3) AS confidence", "level",
    )


def clause_levels(spark, sf_dir):
    """Clauses per type and level with the characters they hold."""
    out = C.split_clauses(A.blocks(spark, sf_dir))
    return out.groupBy("clause_type", "level").agg(
        F.expr("count(*) AS clauses"), F.expr("sum(length(content)) AS chars")
    )


def text_clause_segments(spark, sf_dir):
    """Document texts with an article marker set before every sixth line."""
    lines = r"""array_join(transform(split(text, '\n'), (s, i) ->
      CASE WHEN i % 6 = 2 THEN concat('第', i + 1, '条 付款 ', s) WHEN i % 9 = 4 THEN '' ELSE s END), '\n') AS text"""
    return C.split_clauses_text(A.table(spark, sf_dir, "documents").selectExpr("doc_id AS contract_id", lines))


QUERIES = {
    "clause_markers": clause_markers,
    "clause_segments": clause_segments,
    "text_clause_segments": text_clause_segments,
    "clause_levels": clause_levels,
}

# --- reference SQL -----------------------------------------------------------

# RE2 classes are ASCII only, so whitespace is spelled out.
_WS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
STRIP = rf"regexp_replace({{0}}, '^{_WS}+|{_WS}+$', '', 'g')"


def strip_sql(expr: str) -> str:
    return STRIP.replace("{0}", expr)


# The numbering patterns as the checking engine writes them.
_PATTERNS = [
    ("article_cn", 0, r"^第\s*([一二三四五六七八九十百零\d]+)\s*条\s*([^\n]*)"),
    ("section_cn", 1, r"^([一二三四五六七八九十]+)\s*[、，]\s*([^\n]*)"),
    ("paren_cn", 1, r"^（([一二三四五六七八九十]+)）\s*([^\n]*)"),
    ("paren_num", 2, r"^（(\d+)）\s*([^\n]*)"),
    ("dotted_multi", 2, r"^(\d+(?:\.\d+)+)\s*([^\n]*)"),
    ("num_dot", 2, r"^(\d+)[.、，]\s*([^\n]*)"),
    ("article_en", 0, r"^[Aa][Rr][Tt][Ii][Cc][Ll][Ee]\s+(\d+)\s*([^\n]*)"),
]


def marker_case(line: str, what: str) -> str:
    """CASE giving 'pattern', 'marker', 'title' or 'level' of a stripped line."""
    arms = [f"WHEN length({line}) < 2 THEN NULL"]
    for name, level, body in _PATTERNS:
        p = body.replace(r"\s", _WS)
        num, rest = f"regexp_extract({line}, '{p}', 1)", f"regexp_extract({line}, '{p}', 2)"
        whole = f"regexp_extract({line}, '{p}', 0)"
        marker = {
            "article_cn": f"concat('第', {num}, '条')", "article_en": f"concat('Article ', {num})",
        }.get(name, strip_sql(f"substring({whole}, 1, length({whole}) - length({rest}))"))
        value = {
            "pattern": f"'{name}'", "marker": marker, "title": f"nullif({strip_sql(rest)}, '')", "level": str(level)
        }[what]
        arms.append(f"WHEN regexp_matches({line}, '{p}') THEN {value}")
    for title in SECTION_TITLES:
        value = {"pattern": "'section_title'", "marker": f"'{title}'", "title": "NULL", "level": "0"}[what]
        arms.append(f"WHEN starts_with({line}, '{title}') THEN {value}")
    return f"CASE {' '.join(arms)} END"


def type_case(title: str) -> str:
    return "CASE " + " ".join(f"WHEN contains({title}, '{w}') THEN '{t}'" for w, t in TYPE_KEYWORDS) + " END"


BLOCKS = f"WITH lines AS ({A.LINES_DUCK}), blocks AS ({A.BLOCKS_SQL})"

_MARKED = f"""{BLOCKS}, rows AS (SELECT *, {strip_sql('text')} AS txt FROM blocks),
 marked AS (SELECT *, {marker_case('txt', 'pattern')} AS pattern, {marker_case('txt', 'marker')} AS marker,
   {marker_case('txt', 'title')} AS tail, {marker_case('txt', 'level')} AS level FROM rows WHERE txt <> '')"""

_SEGMENTS = f"""{_MARKED}, kinds AS (SELECT *, CASE WHEN pattern IS NOT NULL THEN 'M' WHEN block_type = 'title' THEN 'T' ELSE 'X' END AS kind,
   CASE WHEN pattern IS NOT NULL THEN concat_ws(' ', marker, tail) WHEN block_type = 'title' THEN txt END AS head FROM marked),
 lagged AS (SELECT *, lag(kind) OVER w AS pk, lag(page_no) OVER w AS pp, lag(y2) OVER w AS py
   FROM kinds WINDOW w AS (PARTITION BY contract_id ORDER BY page_no, sort_order)),
 numbered AS (SELECT *, sum(CASE WHEN pk IS NULL OR (pk <> 'T' AND (kind <> 'X' OR coalesce(pp = page_no AND y1 - py > 50, false))) THEN 1 ELSE 0 END)
     OVER w AS clause_no,
   last_value(CASE WHEN head IS NOT NULL THEN {{'t': head, 'l': CASE WHEN kind = 'M' THEN level ELSE 0 END}} END IGNORE NULLS)
     OVER (PARTITION BY contract_id ORDER BY page_no, sort_order ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS h
   FROM lagged WINDOW w AS (PARTITION BY contract_id ORDER BY page_no, sort_order ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
 grouped AS (SELECT contract_id, CAST(clause_no AS INT) AS sort_order,
   arg_max(h, page_no * 100 + sort_order) AS h,
   string_agg(txt, chr(10) ORDER BY page_no, sort_order) AS content, min(page_no) AS page_no, max(page_no) AS last_page,
   first(x1 ORDER BY page_no, sort_order) AS x1, first(y1 ORDER BY page_no, sort_order) AS y1,
   first(x2 ORDER BY page_no, sort_order) AS x2, first(y2 ORDER BY page_no, sort_order) AS y2,
   round(round(avg(confidence), 4), 3) AS confidence FROM numbered GROUP BY contract_id, clause_no),
 clauses AS (SELECT contract_id, sort_order, {type_case('h.t')} AS clause_type, h.t AS clause_title, content, page_no,
   CASE WHEN last_page <> page_no THEN last_page END AS page_end, x1, y1, x2, y2, confidence, coalesce(h.l, 0) AS level FROM grouped)"""

CLAUSE_TITLES_SQL = f"{_SEGMENTS}, titles AS (SELECT contract_id, clause_title FROM clauses) "

_TEXT = f"""WITH raw AS (SELECT doc_id AS contract_id, u.p - 1 AS pos, u.line FROM documents,
    unnest(string_split(text, chr(10))) WITH ORDINALITY AS u(line, p)),
 lines AS (SELECT contract_id, pos, {strip_sql("CASE WHEN pos % 6 = 2 THEN concat('第', CAST(pos + 1 AS VARCHAR), '条 付款 ', line) WHEN pos % 9 = 4 THEN '' ELSE line END")} AS txt FROM raw),
 marked AS (SELECT *, {marker_case('txt', 'marker')} AS marker, {marker_case('txt', 'title')} AS tail,
   {marker_case('txt', 'level')} AS level FROM lines),
 numbered AS (SELECT *, sum(CASE WHEN marker IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY contract_id ORDER BY pos) AS part FROM marked),
 grouped AS (SELECT contract_id, part, max(concat_ws(' ', marker, tail)) FILTER (WHERE marker IS NOT NULL) AS title,
   max(level) AS level, {strip_sql("string_agg(txt, chr(10) ORDER BY pos)")} AS content FROM numbered GROUP BY contract_id, part)
SELECT contract_id, CAST(row_number() OVER (PARTITION BY contract_id ORDER BY part) AS INT) AS sort_order,
  {type_case('title')} AS clause_type, title AS clause_title, content, coalesce(level, 0) AS level
FROM grouped WHERE content <> ''"""

ORACLES = {
    "clause_markers": f"""{_MARKED} SELECT contract_id, page_no, sort_order, pattern, marker, tail AS trailing, level,
      {type_case("concat_ws(' ', marker, tail)")} AS clause_type FROM marked WHERE pattern IS NOT NULL""",
    "clause_segments": f"{_SEGMENTS} SELECT * FROM clauses",
    "text_clause_segments": _TEXT,
    "clause_levels": f"""{_SEGMENTS} SELECT clause_type, level, count(*) AS clauses,
      CAST(sum(length(content)) AS BIGINT) AS chars FROM clauses GROUP BY clause_type, level""",
}
