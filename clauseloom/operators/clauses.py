"""Clause detection and segmentation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauseloom.functions.text import WS, blank_to_null, has_content, regex, strip
from clauseloom.operators.layout import tie
from clauseloom.operators.ordered import BLOCK_BITS, PAGE_BITS

K = "contract_id"
VERTICAL_GAP = 50.0

# Numbering patterns in match order (name, level, prefix).
MARKERS = [
    ("article_cn", 0, r"第\s*[一二三四五六七八九十百零\d]+\s*条\s*"),
    ("section_cn", 1, r"[一二三四五六七八九十]+\s*[、，]\s*"),
    ("paren_cn", 1, r"（[一二三四五六七八九十]+）\s*"),
    ("paren_num", 2, r"（\d+）\s*"),
    ("dotted_multi", 2, r"\d+(?:\.\d+)+\s*"),
    ("num_dot", 2, r"\d+[.、，]\s*"),
    ("article_en", 0, r"[Aa][Rr][Tt][Ii][Cc][Ll][Ee]\s+\d+\s*"),
]
LEVELS = {name: level for name, level, _ in MARKERS} | {"section_title": 0}

# Un-numbered section titles, tested as prefixes in this order.
SECTION_TITLES = ["定义", "附则", "其他约定", "其他", "一般规定", "特别约定", "补充条款", "免责条款", "管辖与争议解决"]

# Clause type by keyword in the title, first match wins.
TYPE_KEYWORDS = [
    ("付款", "payment"), ("支付", "payment"), ("违约", "breach"), ("保密", "confidentiality"),
    ("不可抗力", "force_majeure"), ("争议", "dispute"), ("期限", "term"), ("有效", "term"),
    ("知识产权", "intellectual_property"), ("担保", "guarantee"), ("保证", "guarantee"),
    ("终止", "termination"), ("解除", "termination"), ("项目", "project"), ("工期", "schedule"),
    ("交付", "delivery"), ("质量", "quality"), ("验收", "acceptance"), ("适用", "governing_law"),
    ("通知", "notice"), ("转让", "assignment"), ("签署", "execution"), ("其他", "miscellaneous"),
    ("附则", "miscellaneous"), ("附件", "appendix"), ("定义", "definition"),
    ("权利", "rights_obligations"), ("义务", "rights_obligations"), ("管辖", "dispute"),
]

# One alternation tries the numbering prefixes in their order.
_NUMBERED = "|".join(body.replace(r"\s", WS).replace(r"\d", r"\p{Nd}") for _, _, body in MARKERS)
_SECTIONS = "|".join(SECTION_TITLES)
PREFIX = f"^(?:{_NUMBERED})"
OPENER = f"^(?:{_NUMBERED}|{_SECTIONS})"


def opens_clause(line: str) -> str:
    """Does a stripped line carry a clause marker? One regex, cheap to push down."""
    return f"(length({line}) >= 2 AND {line} RLIKE {regex(OPENER)})"


def with_marker(df: DataFrame, line: str) -> DataFrame:
    """Add the clause marker of a stripped line as m_pattern, m_marker, m_title, m_level.

    All NULL when the line starts no clause. A single regex finds the
    numbering prefix; its kind follows from the prefix itself. Article markers
    are put in a standard form, the others keep the literal prefix. Steps are
    separate projections so that no regex is repeated.
    """
    own = df.columns
    df = df.selectExpr("*", f"CASE WHEN length({line}) >= 2 THEN regexp_extract({line}, {regex(PREFIX)}, 0) END AS __cut")
    df = df.selectExpr("*", f"{blank_to_null('__cut')} AS __core")
    numbered = (
        "CASE WHEN __core IS NULL THEN NULL WHEN startswith(__core, '第') THEN 'article_cn' "
        f"WHEN startswith(__core, '（') THEN CASE WHEN __core RLIKE {regex(r'^（\p{Nd}')} THEN 'paren_num' ELSE 'paren_cn' END "
        "WHEN left(__core, 1) IN ('A', 'a') THEN 'article_en' "
        "WHEN right(__core, 1) IN ('、', '，', '.') THEN "
        "CASE WHEN __core RLIKE '^[一二三四五六七八九十]' THEN 'section_cn' ELSE 'num_dot' END "
        "ELSE 'dotted_multi' END"
    )
    section = f"CASE WHEN length({line}) >= 2 AND __core IS NULL THEN nullif(regexp_extract({line}, '^(?:{_SECTIONS})', 0), '') END"
    df = df.selectExpr("*", f"{numbered} AS __num", f"{section} AS __sec")
    marker = (
        f"CASE __num WHEN 'article_cn' THEN regexp_replace(__core, {regex(WS)}, '') "
        f"WHEN 'article_en' THEN concat('Article ', regexp_extract(__core, {regex(r'\p{Nd}+')}, 0)) "
        "ELSE coalesce(__core, __sec) END"
    )
    rest = f"substring_index(substring({line}, length(__cut) + 1), '\\n', 1)"
    pattern = "coalesce(__num, CASE WHEN __sec IS NOT NULL THEN 'section_title' END)"
    levels = " ".join(f"WHEN '{name}' THEN {level}" for name, level in LEVELS.items())
    return df.selectExpr(
        *own,
        f"{pattern} AS m_pattern",
        f"{marker} AS m_marker",
        f"CASE WHEN __num IS NOT NULL THEN {blank_to_null(rest)} END AS m_title",
        f"CASE {pattern} {levels} END AS m_level",
    )


def clause_type(title: str) -> str:
    arms = " ".join(f"WHEN contains({title}, '{word}') THEN '{kind}'" for word, kind in TYPE_KEYWORDS)
    return f"CASE {arms} END"


def clause_markers(blocks: DataFrame) -> DataFrame:
    """Blocks that start a clause, with the marker parts as columns."""
    lines = blocks.selectExpr(K, "page_no", "sort_order", f"{strip('text')} AS __line").filter(opens_clause("__line"))
    marked = with_marker(lines, "__line").selectExpr("*", "concat_ws(' ', m_marker, m_title) AS __title")
    return marked.selectExpr(
        K, "page_no", "sort_order", "m_pattern AS pattern", "m_marker AS marker", "m_title AS trailing",
        "m_level AS level", f"{clause_type('__title')} AS clause_type",
    )


def _starts(prev: str, kind: str, y1: str, page: str) -> str:
    """1 when a row starts a clause, given the row before it, else 0.

    Nothing splits right after a title: titles gather until their marker or
    text comes. Otherwise a marker, a title or a wide vertical gap splits.
    """
    gap = f"coalesce({prev}.page_no = {page} AND {y1} - {prev}.y2 > {VERTICAL_GAP}, false)"
    return f"CAST({prev}.kind <> 'T' AND ({kind} <> 'X' OR {gap}) AS INT)"


def _last_head(head: str, order: str) -> str:
    return f"max_by({head}, struct({order})) FILTER (WHERE {head} IS NOT NULL) AS head"


def _carry(units: DataFrame, order: str, levels: list[str]) -> DataFrame:
    """Give each unit of consecutive rows what precedes it in its contract.

    A unit is (first row, last row, starts after its first row, last head).
    Adds ``opens`` (its first row starts a clause), ``base`` (starts before
    the unit) and ``carried`` (last head before it). With ``levels`` the units
    are first folded per level bucket, and only the folded ones go further up.
    """
    own = units.columns
    part = [K, *levels[:1]]
    w = f"PARTITION BY {', '.join(part)} ORDER BY {order}"
    before = f"({w} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    alone = 0 if levels else 1
    starts = _starts("__prev", "first.kind", "first.y1", "first.page_no")
    units = (
        units.selectExpr("*", f"lag(last) OVER ({w}) AS __prev")
        .selectExpr("*", f"CASE WHEN __prev IS NULL THEN {alone} ELSE {starts} END AS __opens")
        .selectExpr("*", "__opens + inner_starts AS __n")
        .selectExpr(
            "*",
            f"coalesce(sum(__n) OVER {before}, 0) AS __base",
            f"last(head, true) OVER {before} AS __carried",
        )
    )
    if not levels:
        return units.selectExpr(*own, "__opens AS opens", "__base AS base", "__carried AS carried")
    folded = units.groupBy(*part).agg(
        F.expr(f"min_by(first, struct({order})) AS first"),
        F.expr(f"max_by(last, struct({order})) AS last"),
        F.expr("sum(__n) AS inner_starts"),
        F.expr(_last_head("head", order)),
    )
    above = _carry(folded, levels[0], levels[1:]).selectExpr(*part, "opens AS __o", "base AS __b", "carried AS __c")
    return units.join(above, part).selectExpr(
        *own,
        "CASE WHEN __prev IS NULL THEN __o ELSE __opens END AS opens",
        "__b + CASE WHEN __prev IS NULL THEN 0 ELSE __o END + __base AS base",
        "coalesce(__carried, __c) AS carried",
    )


def number_clauses(blocks: DataFrame) -> DataFrame:
    """Non-blank blocks with ``clause_no`` and the head in force at each row.

    Three levels keep a very large contract in many tasks: runs of blocks on a
    page, page ranges, then the contract's page ranges.
    """
    # the keys are not null in either use of the rows, so that both scans filter alike
    present = f"{K} IS NOT NULL AND page_no IS NOT NULL AND sort_order IS NOT NULL"
    rows = blocks.filter(f"{present} AND {has_content('text')}").selectExpr("*", f"{strip('text')} AS __txt")
    rows = with_marker(rows, "__txt")
    head = "struct(CASE WHEN m_pattern IS NOT NULL THEN concat_ws(' ', m_marker, m_title) ELSE __txt END AS title, coalesce(m_level, 0) AS level)"
    rows = rows.selectExpr(
        *blocks.columns,
        "__txt",
        "CASE WHEN m_pattern IS NOT NULL THEN 'M' WHEN block_type = 'title' THEN 'T' ELSE 'X' END AS __kind",
        f"CASE WHEN m_pattern IS NOT NULL OR block_type = 'title' THEN {head} END AS __head",
        f"shiftright(sort_order, {BLOCK_BITS}) AS __run",
        f"{tie(blocks)} AS __id",
    )
    run = [K, "page_no", "__run"]
    w = f"PARTITION BY {', '.join(run)} ORDER BY sort_order, __id"
    here = "struct(__kind AS kind, bbox.y1 AS y1, bbox.y2 AS y2, page_no)"
    starts = _starts("__prev", "__kind", "bbox.y1", "page_no")
    rows = rows.selectExpr("*", f"lag({here}) OVER ({w}) AS __prev").selectExpr(
        "*", f"CASE WHEN __prev IS NULL THEN 0 ELSE {starts} END AS __new"
    )
    units = rows.groupBy(*run).agg(
        F.expr(f"min_by({here}, struct(sort_order, __id)) AS first"),
        F.expr(f"max_by({here}, struct(sort_order, __id)) AS last"),
        F.expr("sum(__new) AS inner_starts"),
        F.expr(_last_head("__head", "sort_order, __id")),
    ).selectExpr("*", f"shiftright(page_no, {PAGE_BITS}) AS __span")
    resolved = _carry(units, "page_no, __run", ["__span"]).selectExpr(*run, "opens", "base", "carried")
    rows = rows.selectExpr(
        "*",
        f"sum(__new) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS __seen",
        f"last(__head, true) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS __last_head",
    )
    return rows.join(resolved, run).selectExpr(
        *blocks.columns, "__txt", "__id",
        "CAST(base + opens + __seen AS INT) AS clause_no",
        "coalesce(__last_head, carried) AS head",
    )


def split_clauses(blocks: DataFrame) -> DataFrame:
    """Layout-aware clause segmentation of all contracts at once.

    The clause takes the head in force at its last row: a clause opened by a
    gap keeps the running title, type and level.
    """
    rows = number_clauses(blocks)
    at = "struct(page_no, sort_order, __id)"
    parts = "array_sort(collect_list(struct(page_no, sort_order, __id, __txt)))"
    grouped = rows.groupBy(K, "clause_no").agg(
        F.expr(f"max_by(head, {at}) AS head"),
        F.expr(f"array_join(transform({parts}, p -> p.__txt), '\\n') AS content"),
        F.expr("min(page_no) AS page_no"),
        F.expr("max(page_no) AS last_page"),
        F.expr(f"min_by(bbox, {at}) AS bbox"),
        F.expr("round(avg(coalesce(confidence, 0D)), 4) AS confidence"),
    )
    return grouped.selectExpr(
        K, "clause_no AS sort_order", f"{clause_type('head.title')} AS clause_type", "head.title AS clause_title",
        "content", "page_no", "CASE WHEN last_page <> page_no THEN last_page END AS page_end", "bbox",
        "confidence", "coalesce(head.level, 0) AS level", "'pending' AS review_status",
    )


def split_clauses_text(docs: DataFrame) -> DataFrame:
    """Segmentation of plain text (``contract_id``, ``text``) by markers only.

    A document is one cell, so it is cut in place: a line opens a piece when it
    carries a marker, and pieces are array slices. No shuffle.
    """
    lines = docs.selectExpr(K, f"transform(split(text, '\\n'), s -> {strip('s')}) AS lines")
    opener = f"filter(transform(lines, (s, i) -> CASE WHEN i = 0 OR {opens_clause('s')} THEN i END), i -> i IS NOT NULL)"
    content = strip("array_join(slice(lines, a + 1, coalesce(get(at, j + 1), size(lines)) - a), '\\n')")
    pieces = (
        lines.selectExpr(K, "lines", f"{opener} AS at")
        .selectExpr(K, f"transform(at, (a, j) -> struct(get(lines, a) AS first, {content} AS content)) AS pieces")
        .selectExpr(K, "posexplode(filter(pieces, p -> length(p.content) > 0)) AS (i, p)")
        .selectExpr(K, "i", "p.first", "p.content")
    )
    out = with_marker(pieces, "first").selectExpr(
        "*", "CASE WHEN m_pattern IS NOT NULL THEN concat_ws(' ', m_marker, m_title) END AS t"
    )
    return out.selectExpr(
        K, "CAST(i + 1 AS INT) AS sort_order", f"{clause_type('t')} AS clause_type", "t AS clause_title",
        "content", "coalesce(m_level, 0) AS level",
    )


def list_clauses(clauses: DataFrame, contract_id) -> DataFrame:
    return clauses.filter(F.col(K) == F.lit(contract_id)).orderBy("sort_order")
