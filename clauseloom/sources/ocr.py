"""OCR responses (raw JSON text) to blocks and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauseloom.functions.boxes import box_from_array, make_box
from clauseloom.functions.text import blank_to_null, has_content, strip
from clauseloom.operators.ordered import reading_order

K = "contract_id"

# Layout labels that are not plain text, and labels without text.
LABELS = {"title": "title", "doc_title": "title", "paragraph_title": "title", "table": "table"}
SKIPPED = ("figure", "seal", "header_image", "footer_image")

_ITEM = "STRUCT<block_label: STRING, block_content: STRING, block_bbox: ARRAY<DOUBLE>>"
_PAGE = f"STRUCT<prunedResult: STRUCT<width: INT, height: INT, parsing_res_list: ARRAY<{_ITEM}>>>"
LAYOUT = f"STRUCT<result: STRUCT<layoutParsingResults: ARRAY<{_PAGE}>>, layoutParsingResults: ARRAY<{_PAGE}>>"


def _layout_pages(responses: DataFrame) -> DataFrame:
    return responses.selectExpr("*", f"from_json(body, '{LAYOUT}') AS r").selectExpr(
        *responses.columns,
        "CASE WHEN r.result IS NOT NULL THEN r.result.layoutParsingResults ELSE r.layoutParsingResults END AS pages",
    )


def blocks_from_layout(responses: DataFrame) -> DataFrame:
    """Blocks of layout responses, one response per document.

    ``sort_order`` is the position in the response, so dropped items (pictures,
    seals, blank text) leave gaps. These blocks carry no confidence.
    """
    pages = _layout_pages(responses).selectExpr(K, "posexplode(pages) AS (p, page)")
    items = pages.selectExpr(
        K, "CAST(p + 1 AS INT) AS page_no", "page.prunedResult.width AS page_width", "page.prunedResult.height AS page_height",
        "posexplode(page.prunedResult.parsing_res_list) AS (i, b)",
    )
    skipped = ", ".join(f"'{s}'" for s in SKIPPED)
    kind = "CASE " + " ".join(f"WHEN b.block_label = '{k}' THEN '{v}'" for k, v in LABELS.items()) + " ELSE 'text' END"
    return items.filter(
        f"coalesce(b.block_label, 'text') NOT IN ({skipped}) AND coalesce({has_content('b.block_content')}, false)"
    ).selectExpr(
        K, "page_no", "CAST(i + 1 AS INT) AS sort_order", f"{kind} AS block_type", f"{strip('b.block_content')} AS text",
        f"{box_from_array('b.block_bbox')} AS bbox", "0D AS confidence", "page_width", "page_height",
    )


def layout_errors(responses: DataFrame) -> DataFrame:
    """Responses without a page array."""
    return _layout_pages(responses).filter("coalesce(size(pages), 0) <= 0").selectExpr(
        K, "'no parseable results' AS error"
    )


def _get(v: str, path: str, kind: str = "VARIANT") -> str:
    return f"try_variant_get({v}, '$.{path}', '{kind}')"


def _given(v: str) -> str:
    """The variant unless it is a JSON null."""
    return f"CASE WHEN schema_of_variant({v}) <> 'VOID' THEN {v} END"


def _is(v: str, kind: str) -> str:
    return f"coalesce(schema_of_variant({v}) LIKE '{kind}%', false)"


def _truthy(v: str, keys: tuple[str, ...]) -> str:
    """First member that is neither null, '', 0, false nor an empty list; the texts '0' and 'false' count."""
    arms = " ".join(f"WHEN {_filled(_get(v, k))} THEN {_get(v, k)}" for k in keys)
    return f"CASE {arms} END"


def _filled(v: str) -> str:
    text = f"CAST({v} AS STRING)"
    return (
        f"CASE WHEN coalesce(schema_of_variant({v}), 'VOID') = 'VOID' THEN false WHEN schema_of_variant({v}) = 'STRING' THEN {text} <> '' "
        f"WHEN schema_of_variant({v}) = 'BOOLEAN' THEN {text} = 'true' "
        f"WHEN {_is(v, 'ARRAY')} OR {_is(v, 'OBJECT')} THEN {text} NOT IN ('[]', '{{}}') ELSE try_variant_get({v}, '$', 'DOUBLE') <> 0 END"
    )


def _box(raw: str) -> str:
    """Box from an object, four numbers, or a polygon."""
    corner = [_get(raw, c, "DOUBLE") for c in ("x1", "y1", "x2", "y2")]
    known = " AND ".join(f"{c} IS NOT NULL" for c in corner)
    flat = [f"try_variant_get({raw}, '$[{i}]', 'DOUBLE')" for i in range(4)]
    four = " AND ".join(f"{f} IS NOT NULL" for f in flat)
    poly = f"try_variant_get({raw}, '$', 'ARRAY<ARRAY<DOUBLE>>')"
    axis = lambda fn, i: f"{fn}(transform({poly}, p -> get(p, {i})))"
    return (
        f"CASE WHEN {_is(raw, 'OBJECT')} THEN CASE WHEN {known} THEN {make_box(*corner)} END "
        f"WHEN {_is(f'''try_variant_get({raw}, '$[0]', 'VARIANT')''', 'ARRAY')} THEN "
        f"CASE WHEN size({poly}) > 0 AND forall({poly}, p -> size(p) >= 2) THEN "
        f"{make_box(axis('array_min', 0), axis('array_min', 1), axis('array_max', 0), axis('array_max', 1))} END "
        f"WHEN {four} THEN {make_box(*flat)} END"
    )


def _parsed(responses: DataFrame) -> DataFrame:
    """Responses as variants; ``error_code`` is any code but null and 0, as text, and NULL where there is none."""
    code = _get("v", "errorCode")
    none = f"coalesce(schema_of_variant({code}), 'VOID') = 'VOID' OR coalesce(try_variant_get({code}, '$', 'DOUBLE') = 0 AND schema_of_variant({code}) <> 'STRING', false)"
    return responses.selectExpr(K, "try_parse_json(body) AS v").selectExpr(
        K, "v", f"CASE WHEN NOT ({none}) THEN CAST({code} AS STRING) END AS error_code"
    )


def text_ocr_errors(responses: DataFrame, blocks: DataFrame | None = None) -> DataFrame:
    """Responses that report an error code or are no JSON and, given their ``blocks``, those without any text."""
    message = f"coalesce({_get('v', 'errorMsg', 'STRING')}, 'unknown error')"
    failed = _parsed(responses).filter("error_code IS NOT NULL OR v IS NULL").selectExpr(
        K, f"concat('OCR error ', coalesce(error_code, '0'), ': ', {message}) AS error"
    )
    if blocks is None:
        return failed
    fine = _parsed(responses).filter("error_code IS NULL AND v IS NOT NULL").select(K).distinct()
    empty = fine.join(blocks.select(K).distinct(), K, "left_anti").selectExpr(K, "'no text blocks' AS error")
    return failed.unionByName(empty)


def _page_payloads(responses: DataFrame) -> DataFrame:
    """One variant per page: the items of ``result.ocrResults``, else the whole response."""
    ok = _parsed(responses).filter("error_code IS NULL AND v IS NOT NULL")
    listed = _get("v", "result.ocrResults", "ARRAY<VARIANT>")
    return ok.selectExpr(
        K, "v AS response", f"{listed} IS NOT NULL AS paged",
        f"posexplode(coalesce({listed}, array(v))) AS (idx, item)",
    ).selectExpr(
        K, "response", "paged", "idx",
        f"CASE WHEN paged THEN coalesce({_get('item', 'prunedResult')}, item) ELSE item END AS payload",
    )


def blocks_from_text_ocr(responses: DataFrame) -> DataFrame:
    """Blocks of plain text-OCR responses in all their shapes, in reading order.

    Known shapes: wrapped in result / results / data / ocr_results, parallel
    lists (texts, boxes, scores), objects per line, ``[box, [text, score]]``
    and ``[text, score]`` rows.
    """
    wrapped = ", ".join(_given(_get("payload", k)) for k in ("result", "results", "data", "ocr_results", "ocrResults"))
    inner = _page_payloads(responses).selectExpr(K, "idx", f"coalesce({wrapped}, payload) AS u")
    nested = _get("u", "ocrResults", "ARRAY<VARIANT>")
    parts = inner.selectExpr(
        K, "idx", f"posexplode(coalesce(transform({nested}, x -> coalesce({_get('x', 'prunedResult')}, x)), array(u))) AS (j, s)"
    )
    for _ in range(2):
        parts = parts.selectExpr(K, "idx", "j", f"coalesce({_given(_get('s', 'prunedResult'))}, s) AS s")

    texts = f"coalesce({_get('s', 'rec_texts', 'ARRAY<VARIANT>')}, {_get('s', 'texts', 'ARRAY<VARIANT>')})"
    first_list = lambda keys: (
        "coalesce(" + ", ".join(f"CASE WHEN size({_get('s', k, 'ARRAY<VARIANT>')}) > 0 THEN {_get('s', k, 'ARRAY<VARIANT>')} END" for k in keys)
        + ", CAST(array() AS ARRAY<VARIANT>))"
    )
    boxes = first_list(("rec_polys", "dt_polys", "rec_boxes", "boxes"))
    scores = first_list(("rec_scores", "scores"))
    parts = parts.selectExpr(
        K, "idx", "j", "s", f"{texts} AS texts", f"{boxes} AS boxes", f"{scores} AS scores",
        "try_variant_get(s, '$', 'ARRAY<VARIANT>') AS listed",
    )
    pair = "size(try_variant_get(listed[0], '$', 'ARRAY<VARIANT>')) >= 2 AND schema_of_variant(try_variant_get(listed[0], '$[1][0]', 'VARIANT')) = 'STRING'"
    unwrap = (
        "CASE WHEN size(listed) = 1 AND schema_of_variant(get(listed, 0)) LIKE 'ARRAY%' "
        f"AND NOT coalesce({pair.replace('listed[0]', 'get(listed, 0)')}, false) "
        "THEN try_variant_get(get(listed, 0), '$', 'ARRAY<VARIANT>') ELSE listed END"
    )
    parts = parts.selectExpr(K, "idx", "j", "s", "texts", "boxes", "scores", f"{unwrap} AS listed")
    null_v = "CAST(NULL AS VARIANT)"
    zipped = "transform(texts, (t, i) -> struct(t AS text, get(boxes, i) AS box, get(scores, i) AS score))"
    as_object = (
        f"struct({_truthy('x', ('text', 'transcription', 'rec_text', 'value'))} AS text, "
        f"{_truthy('x', ('bbox', 'box', 'points', 'polygon'))} AS box, "
        f"coalesce({_get('x', 'confidence')}, {_get('x', 'score')}, {_get('x', 'rec_score')}) AS score)"
    )
    at = lambda path: f"try_variant_get(x, '$[{path}]', 'VARIANT')"
    row = (
        f"CASE WHEN {_is('x', 'OBJECT')} THEN {as_object} "
        f"WHEN {_is(at('1'), 'ARRAY')} THEN struct({at('1][0')} AS text, {at('0')} AS box, {at('1][1')} AS score) "
        f"WHEN schema_of_variant({at('0')}) = 'STRING' THEN struct({at('0')} AS text, {null_v} AS box, {at('1')} AS score) END"
    )
    rows = (
        f"CASE WHEN texts IS NOT NULL THEN {zipped} WHEN listed IS NOT NULL THEN transform(listed, x -> {row}) "
        f"WHEN {_is('s', 'OBJECT')} THEN transform(array(s), x -> {row}) END"
    )
    cells = parts.selectExpr(K, "idx", "j", f"posexplode({rows}) AS (i, r)").selectExpr(
        K, "CAST(idx + 1 AS INT) AS page_no", "j * 4294967296L + i AS sort_order",
        f"{blank_to_null('CAST(r.text AS STRING)')} AS text", "r.box AS box",
        "coalesce(try_variant_get(r.score, '$', 'DOUBLE'), 0.8D) AS confidence",
    )
    blocks = cells.filter("text IS NOT NULL").selectExpr(
        K, "page_no", "sort_order", "'text' AS block_type", "text", f"{_box('box')} AS bbox", "confidence"
    )
    return reading_order(blocks)


def pages_from_text_ocr(responses: DataFrame, templates: DataFrame) -> DataFrame:
    """Number and size of each response page.

    The number is the template's, else the position. The size comes from the
    response's page list, from its single size for the first page, else from
    the template. ``templates``: contract_id, idx (from 0), page_no, width, height.
    """
    pages = _page_payloads(responses).selectExpr(
        K, "idx", "paged", f"{_get('response', 'result.dataInfo.pages', 'ARRAY<STRUCT<width: INT, height: INT>>')} AS sizes",
        f"{_get('response', 'result.dataInfo.width', 'INT')} AS w", f"{_get('response', 'result.dataInfo.height', 'INT')} AS h",
    )
    t = templates.selectExpr(K, "idx", "page_no AS t_no", "width AS t_w", "height AS t_h")
    size = lambda name, single, fallback: (
        f"CASE WHEN paged AND idx < size(sizes) THEN get(sizes, idx).{name} "
        f"WHEN paged AND sizes IS NULL AND idx = 0 AND w IS NOT NULL AND h IS NOT NULL THEN {single} ELSE {fallback} END AS page_{name}"
    )
    return pages.join(t, [K, "idx"], "left").selectExpr(
        K, "CAST(idx + 1 AS INT) AS position", "CAST(coalesce(t_no, idx + 1) AS INT) AS page_no",
        size("width", "w", "t_w"), size("height", "h", "t_h"),
    )


def block_types_from_spans(spans: DataFrame) -> DataFrame:
    """Block text, largest font size and type from text spans; 14 points and more is a title.

    ``spans``: contract_id, page_no, block_no, line_no, span_no, text, size.
    """
    lines = spans.groupBy(K, "page_no", "block_no", "line_no").agg(
        F.expr("array_join(transform(array_sort(collect_list(struct(span_no, coalesce(text, '') AS t))), s -> s.t), '') AS line"),
        F.expr("max(coalesce(size, 0D)) AS size"),
    )
    out = lines.groupBy(K, "page_no", "block_no").agg(
        F.expr("array_join(transform(array_sort(collect_list(struct(line_no, line))), x -> x.line), '\\n') AS text"),
        F.expr("max(size) AS size"),
    )
    return out.selectExpr(
        K, "page_no", "block_no", f"{strip('text')} AS text", "CASE WHEN size > 0 THEN size END AS font_size",
        "CASE WHEN size >= 14 THEN 'title' ELSE 'text' END AS block_type",
    )


def route_documents(page_text: DataFrame, min_chars: int = 100, page_ratio: float = 0.8) -> DataFrame:
    """Which documents carry enough text of their own, and which need OCR."""
    pages = page_text.selectExpr(K, f"length(coalesce({strip('text')}, '')) AS n")
    out = pages.groupBy(K).agg(
        F.expr("sum(n) AS text_length"), F.expr("count_if(n > 0) AS text_pages"), F.expr("count(*) AS pages")
    )
    return out.selectExpr(
        "*", f"CASE WHEN text_length >= {min_chars} AND text_pages / pages >= {page_ratio} THEN 'text' ELSE 'ocr' END AS route"
    )
