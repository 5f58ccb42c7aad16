"""Text and layout operators over the ``blocks`` table."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauseloom.functions.text import has_content, quote, regex, snippet, strip
from clauseloom.operators.ordered import PAGE_BITS, number_rows

K = "contract_id"

# Keywords that name the contract parties, in lookup order.
PARTY_KEYWORDS = ("甲方名称", "乙方名称", "甲方", "乙方")

# Keyword rules of the contract-type guess, first match wins.
TYPE_KEYWORDS = [
    (("开发", "技术"), "service", 0.85),
    (("采购", "购买"), "purchase", 0.80),
    (("租赁",), "lease", 0.80),
]
TYPE_DEFAULT = ("sale", 0.7)

def tie(df: DataFrame) -> str:
    """Third ordering key of blocks: the row id where there is one."""
    return "id" if "id" in df.columns else "0"


def _ordered_join(items: str, text: str, sep: str) -> str:
    """Aggregate: texts in the order of their structs, joined."""
    sep = sep.replace("\n", "\\n")
    return f"array_join(transform(array_sort(collect_list({items})), x -> x.{text}), '{sep}')"


def page_text(blocks: DataFrame, sep: str = "\n") -> DataFrame:
    """One row per page: block texts in order joined by ``sep``."""
    item = f"struct(sort_order, {tie(blocks)} AS id, coalesce(text, '') AS text)"
    return blocks.groupBy(K, "page_no").agg(F.expr(f"{_ordered_join(item, 'text', sep)} AS text"))


def document_text(blocks: DataFrame) -> DataFrame:
    """Whole text per contract, one line break between blocks and pages."""
    pages = page_text(blocks)
    return pages.groupBy(K).agg(F.expr(f"{_ordered_join('struct(page_no, text)', 'text', chr(10))} AS text"))


def page_markdown(blocks: DataFrame) -> DataFrame:
    """Page text behind its page marker; titles stay plain, tables verbatim."""
    marked = r"concat('<!-- page: ', page_no, ' -->\n\n', text) AS text"
    return page_text(blocks, "\n\n").selectExpr(K, "page_no", marked)


def document_markdown(blocks: DataFrame) -> DataFrame:
    pages = page_markdown(blocks)
    body = _ordered_join("struct(page_no, text)", "text", "\n\n")
    return pages.groupBy(K).agg(F.expr(f"{body} AS markdown"))


def load_pages(blocks: DataFrame) -> DataFrame:
    """Pages rebuilt from stored blocks; page size is that of the last block."""
    at = f"struct(sort_order, {tie(blocks)} AS id)"
    item = (
        f"struct(sort_order, {tie(blocks)} AS id, block_type, text, bbox, "
        "coalesce(confidence, 0D) AS confidence, paragraph_id, font_size)"
    )
    size = [F.expr(f"max_by(struct({c}), {at}).{c} AS {c}") for c in ("page_width", "page_height")]
    return blocks.groupBy(K, "page_no").agg(*size, F.expr(f"array_sort(collect_list({item})) AS blocks"))


def extract_title(blocks: DataFrame) -> DataFrame:
    """First line longer than three characters, cut to 200.

    Each block offers its own first such line, so only the smallest position
    per contract crosses the shuffle.
    """
    lines = f"transform(split(text, '\\n'), s -> {strip('s')})"
    rows = blocks.selectExpr(
        K, f"struct(page_no, sort_order, {tie(blocks)} AS id) AS at",
        f"left(get(filter({lines}, s -> length(s) > 3), 0), 200) AS line",
    )
    return rows.groupBy(K).agg(F.expr("min_by(line, at) FILTER (WHERE line IS NOT NULL) AS title"))


def page_count(blocks: DataFrame) -> DataFrame:
    pages = blocks.select(K, "page_no").distinct()
    return pages.groupBy(K).agg(F.expr("CAST(count(*) AS INT) AS page_count"))


def keyword_contexts(docs: DataFrame, keywords: Sequence[str] = PARTY_KEYWORDS) -> DataFrame:
    """Text around the first hit of each keyword: 80 characters before, 120 after."""
    words = "array(" + ", ".join(quote(w) for w in keywords) + ")"
    hits = docs.selectExpr(K, "text", f"explode({words}) AS keyword").selectExpr(
        K, "keyword", "text", "locate(keyword, text) AS at"
    )
    start = "greatest(1, at - 80)"
    cut = f"substring(text, {start}, at + length(keyword) + 120 - {start})"
    return hits.filter("at > 0").selectExpr(K, "keyword", f"{cut} AS cut").selectExpr(
        K, "keyword", f"{snippet('cut')} AS context"
    )


def ocr_diagnostics(blocks: DataFrame, keywords: Sequence[str] = PARTY_KEYWORDS) -> DataFrame:
    """Page, block and character counts plus the party keywords that occur.

    All parts are mergeable aggregates; no document text is gathered.
    """
    found = [
        F.expr(f"coalesce(max(contains(text, {quote(w)})), false) AS __k{i}") for i, w in enumerate(keywords)
    ]
    per_page = blocks.groupBy(K, "page_no").agg(
        F.expr("count(*) AS n"), F.expr("sum(length(coalesce(text, ''))) AS chars"), *found
    )
    hits = ", ".join(f"CASE WHEN max(__k{i}) THEN {quote(w)} END" for i, w in enumerate(keywords))
    hits = f"array_join(array_sort(array_compact(array({hits}))), ',')"
    return per_page.groupBy(K).agg(
        F.expr("count(*) AS page_count"),
        F.expr("sum(n) AS block_count"),
        F.expr("sum(chars) + sum(n) - 1 AS text_length"),
        F.expr(f"{hits} AS keyword_hits"),
    ).selectExpr("*", "keyword_hits = '' AS no_keyword")


def _step(pages_per_chunk: int, overlap: int) -> int:
    if pages_per_chunk < 1:
        raise ValueError("pages_per_chunk must be >= 1")
    return max(1, pages_per_chunk - overlap)


def page_chunks(pages: DataFrame, pages_per_chunk: int = 6, overlap: int = 1) -> DataFrame:
    """Overlapping page windows from page markdown rows.

    A page knows from its index which windows it belongs to, so it is copied
    to those only and each window gathers at most ``pages_per_chunk`` pages.
    """
    p, step = pages_per_chunk, _step(pages_per_chunk, overlap)
    index = number_rows(pages.select(K, "page_no"), [K], f"shiftright(page_no, {PAGE_BITS})", "page_no", "n", "pages")
    last = f"CASE WHEN pages <= {p} THEN 0 ELSE ceil((pages - {p}) / {step}) END"
    placed = index.selectExpr(K, "page_no", "n - 1 AS i", f"{last} AS last").selectExpr(
        K, "page_no", "last",
        f"explode(sequence(greatest(0, ceil((i - {p} + 1) / {step})), least(last, floor(i / {step})))) AS chunk_no",
    )
    body = _ordered_join("struct(page_no, text)", "text", "\n\n")
    out = placed.join(pages, [K, "page_no"]).groupBy(K, "chunk_no", "last").agg(
        F.expr("min(page_no) AS first_page"), F.expr("max(page_no) AS last_page"), F.expr(f"{body} AS text")
    )
    tail = r"CASE WHEN chunk_no < last THEN '\n\n' ELSE '' END"
    return out.selectExpr(
        K, "CAST(chunk_no AS INT) AS chunk_no", "first_page", "last_page", f"concat(text, {tail}) AS text"
    )


def chunk_markdown(markdown: str, pages_per_chunk: int = 6, overlap: int = 1) -> str:
    """The same windows as an array, cut from one markdown text at its page markers.

    Text before the first marker belongs to no window once there are several;
    blank text has none.
    """
    p, step = pages_per_chunk, _step(pages_per_chunk, overlap)
    pieces = f"split({markdown}, {regex(r'(?md)(?=^<!-- page: \d+ -->$)')})"
    pages = f"filter({pieces}, s -> s RLIKE {regex(r'(?md)\A<!-- page: \d+ -->$')})"
    last = f"CAST(ceil((size({pages}) - {p}) / {step}) AS INT)"
    return (
        f"CASE WHEN NOT {has_content(markdown)} THEN CAST(array() AS ARRAY<STRING>) "
        f"WHEN size({pages}) <= {p} THEN array({markdown}) "
        f"ELSE transform(sequence(0, {last}), k -> array_join(slice({pages}, k * {step} + 1, {p}), '')) END"
    )


def classifier_sample(text: str, size: int | None = None) -> str:
    """The text a type classifier is shown: all of it, or its first ``size`` characters where a model takes no more."""
    return text if size is None else f"left({text}, {size})"


def classify_contract_type(text: str) -> str:
    """Keyword guess as ``struct<contract_type, confidence>``; NULL text is unknown."""
    answer = lambda kind, conf: f"struct('{kind}' AS contract_type, {conf}D AS confidence)"
    arms = [f"WHEN {text} IS NULL THEN {answer('unknown', 0.0)}"]
    for words, kind, conf in TYPE_KEYWORDS:
        test = " OR ".join(f"contains({text}, '{w}')" for w in words)
        arms.append(f"WHEN {test} THEN {answer(kind, conf)}")
    return f"CASE {' '.join(arms)} ELSE {answer(*TYPE_DEFAULT)} END"


def classify_documents(blocks: DataFrame) -> DataFrame:
    """The keyword guess per contract straight from its blocks.

    A keyword never spans two blocks, so hits are mergeable flags and no
    document text is put together.
    """
    words = [w for group, _, _ in TYPE_KEYWORDS for w in group]
    hits = blocks.groupBy(K).agg(
        *[F.expr(f"coalesce(bool_or(contains(text, '{w}')), false) AS w{i}") for i, w in enumerate(words)]
    )
    arms = []
    for group, kind, conf in TYPE_KEYWORDS:
        test = " OR ".join(f"w{words.index(w)}" for w in group)
        arms.append(f"WHEN {test} THEN struct('{kind}' AS contract_type, {conf}D AS confidence)")
    kind, conf = TYPE_DEFAULT
    guess = f"CASE {' '.join(arms)} ELSE struct('{kind}' AS contract_type, {conf}D AS confidence) END"
    return hits.selectExpr(K, f"{guess} AS g").selectExpr(K, "g.contract_type", "g.confidence")


def definition_lines(field_sets: DataFrame) -> DataFrame:
    """One prompt block per contract: a line for each requested field in order."""
    line = (
        "concat('- field_key=', field_key, '；field_name=', field_name, '；value_type=', "
        "coalesce(nullif(value_type, ''), 'string'), "
        "coalesce(concat('；description=', nullif(description, '')), ''))"
    )
    body = _ordered_join(f"struct(sort_order, field_key, {line} AS line)", "line", "\n")
    return field_sets.groupBy(K).agg(F.expr(f"{body} AS field_lines"))


def build_prompts(chunks: DataFrame, field_sets: DataFrame, types: DataFrame, hints: DataFrame) -> DataFrame:
    """Extraction prompt per chunk: type hint, field table, chunk text.

    ``hints`` (contract_type, hint) is the caller's table of one sentence per type; a type without one gets none.
    """
    typed = types.select(K, "contract_type").join(hints.select("contract_type", "hint"), "contract_type", "left")
    out = chunks.join(definition_lines(field_sets), K).join(typed, K, "left")
    hint = "concat('合同类型参考：', hint)"
    prompt = rf"concat_ws('\n\n', {hint}, '需要抽取的字段：', field_lines, '下面是合同全文：', text)"
    return out.selectExpr(K, "chunk_no", f"{prompt} AS prompt")


def infer(prompts: DataFrame, model: Callable[[str], str], attempts: int = 3) -> DataFrame:
    """Run a user-supplied model over prompts in parallel tasks.

    A prompt whose calls all fail yields an error row instead of failing the job.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            answers, errors = [], []
            for prompt in batch["prompt"]:
                answer, error = None, None
                for _ in range(attempts):
                    try:
                        answer, error = model(prompt), None
                        break
                    except Exception as exc:  # reported as data
                        error = f"{type(exc).__name__}: {exc}"
                answers.append(answer)
                errors.append(error)
            yield batch[[K, "chunk_no"]].assign(
                raw=pd.Series(answers, index=batch.index, dtype=object),
                error=pd.Series(errors, index=batch.index, dtype=object),
            )

    key = prompts.schema[K].dataType.simpleString()
    return prompts.select(K, "chunk_no", "prompt").mapInPandas(
        run, f"{K} {key}, chunk_no int, raw string, error string"
    )


def inference_status(responses: DataFrame) -> DataFrame:
    """A contract fails only when every one of its chunks failed."""
    return responses.groupBy(K).agg(
        F.expr("count(*) AS chunks"),
        F.expr("count_if(error IS NOT NULL) AS failed_chunks"),
        F.expr("bool_or(error IS NULL) AS ok"),
    )
