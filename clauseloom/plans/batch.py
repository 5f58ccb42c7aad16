"""The whole way from OCR and model responses to fields and findings, as one lazy plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from clauseloom.functions.boxes import box_from_array
from clauseloom.operators import extraction as E
from clauseloom.operators import layout as L
from clauseloom.operators import rules as V
from clauseloom.operators import trace as T
from clauseloom.operators.catalog import ready_for_extraction
from clauseloom.sources.ocr import blocks_from_layout, layout_errors

K = "contract_id"


@dataclass(frozen=True)
class Ingested:
    blocks: DataFrame
    summary: DataFrame  # title and page count per contract
    failed: DataFrame


@dataclass(frozen=True)
class Extracted:
    fields: DataFrame
    types: DataFrame
    violations: DataFrame
    failed: DataFrame
    matched: DataFrame  # the fields before tracing, which reads them several times: worth keeping where they are stored


def ingest(responses: DataFrame) -> Ingested:
    """Layout responses to blocks, with title and page count."""
    blocks = blocks_from_layout(responses)
    summary = L.page_count(blocks).join(L.extract_title(blocks), K)
    return Ingested(blocks, summary, layout_errors(responses))


def extract(
    contracts: DataFrame,
    blocks: DataFrame,
    responses: DataFrame,
    definitions: DataFrame,
    overrides: DataFrame | None = None,
    classified: DataFrame | None = None,
) -> Extracted:
    """Fields, contract types and findings of all contracts that are ready.

    The field set follows the classified type unless a contract brings its own
    (``overrides``). Model answers are merged over their chunks, matched to
    the field set, traced to the page, and validated. Clause titles take no
    part in this validation.
    """
    ready = ready_for_extraction(contracts, blocks)
    kinds = L.classify_documents(blocks) if classified is None else classified
    typed = ready.select(K).join(kinds, K, "left")
    requested = E.fields_for_type(typed, definitions)
    if overrides is not None:
        requested = E.effective_field_set(requested, overrides)

    raw = E.explode_fields(responses.join(ready.select(K), K, "left_semi")).selectExpr(
        K, "chunk_no", "pos", "field_key", "field_name", "value", "CAST(NULL AS STRING) AS value_type", "source_text",
        "source_page AS page_no", f"{box_from_array('source_bbox')} AS bbox", "confidence",
    )
    merged = E.merge_fields(raw)
    fields, failed = E.reconcile(merged, requested)
    traced = T.attach_boxes(fields, blocks)

    inline = E.merge_contract_type(E.response_types(responses))
    types = E.resolve_type(typed, inline)
    # rules read values and confidences only, so they need not wait for tracing
    done = fields.select(K).distinct()
    stored = traced.drop("missing").selectExpr(
        "*", "'extracted' AS review_status", "CAST(NULL AS STRING) AS reviewed_value"
    )
    return Extracted(stored, types, V.validate(fields, done), failed, fields)
