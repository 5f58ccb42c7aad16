"""All registered queries and their reference SQL."""

from __future__ import annotations

from clauseloom.plans import (
    catalog_queries,
    clause_queries,
    extraction_queries,
    layout_queries,
    review_queries,
    rule_queries,
    source_queries,
    stream_queries,
)

_MODULES = [
    rule_queries, clause_queries, layout_queries, extraction_queries, review_queries, catalog_queries, source_queries,
    stream_queries,
]


def queries() -> dict:
    return {name: query for module in _MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
