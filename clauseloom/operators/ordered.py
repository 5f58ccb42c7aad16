"""Ordered numbering that does not need a whole key in one task.

A plain window over ``contract_id`` puts every row of a contract into one
task. Here a contract is cut into buckets that follow the order (page ranges,
runs of block positions). Rows are numbered inside their bucket, and only one
summary row per bucket travels to the next level, so a very large contract is
spread over as many tasks as it has buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAGE_BITS = 9  # a bucket of pages: 512
BLOCK_BITS = 10  # a bucket of block positions: 1024


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` that matches NULL to NULL and keeps one key copy."""
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    cond = F.expr(" AND ".join(f"{k} <=> __r_{k}" for k in keys))
    return left.join(renamed, cond, how).drop(*[f"__r_{k}" for k in keys])


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    bucket: str,
    order: str,
    name: str,
    total: str | None = None,
) -> DataFrame:
    """``row_number`` over ``keys`` ordered by (bucket, order).

    ``bucket`` must rise with the order, so that a bucket is a contiguous run.
    NULL keys are one key, a NULL bucket comes before all others.
    ``total`` optionally adds the row count of the key.
    """
    rows = df.selectExpr("*", f"{bucket} AS __b")
    per_key = f"PARTITION BY {', '.join(keys) or '0'}"
    part = [*keys, "__b"]
    sizes = rows.groupBy(*part).agg(F.expr("count(*) AS __size")).selectExpr(
        *part,
        f"coalesce(sum(__size) OVER ({per_key} ORDER BY __b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS __skip",
        f"sum(__size) OVER ({per_key}) AS __total",
    )
    local = rows.selectExpr("*", f"row_number() OVER (PARTITION BY {', '.join(part)} ORDER BY {order}) AS __local")
    out = null_safe_join(local, sizes, part)
    extra = [f"__total AS {total}"] if total else []
    return out.selectExpr(*df.columns, f"__local + __skip AS {name}", *extra)


def reading_order(blocks: DataFrame) -> DataFrame:
    """Renumber ``sort_order`` per page by (y1, x1); a missing box counts as 0.

    Ties keep the incoming order.
    """
    numbered = number_rows(
        blocks,
        ["contract_id", "page_no"],
        "floor(coalesce(bbox.y1, 0D) / 256)",
        "coalesce(bbox.y1, 0D), coalesce(bbox.x1, 0D), sort_order",
        "__rank",
    )
    return numbered.selectExpr(
        *[c if c != "sort_order" else "CAST(__rank AS INT) AS sort_order" for c in blocks.columns]
    )
