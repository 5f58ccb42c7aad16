"""Field accuracy against golden answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauseloom.functions.text import strip

K = "contract_id"


def field_verdicts(extracted: DataFrame, golden: DataFrame) -> DataFrame:
    """tp / fp / fn per golden field; fields without a golden value are not scored."""
    e = extracted.selectExpr(K, "field_key", f"coalesce({strip('value')}, '') AS extracted")
    g = golden.selectExpr(K, "field_key", f"coalesce({strip('expected')}, '') AS golden").filter("golden <> ''")
    verdict = (
        "CASE WHEN coalesce(extracted, '') = golden THEN 'tp' WHEN coalesce(extracted, '') <> '' THEN 'fp' ELSE 'fn' END"
    )
    return g.join(e, [K, "field_key"], "left").selectExpr(
        K, "field_key", "golden", "coalesce(extracted, '') AS extracted", f"{verdict} AS verdict"
    )


def accuracy(verdicts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts, precision, recall and F1, overall or per group; 0 where undefined."""
    counts = [F.expr(f"count_if(verdict = '{v}') AS {v}") for v in ("tp", "fp", "fn")]
    grouped = verdicts.groupBy(*(by or [])).agg(*counts)
    rated = grouped.selectExpr(
        "*", "coalesce(try_divide(tp, tp + fp), 0D) AS p", "coalesce(try_divide(tp, tp + fn), 0D) AS r"
    )
    return rated.selectExpr(
        *(by or []), "tp", "fp", "fn", "round(p, 4) AS precision", "round(r, 4) AS recall",
        "round(coalesce(try_divide(2 * p * r, p + r), 0D), 4) AS f1",
    )


def accuracy_report(verdicts: DataFrame) -> DataFrame:
    """Overall, per field and per contract counts from one pass (grouping sets)."""
    counts = [F.expr(f"count_if(verdict = '{v}') AS {v}") for v in ("tp", "fp", "fn")]
    sets = [[], [F.col("field_key")], [F.col(K)]]
    level = "CASE grouping_id() WHEN 3 THEN 'all' WHEN 2 THEN 'field' ELSE 'contract' END AS level"
    grouped = verdicts.groupingSets(sets, F.col(K), F.col("field_key")).agg(F.expr(level), *counts)
    return grouped.selectExpr(
        "level", K, "field_key", "tp", "fp", "fn", "round(coalesce(try_divide(2 * tp, 2 * tp + fp + fn), 0D), 4) AS f1"
    )


def quality_report(fields: DataFrame, golden: DataFrame) -> DataFrame:
    """Per field key: share without a value, and hits counting the reviewed value too."""
    g = golden.selectExpr(K, "field_key", f"coalesce({strip('expected')}, '') AS golden")
    joined = fields.join(g, [K, "field_key"], "left")
    hit = f"golden <> '' AND (coalesce({strip('value')}, '') = golden OR coalesce({strip('reviewed_value')}, '') = golden)"
    return joined.groupBy("field_key").agg(
        F.expr("count(*) AS fields"),
        F.expr("round(count_if(coalesce(value, '') = '') / count(*), 4) AS null_rate"),
        F.expr(f"count_if({hit}) AS hits"),
        F.expr("count_if(golden <> '') AS scored"),
    )


def quality_by_place(fields: DataFrame, golden: DataFrame, traced: DataFrame, blocks: DataFrame) -> DataFrame:
    """``quality_report`` by where a value stands: in a table, in other text, or nowhere that was found.

    ``traced``: contract_id, field_key, page_no, sort_order of the first block
    of each located source, as ``trace.locate_sources`` gives them.
    """
    where = ["page_no", "sort_order"]
    kinds = blocks.groupBy(K, *where).agg(F.expr("bool_or(block_type = 'table') AS is_table"))
    places = traced.select(K, "field_key", *where).join(kinds, [K, *where]).selectExpr(
        K, "field_key", "CASE WHEN is_table THEN 'table' ELSE 'text' END AS place"
    )
    placed = fields.drop("place").join(places, [K, "field_key"], "left").selectExpr(
        K, "field_key", "value", "reviewed_value", "coalesce(place, 'none') AS place"
    )
    g = golden.selectExpr(K, "field_key", f"coalesce({strip('expected')}, '') AS golden")
    hit = f"golden <> '' AND (coalesce({strip('value')}, '') = golden OR coalesce({strip('reviewed_value')}, '') = golden)"
    return placed.join(g, [K, "field_key"], "left").groupBy("place").agg(
        F.expr("count(*) AS fields"),
        F.expr("round(count_if(coalesce(value, '') = '') / count(*), 4) AS null_rate"),
        F.expr(f"count_if({hit}) AS hits"),
        F.expr("count_if(golden <> '') AS scored"),
    )
