"""Result exports: wide table, delimited text, JSON."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from clauseloom.functions.labels import status_label
from clauseloom.functions.text import quote
from clauseloom.operators.catalog import numbered

K = "contract_id"
BOM = "﻿"


def _last(fields: DataFrame) -> str:
    """Order of a contract's rows of one key: the last one counts, by position or id where there is one."""
    order = [c for c in ("created_at", "pos", "id") if c in fields.columns]
    return f"struct({', '.join(order)})" if order else "0"


def _pick(key: str, e: str, order: str) -> str:
    return f"coalesce(max_by({e}, {order}) FILTER (WHERE field_key = {quote(key)}), '')"


def _bucket(batch: DataFrame) -> str:
    """Ranges of the contract key: of 4096 numbers, or of the texts with the same first characters."""
    return f"left({K}, 6)" if isinstance(batch.schema[K].dataType, StringType) else f"floor({K} / 4096)"


def _wide(fields: DataFrame, batch: DataFrame, keys: Sequence[str], cell: str, bucket: str | None) -> DataFrame:
    """Batch rows numbered from 1 with one column c0.. per requested key."""
    wanted = ", ".join(quote(k) for k in keys)
    cells = fields.filter(f"field_key IN ({wanted})").groupBy(K).agg(
        *[F.expr(f"{_pick(key, cell, _last(fields))} AS c{i}") for i, key in enumerate(keys)]
    )
    rows = numbered(batch, bucket or _bucket(batch), [K], "idx")
    return rows.join(cells, K, "left").selectExpr(
        "idx", K, "coalesce(file_name, '') AS file_name", *[f"coalesce(c{i}, '') AS c{i}" for i in range(len(keys))],
        "status", "coalesce(error, '') AS error",
    )


def wide_results(fields: DataFrame, batch: DataFrame, keys: Sequence[str], bucket: str | None = None) -> DataFrame:
    """One row per contract and one column per key holding the extracted value.

    Reviewed values are not shown here. ``bucket`` cuts the numbering order
    into ranges, so that numbering needs no single-task sort.
    """
    wide = _wide(fields, batch, keys, "value", bucket)
    return wide.selectExpr(
        "idx AS `序号`", "file_name AS `文件名`", *[f"c{i} AS `{k}`" for i, k in enumerate(keys)],
        f"{status_label('status')} AS `处理状态`", "error AS `错误信息`",
    )


def csv_cell(e: str) -> str:
    """Quote only where a quote, comma or line break asks for it."""
    return rf"CASE WHEN {e} RLIKE '[\",\\n]' THEN concat('\"', replace({e}, '\"', '\"\"'), '\"') ELSE {e} END"


def csv_lines(
    fields: DataFrame, batch: DataFrame, keys: Sequence[str], names: Sequence[str], bucket: str | None = None
) -> DataFrame:
    """Text lines ``(idx, line)`` with reviewed values first; line 0 is the header with a byte-order mark."""
    wide = _wide(fields, batch, keys, "coalesce(nullif(reviewed_value, ''), value)", bucket)
    cells = ["CAST(idx AS STRING)", "file_name", *[f"c{i}" for i in range(len(keys))], status_label("status"), "error"]
    line = "concat_ws(',', " + ", ".join(csv_cell(c) for c in cells) + ")"
    body = wide.selectExpr("CAST(idx AS BIGINT) AS idx", f"{line} AS line")
    titles = ["序号", "文件名", *names, "处理状态", "错误信息"]
    head = BOM + ",".join('"' + t.replace('"', '""') + '"' if any(x in t for x in '",\n') else t for t in titles)
    header = fields.sparkSession.range(1).selectExpr("0L AS idx", f"{quote(head)} AS line")
    return header.unionByName(body)


def write_lines(lines: DataFrame, path: str) -> None:
    """Write lines in order. Parts are range-sorted, so joining them by name gives the file."""
    lines.orderBy("idx").select("line").write.mode("overwrite").text(path)


def json_rows(fields: DataFrame, batch: DataFrame, keys: Sequence[str], bucket: str | None = None) -> DataFrame:
    """One nested row per contract; a requested field that is absent maps to NULL."""
    wanted = ", ".join(quote(k) for k in keys)
    cell = "struct(coalesce(value, '') AS value, reviewed_value, confidence, page_no, review_status)"
    found = fields.filter(f"field_key IN ({wanted})").groupBy(K, "field_key").agg(
        F.expr(f"max_by({cell}, {_last(fields)}) AS cell")
    ).groupBy(K).agg(F.expr("map_from_entries(collect_list(struct(field_key, cell))) AS found"))
    rows = numbered(batch, bucket or _bucket(batch), [K], "idx").join(found, K, "left")
    entries = f"map_from_entries(transform(array_distinct(array({wanted})), k -> struct(k, element_at(found, k)))) AS fields"
    return rows.selectExpr(
        "idx AS index", "file_name AS fileName", "status", "nullif(error, '') AS error", entries
    )


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
