"""Field-definition import and golden answers."""

from __future__ import annotations

import csv
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseloom.functions.text import blank_to_null, has_content, regex, strip
from clauseloom.operators.ordered import number_rows
from clauseloom.sources.delimited import records

# Accepted header names per column.
HEADERS = {
    "field_name": ("字段名称", "字段名", "field_name", "name"),
    "description": ("字段描述", "描述", "description", "desc"),
    "field_key": ("字段标识", "字段key", "field_key", "key"),
    "value_type": ("值类型", "value_type", "type"),
}
BOM = "﻿"


def pick_delimiter(line: str) -> str:
    """The separator that splits the line into most parts; a comma wins ties."""
    return max((",", "\t", ";"), key=line.count)


def read_field_definitions(spark: SparkSession, path: str) -> DataFrame:
    """Field definitions from a delimited text file, with or without a header.

    Only the first line is looked at on the driver, to settle separator and
    columns; the records are found and parsed by Spark, also where one large
    file is read in several parts. Empty lines are skipped.
    """
    first = spark.read.text(path).filter(has_content("value")).first()
    line = (first["value"] if first else "").removeprefix(BOM).rstrip("\r")
    sep = pick_delimiter(line)
    cells = next(csv.reader([line], delimiter=sep), [])
    names = [re.sub(r"\s+", "_", c.strip().lower()) for c in cells]
    at = {col: next((i for i, n in enumerate(names) if n in aliases), -1) for col, aliases in HEADERS.items()}
    has_header = any(at[c] >= 0 for c in ("field_name", "description", "field_key"))
    if not has_header:
        at.update(field_name=0, description=1 if len(names) > 1 else -1)
    elif at["field_name"] < 0:
        at["field_name"] = 0
    schema = ", ".join(f"c{i} STRING" for i in range(max(len(names), 1)))
    texts = records(spark, path).filter("text <> ''")
    if has_header:  # the first record of a file that is not empty
        heads = texts.groupBy("file").agg(F.expr("min(record) AS head"))
        texts = texts.join(heads, "file").filter("record > head")
    parsed = F.from_csv("text", schema, {"sep": sep, "quote": '"', "escape": '"'})
    rows = texts.select(parsed.alias("r")).select("r.*")
    cell = lambda c: strip(f"replace(c{at[c]}, '{BOM}', '')") if at[c] >= 0 else "CAST(NULL AS STRING)"
    out = rows.selectExpr(
        f"nullif({cell('field_key')}, '') AS field_key", f"coalesce({cell('field_name')}, '') AS field_name",
        f"coalesce({cell('description')}, '') AS description",
        f"coalesce(nullif({cell('value_type')}, ''), 'string') AS value_type",
    )
    return out.filter("field_name <> ''")


def assign_field_keys(rows: DataFrame, existing: DataFrame, offset: int = 0) -> DataFrame:
    """Keys and positions for imported definitions (``pos`` gives their order).

    A given free key is kept. Missing, taken or repeated keys become
    ``custom-<slug>-<n>``; numbers are skipped as long as they are taken, so
    the result is the same on every run.
    """
    slug = (
        f"coalesce(nullif(regexp_replace(regexp_replace(lower(field_name), {regex('[^a-z0-9一-龥]+')}, '-'), "
        "'^-+|-+$', ''), ''), 'field')"
    )
    taken = existing.select("field_key").distinct()
    marked = rows.selectExpr("*", f"{blank_to_null('field_key')} AS given", f"{slug} AS slug").join(
        taken.selectExpr("field_key AS given", "true AS is_taken"), "given", "left"
    )
    # the first row asking for a free key gets it
    firsts = marked.filter("given IS NOT NULL AND is_taken IS NULL").groupBy("given").agg(F.expr("min(pos) AS first_pos"))
    marked = marked.join(firsts, "given", "left").selectExpr("*", "coalesce(pos = first_pos, false) AS keeps")
    kept = marked.filter("keeps")
    used = taken.union(kept.select("given")).filter("field_key LIKE 'custom-%'").selectExpr(
        r"regexp_extract(field_key, '^custom-(.*)-([0-9]+)$', 1) AS slug",
        r"try_cast(regexp_extract(field_key, '^custom-(.*)-([0-9]+)$', 2) AS BIGINT) AS n",
    ).groupBy("slug").agg(F.expr("max(n) AS used_n"))
    fresh = number_rows(marked.filter("NOT keeps"), ["slug"], "floor(pos / 4096)", "pos", "n").join(used, "slug", "left")
    cols = ["field_name", "description", "value_type", "pos"]
    named = kept.selectExpr("given AS field_key", *cols).unionByName(
        fresh.selectExpr("concat('custom-', slug, '-', coalesce(used_n, 0) + n) AS field_key", *cols)
    )
    return named.selectExpr(
        "field_key", "field_name", "description", "value_type", "false AS required",
        f"CAST({offset} + pos AS INT) AS sort_order", "true AS is_active",
    )


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """Golden answers: one JSON object per file, named after its contract."""
    files = spark.read.text(path, wholetext=True).selectExpr("_metadata.file_name AS name", "value")
    return files.selectExpr(
        r"regexp_replace(name, '\\.[^.]*$', '') AS contract_id",
        "explode(from_json(value, 'MAP<STRING, STRING>')) AS (field_key, expected)",
    )
