"""Catalogue queries: lists, details, definition upkeep, task reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauseloom.functions.labels import batch_label, record_status
from clauseloom.operators.ordered import number_rows

K = "contract_id"
DEFINITION_COLUMNS = [
    "field_key", "field_name", "description", "value_type", "required", "sort_order", "is_active", "contract_type",
]


def latest_files(files: DataFrame) -> DataFrame:
    """Newest version per contract, as a mergeable aggregate."""
    others = [c for c in files.columns if c != K]
    return files.groupBy(K).agg(F.expr(f"max_by(struct({', '.join(others)}), version) AS f")).selectExpr(
        K, *[f"f.{c}" for c in others]
    )


def _check_page(page: int, page_size: int) -> None:
    if page < 1 or not 1 <= page_size <= 100:
        raise ValueError("page starts at 1, page_size is 1 to 100")


def list_contracts(
    contracts: DataFrame, files: DataFrame, status: str | None = None, page: int = 1, page_size: int = 20
) -> DataFrame:
    """One page of contracts, newest first, with the total and the latest file.

    A page holds 1 to 100 rows; other sizes are refused. The page is cut before
    files are joined, so only its contracts' files are aggregated.
    """
    _check_page(page, page_size)
    rows = contracts if status is None else contracts.filter(F.col("status") == status)
    total = rows.agg(F.expr("count(*) AS total")).scalar()
    shown = rows.orderBy(F.desc("created_at"), K).offset((page - 1) * page_size).limit(page_size)
    newest = latest_files(files.join(shown.select(K), K, "left_semi")).select(K, "file_name", "file_type")
    return shown.join(newest, K, "left").selectExpr(
        *contracts.columns, "coalesce(file_name, '') AS file_name", "coalesce(file_type, '') AS file_type",
        f"{record_status('status')} AS record_status",
    ).withColumn("total", total)


def contract_detail(contracts: DataFrame, files: DataFrame, fields: DataFrame, violations: DataFrame) -> DataFrame:
    """Contracts with their files, fields and violations as arrays.

    Each list is aggregated on its own before the join, so lists never multiply.
    A list is one cell by definition: all files, fields or violations of a
    contract meet in it.
    """
    def gather(df: DataFrame, name: str) -> DataFrame:
        cols = ", ".join(c for c in df.columns if c != K)
        return df.groupBy(K).agg(F.expr(f"array_sort(collect_list(struct({cols}))) AS {name}"))

    out = contracts
    for df, name in ((files, "files"), (fields, "fields"), (violations, "violations")):
        out = out.join(gather(df, name), K, "left")
    return out.selectExpr(
        *contracts.columns, *[f"coalesce({n}, array()) AS {n}" for n in ("files", "fields", "violations")]
    )


def list_fields(fields: DataFrame, contract_id) -> DataFrame:
    return fields.filter(F.col(K) == F.lit(contract_id))


def active_definitions(definitions: DataFrame) -> DataFrame:
    return definitions.filter("is_active").orderBy("sort_order", "field_key")


def add_definitions(definitions: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Returns (definitions, refused rows); a taken key is refused, inactive keys count.

    Of new rows that share a key the first by ``sort_order`` is added, the others are refused.
    """
    keys = definitions.select("field_key").distinct().selectExpr("field_key", "true AS __taken")
    order = [c for c in ("sort_order", *sorted(set(new.columns) - {"sort_order"})) if c in new.columns]
    turn = f"row_number() OVER (PARTITION BY field_key ORDER BY {', '.join(order)}) AS __turn"
    marked = new.selectExpr("*", turn).join(keys, "field_key", "left")
    free = "__taken IS NULL AND (__turn = 1 OR field_key IS NULL)"
    return (
        definitions.unionByName(marked.filter(free).select(*new.columns), allowMissingColumns=True),
        marked.filter(f"NOT ({free})").select(*new.columns),
    )


def update_definitions(definitions: DataFrame, patches: DataFrame) -> DataFrame:
    """Partial update: ``set_cols`` names the columns a patch supplies, NULL included.

    Several patches of a key are applied in the order of ``patched_at`` where there is one: each column takes
    the value of the last patch that supplies it.
    """
    changeable = [c for c in DEFINITION_COLUMNS if c != "field_key" and c in patches.columns]
    order = "patched_at" if "patched_at" in patches.columns else f"struct({', '.join(changeable)})"
    last = [f"max_by({c}, {order}) FILTER (WHERE array_contains(set_cols, '{c}')) AS p_{c}" for c in changeable]
    patch = patches.groupBy("field_key").agg(
        F.expr("array_distinct(flatten(collect_list(set_cols))) AS set_cols"), *[F.expr(e) for e in last]
    )
    swap = {
        c: f"CASE WHEN array_contains(set_cols, '{c}') THEN p_{c} ELSE {c} END AS {c}" for c in changeable
    }
    return definitions.join(patch, "field_key", "left").selectExpr(*[swap.get(c, c) for c in definitions.columns])


def deactivate_definitions(definitions: DataFrame, keys: DataFrame) -> DataFrame:
    gone = keys.select("field_key").distinct().selectExpr("field_key", "true AS __gone")
    swap = {"is_active": "CASE WHEN __gone THEN false ELSE is_active END AS is_active"}
    return definitions.join(gone, "field_key", "left").selectExpr(*[swap.get(c, c) for c in definitions.columns])


def _seed_join(definitions: DataFrame, seeds: DataFrame, take_seed: str, active: str) -> DataFrame:
    """Full outer join on the key; seed columns win where ``take_seed`` holds.

    A NULL in a seed leaves the stored value; a seed never sets the contract type.
    """
    fallback = {"value_type": "'string'", "required": "false"}
    renamed = seeds.selectExpr(*[f"{c} AS s_{c}" for c in DEFINITION_COLUMNS])
    both = definitions.join(renamed, F.expr("field_key = s_field_key"), "full_outer")
    cols = [
        f"CASE WHEN {take_seed} THEN coalesce(s_{c}, {c}, {fallback.get(c, 'NULL')}) ELSE {c} END AS {c}"
        for c in DEFINITION_COLUMNS
        if c not in ("field_key", "is_active", "contract_type")
    ]
    out = both.selectExpr("coalesce(field_key, s_field_key) AS field_key", *cols, f"{active} AS is_active", "contract_type")
    return out.select(*DEFINITION_COLUMNS)


def reset_definitions(definitions: DataFrame, seeds: DataFrame) -> DataFrame:
    """Everything off, then the seeds written over and switched on."""
    return _seed_join(definitions, seeds, "s_field_key IS NOT NULL", "s_field_key IS NOT NULL")


def sync_definitions(definitions: DataFrame, seeds: DataFrame) -> DataFrame:
    """Insert missing seeds, revive inactive ones with seed values, leave active ones."""
    take = "s_field_key IS NOT NULL AND (field_key IS NULL OR NOT is_active)"
    return _seed_join(definitions, seeds, take, "is_active IS TRUE OR s_field_key IS NOT NULL")


def search_definitions(definitions: DataFrame, query: str, page: int = 1, page_size: int = 20) -> DataFrame:
    """Active definitions whose name or description contains the text, any case.

    A page holds 1 to 100 rows; other sizes are refused.
    """
    _check_page(page, page_size)
    text = F.lower(F.lit(query.strip()))
    hits = definitions.filter("is_active").filter(
        F.lower("field_name").contains(text) | F.lower(F.coalesce("description", F.lit(""))).contains(text)
    )
    counts = hits.agg(F.expr("struct(count(*) AS total, count_if(required) AS required) AS c")).scalar()
    shown = hits.orderBy("sort_order", "field_key").offset((page - 1) * page_size).limit(page_size)
    return shown.withColumn("c", counts).selectExpr(
        *definitions.columns, "c.total AS total", "c.required AS required_total"
    )


def add_from_library(chosen: DataFrame, library: DataFrame, selected: DataFrame) -> DataFrame:
    """Chosen fields plus the selected library fields not chosen yet."""
    new = library.join(selected.select("field_key"), "field_key", "left_semi").join(
        chosen.select("field_key"), "field_key", "left_anti"
    )
    return chosen.unionByName(new.select(*chosen.columns))


def align_results(requested: DataFrame, fields: DataFrame) -> DataFrame:
    """Results in the order of the requested definitions; absent ones are not found."""
    found = fields.selectExpr(
        K, "field_key", "value AS v", "confidence AS c", "source_text AS st", "page_no AS pn", "review_status AS rs",
        "reviewed_value AS rv", "true AS hit",
    )
    return requested.join(found, [K, "field_key"], "left").selectExpr(
        K, "sort_order", "field_key", "field_name", "coalesce(v, '') AS value", "coalesce(c, 0D) AS confidence",
        "coalesce(st, '') AS source_snippet", "pn AS page_no",
        "CASE WHEN coalesce(v, '') <> '' THEN 'found' ELSE 'not_found' END AS status",
        "CASE WHEN hit THEN rs ELSE 'extracted' END AS review_status", "rv AS reviewed_value",
    )


def result_counts(fields: DataFrame) -> DataFrame:
    """Found and not-found fields per contract."""
    return fields.groupBy(K).agg(
        F.expr("count(*) AS field_count"),
        F.expr("count_if(coalesce(value, '') <> '') AS found_count"),
        F.expr("count_if(coalesce(value, '') = '') AS not_found_count"),
    )


def result_report(fields: DataFrame, contracts: DataFrame) -> DataFrame:
    """The same counts per contract type with a grand total (rollup)."""
    typed = result_counts(fields).join(contracts.selectExpr(K, "coalesce(contract_type, 'unknown') AS contract_type"), K)
    return typed.rollup("contract_type").agg(
        F.expr("count(*) AS contracts"), F.expr("sum(field_count) AS fields"), F.expr("sum(found_count) AS found")
    ).selectExpr("coalesce(contract_type, '(all)') AS contract_type", "contracts", "fields", "found")


def tasks_of(tasks: DataFrame, contract_id) -> DataFrame:
    return tasks.filter(F.col(K) == F.lit(contract_id)).orderBy(F.desc("created_at"))


def batch_outcomes(items: DataFrame) -> DataFrame:
    """Batch items with the extraction status in force (skipped after a failed OCR) and its label."""
    status = "CASE WHEN ocr_status = 'failed' THEN 'skipped' ELSE extraction_status END"
    out = items.selectExpr(*[c for c in items.columns if c != "extraction_status"], f"{status} AS extraction_status")
    return out.selectExpr("*", f"{batch_label('ocr_status', 'extraction_status')} AS label")


def batch_summary(items: DataFrame) -> DataFrame:
    """Counts per batch: OCR preparing, completed and failed, and extraction states."""
    return batch_outcomes(items).groupBy("batch_id").agg(
        F.expr("count_if(ocr_status IN ('processing', 'pending')) AS preparing"),
        F.expr("count_if(ocr_status = 'completed') AS ocr_completed"),
        F.expr("count_if(ocr_status = 'failed') AS ocr_failed"),
        *[F.expr(f"count_if(extraction_status = '{s}') AS extraction_{s}") for s in ("completed", "failed", "skipped")],
    )


def expired_tasks(tasks: DataFrame, now: str) -> DataFrame:
    """Running tasks whose lease ended before ``now`` and what becomes of them.

    Out of attempts: timed out. Otherwise a retry after min(60, 2^attempts) seconds.
    """
    over = "attempts >= max_attempts"
    wait = "make_dt_interval(0, 0, 0, least(60, pow(2, greatest(attempts, 0))))"
    late = tasks.filter(f"status = 'running' AND lease_expires_at < TIMESTAMP_NTZ '{now}'")
    return late.selectExpr(
        "id", K, "attempts", "max_attempts",
        f"CASE WHEN {over} THEN 'timed_out' ELSE 'retrying' END AS new_status",
        f"CASE WHEN {over} THEN 'timed_out' ELSE 'queued' END AS new_stage",
        f"CASE WHEN NOT {over} THEN TIMESTAMP_NTZ '{now}' + {wait} END AS next_run_at",
    )


def due_tasks(tasks: DataFrame, now: str, k: int) -> DataFrame:
    """The first ``k`` tasks to run: priority, then queue time, then creation."""
    due = tasks.filter(
        f"status IN ('pending', 'retrying') AND (next_run_at IS NULL OR next_run_at <= TIMESTAMP_NTZ '{now}')"
    )
    return due.orderBy(F.desc("priority"), "queued_at", "created_at", "id").limit(k)


def fold_task_events(events: DataFrame) -> DataFrame:
    """Task state from its status events: last status and stage, start and end time."""
    final = "event IN ('completed', 'failed', 'cancelled', 'timed_out')"
    rows = events.selectExpr(
        "task_id", "created_at", "event_id",
        f"CASE WHEN {final} THEN event WHEN event LIKE '%\\\\_failed' THEN 'failed' ELSE 'running' END AS status",
        f"CASE WHEN {final} THEN event ELSE regexp_replace(event, '_failed$', '') END AS stage",
    )
    return rows.groupBy("task_id").agg(
        F.expr("max_by(struct(status, stage), struct(created_at, event_id)) AS s"),
        F.expr("min(created_at) AS started_at"),
        F.expr("max(created_at) FILTER (WHERE status IN ('completed', 'failed', 'cancelled', 'timed_out')) AS completed_at"),
    ).selectExpr("task_id", "s.status", "s.stage", "started_at", "completed_at")


def ready_for_extraction(contracts: DataFrame, blocks: DataFrame) -> DataFrame:
    """Contracts whose OCR completed and that have at least one block."""
    return contracts.filter("ocr_completed_at IS NOT NULL").join(blocks.select(K), K, "left_semi")


def numbered(df: DataFrame, bucket: str, order: Sequence[str], name: str = "idx") -> DataFrame:
    """Running number over all rows without a single-task sort."""
    return number_rows(df, [], bucket, ", ".join(order), name)
