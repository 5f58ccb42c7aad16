"""Incremental jobs on Structured Streaming.

Each job reads a growing folder, keeps its place in a checkpoint and writes
per-batch results that a repeated batch simply overwrites.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from clauseloom.operators.review import AT
from clauseloom.plans import batch
from clauseloom.schemas import MODEL_RESPONSES, OCR_RESPONSES
from clauseloom.sources import tables
from clauseloom.sources.store import Store

K = "contract_id"


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder under ``spark.checkpoint.dir``, which driver and executors must share.

    Only a session that runs in one process (a local master) may go without the setting; it gets a temp folder.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        return tempfile.mkdtemp(prefix=f"{name}-")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def read_responses(spark: SparkSession, path: str, kind: str = "ocr", max_files: int | None = None) -> DataFrame:
    """Response files (JSON lines) as a stream, every file taken up once, ``max_files`` at most in a micro-batch."""
    schema = OCR_RESPONSES if kind == "ocr" else MODEL_RESPONSES
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.json(path).select("*", "_metadata.file_modification_time")


def newest_responses(rows: DataFrame) -> DataFrame:
    """Of several responses for a page of a contract the one of the newest file; between equal times the greater text."""
    at = "struct(file_modification_time, body)" if "file_modification_time" in rows.columns else "body"
    whole = F.expr(f"max_by(struct(*), {at}) AS r")
    return rows.groupBy(K, "page_no").agg(whole).select("r.*").drop("file_modification_time")


def _run(stream: DataFrame, handle, folder: str, mode: str = "append") -> StreamingQuery:
    return (
        stream.writeStream.outputMode(mode).foreachBatch(handle)
        .option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    )


def ingest_blocks(responses: DataFrame, folder: str) -> StreamingQuery:
    """OCR responses to blocks, replacing a contract's blocks as a whole."""

    def handle(rows: DataFrame, batch_id: int) -> None:
        rows = rows.persist()
        try:
            with Store(rows.sparkSession, f"{folder}/blocks").batch(batch_id) as made:
                if not made.done:
                    made.write("blocks", batch.ingest(newest_responses(rows)).blocks, rows)
        finally:
            rows.unpersist()

    return _run(responses, handle, folder)


def read_blocks(spark: SparkSession, folder: str, keys: DataFrame | None = None) -> DataFrame:
    """The current blocks, of some contracts alone if ``keys`` names them."""
    return Store(spark, f"{folder}/blocks").read("blocks", keys)


def extract_fields(
    responses: DataFrame, blocks_folder: str, contracts: DataFrame, definitions: DataFrame, folder: str,
    overrides: DataFrame | None = None,
) -> StreamingQuery:
    """Model responses to fields and findings, refreshing only the contracts a batch touches.

    Chunks of a contract may come in different batches, so the answers are
    kept and a touched contract is worked out again from all of its answers;
    those and its blocks are looked up by key. Answers, fields and findings of
    a batch become visible together.
    """

    def handle(rows: DataFrame, batch_id: int) -> None:
        store = Store(rows.sparkSession, f"{folder}/extracted")
        rows = rows.select(K, "chunk_no", "raw", "error").persist()
        held = [rows]
        try:
            with store.batch(batch_id) as made:
                if made.done:
                    return
                touched = rows.select(K).distinct()
                fresh = rows.groupBy(K, "chunk_no").agg(F.expr("max(struct(raw, error)) AS r")).selectExpr(
                    K, "chunk_no", "r.raw", "r.error"
                )
                answers = fresh
                if "answers" in store.snapshot().schemas:
                    older = store.read("answers", touched).alias("o")
                    again = F.expr(f"o.{K} <=> f.{K} AND o.chunk_no <=> f.chunk_no")
                    answers = older.join(fresh.alias("f"), again, "left_anti").unionByName(fresh)
                answers = made.write("answers", answers, touched)
                # tracing reads blocks and matched fields several times: looked up, parsed and merged once for all
                blocks = read_blocks(rows.sparkSession, blocks_folder, touched).persist()
                held.append(blocks)
                own = None if overrides is None else overrides.join(touched, K, "left_semi")
                out = batch.extract(contracts.join(touched, K, "left_semi"), blocks, answers, definitions, own)
                held.append(out.matched.persist())
                fields = made.write("fields", out.fields, touched)
                # findings follow from the fields as written, not from a second pass over the answers
                found = batch.V.validate(fields, fields.select(K).distinct()).selectExpr("*", "'active' AS status")
                made.write("violations", found, touched)
        finally:
            for kept in held:
                kept.unpersist()

    return _run(responses, handle, folder)


def read_extracted(spark: SparkSession, folder: str, table: str, keys: DataFrame | None = None) -> DataFrame:
    """The current ``fields``, ``violations`` or ``answers``."""
    return Store(spark, f"{folder}/extracted").read(table, keys)


def live_review_state(events: DataFrame, folder: str) -> StreamingQuery:
    """Latest review status and value per field, updated with every batch."""
    changed = "coalesce(action = 'modify' AND new_value IS NOT NULL, false)"
    status = (
        f"CASE WHEN {changed} THEN 'corrected' WHEN action = 'approve' THEN 'approved' "
        "WHEN action = 'reject' THEN 'rejected' ELSE action END"
    )
    state = events.groupBy(K, "field_key").agg(
        F.expr(f"max_by({status}, {AT}) AS review_status"),
        F.expr(f"max_by(new_value, {AT}) FILTER (WHERE {changed}) AS reviewed_value"),
        F.expr(f"max_by(reviewer_id, {AT}) AS reviewer_id"),
        F.expr("max(created_at) AS reviewed_at"),
    )
    keys = (K, "field_key")

    def handle(rows: DataFrame, batch_id: int) -> None:
        rows = rows.persist()
        try:
            tables.write_batch(rows, rows, f"{folder}/state", batch_id, keys)
        finally:
            rows.unpersist()

    return _run(state, handle, folder, "update")


def read_review_state(spark: SparkSession, folder: str) -> DataFrame:
    return tables.read_current(spark, f"{folder}/state", (K, "field_key"))


def distinct_events(events: DataFrame, horizon: str = "1 hour") -> DataFrame:
    """Drop repeats of an event (client retries) that come within the horizon."""
    return events.withWatermark("created_at", horizon).dropDuplicatesWithinWatermark(["event_id"])


def append_stream(stream: DataFrame, folder: str) -> StreamingQuery:
    """Write a stream's rows batch by batch."""
    return _run(stream, lambda rows, n: tables.append_batch(rows, f"{folder}/rows", n), folder)
