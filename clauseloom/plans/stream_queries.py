"""Registered streaming queries: each drains the given table once and reads the result back."""

from __future__ import annotations

from pyspark.sql import functions as F

from clauseloom.plans import adapters as A
from clauseloom.plans import extraction_queries as X
from clauseloom.plans.clause_queries import BLOCKS, strip_sql
from clauseloom.sources import tables
from clauseloom.sources.store import Store
from clauseloom.streaming import jobs


def _stream(spark, sf_dir, name):
    """A given table as a stream; timestamps as instants, which watermarks need."""
    schema = A.table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def _review_stream(spark, sf_dir):
    events = _stream(spark, sf_dir, "events")
    return spark.sql(A.REVIEWS_SQL.replace("FROM events", "FROM {events}"), events=events)


def stream_review_state(spark, sf_dir):
    folder = jobs.work_folder(spark, "review-state")
    jobs.live_review_state(_review_stream(spark, sf_dir), folder).awaitTermination()
    return jobs.read_review_state(spark, folder).select(
        "contract_id", "field_key", "review_status", "reviewed_value", "reviewer_id", "reviewed_at"
    )


def stream_distinct_events(spark, sf_dir):
    """Every third event arrives twice."""
    folder = jobs.work_folder(spark, "distinct-events")
    twice = _review_stream(spark, sf_dir).selectExpr(
        "event_id", "contract_id", "action", "CAST(created_at AS TIMESTAMP) AS created_at",
        "explode(CASE WHEN event_id % 3 = 0 THEN array(1, 2) ELSE array(1) END) AS copy",
    )
    jobs.append_stream(jobs.distinct_events(twice), folder).awaitTermination()
    return tables.read_appended(spark, f"{folder}/rows").select("event_id", "contract_id", "action")


def stream_blocks(spark, sf_dir):
    """Documents become layout answers, which are drained into the block table."""
    folder = jobs.work_folder(spark, "blocks")
    A.layout_responses(spark, sf_dir).selectExpr(
        "CAST(contract_id AS STRING) AS contract_id", "0 AS page_no", "'layout' AS provider", "body"
    ).write.json(f"{folder}/incoming")
    jobs.ingest_blocks(jobs.read_responses(spark, f"{folder}/incoming"), folder).awaitTermination()
    return jobs.read_blocks(spark, folder).groupBy("contract_id").agg(
        F.expr("count(*) AS blocks"), F.expr("max(page_no) AS last_page"), F.expr("sum(length(text)) AS chars")
    )


def _extracted(spark, sf_dir):
    """The documents' answers arrive in two files, a micro-batch each; their blocks are stored before."""
    folder = jobs.work_folder(spark, "extract")
    contracts, responses, sets = X.line_answers(spark, sf_dir)
    blocks = A.blocks(spark, sf_dir)
    with Store(spark, f"{folder}/ocr/blocks").batch(0) as made:
        made.write("blocks", blocks, blocks)
    responses.selectExpr("CAST(contract_id AS STRING) AS contract_id", "chunk_no", "raw", "error").repartition(2, "contract_id").write.json(f"{folder}/incoming")
    stream = jobs.read_responses(spark, f"{folder}/incoming", "model", max_files=1).withColumn("contract_id", F.col("contract_id").cast("long"))
    jobs.extract_fields(stream, f"{folder}/ocr", contracts, A.definitions(spark), folder, sets).awaitTermination()
    return folder


def stream_extract(spark, sf_dir):
    """The whole extraction as a stream: the stored fields equal those of the batch plan."""
    return X.extracted_rows(jobs.read_extracted(spark, _extracted(spark, sf_dir), "fields"))


QUERIES = {
    "stream_review_state": stream_review_state,
    "stream_distinct_events": stream_distinct_events,
    "stream_blocks": stream_blocks,
    "stream_extract": stream_extract,
}

# --- reference SQL -----------------------------------------------------------

ORACLES = {
    "stream_extract": X.ORACLES["extract_contracts"],
    "stream_review_state": f"""WITH reviews AS ({A.REVIEWS_SQL}), st AS (SELECT *, coalesce(action = 'modify' AND new_value IS NOT NULL, false) AS chg FROM reviews)
        SELECT contract_id, field_key, arg_max(CASE WHEN chg THEN 'corrected' WHEN action = 'approve' THEN 'approved' WHEN action = 'reject' THEN 'rejected'
            ELSE action END, (created_at, event_id)) AS review_status,
          arg_max(new_value, (created_at, event_id)) FILTER (WHERE chg) AS reviewed_value, arg_max(reviewer_id, (created_at, event_id)) AS reviewer_id,
          max(created_at) AS reviewed_at FROM st GROUP BY contract_id, field_key""",
    "stream_distinct_events": f"WITH reviews AS ({A.REVIEWS_SQL}) SELECT event_id, contract_id, action FROM reviews",
    "stream_blocks": f"""{BLOCKS} SELECT CAST(contract_id AS VARCHAR) AS contract_id, count(*) AS blocks, max(page_no) AS last_page,
        CAST(sum(length({strip_sql('text')})) AS BIGINT) AS chars FROM blocks WHERE (contract_id + sort_order) % 7 <> 0 AND {strip_sql('text')} <> ''
        GROUP BY contract_id""",
}
