"""Time the headline queries on one session and print one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the local cores. Every query is
run in full into a no-op sink; the best of BENCH_RUNS runs counts.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from clauseloom.plans import registry

HEADLINE = [
    "validate_all", "contract_verdict", "refresh_violations", "recompute_violations", "clause_segments",
    "text_clause_segments", "clause_completeness", "document_markdown", "page_chunks", "ocr_diagnostics", "prompts",
    "explode_fields", "merge_chunks", "reconcile", "trace_sources", "review_state", "corrections_state", "accuracy_report",
    "contract_list", "contract_detail", "layout_blocks", "text_ocr_blocks", "export_wide", "export_csv_lines",
    "stream_review_state",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    names = sys.argv[1:] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry.queries()
    spark.read.parquet(f"{sf_dir}/orders.parquet").count()  # start the engine outside the clock
    seconds = {}
    for name in names:
        best = None
        for _ in range(runs):
            start = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            best = took if best is None else min(best, took)
        seconds[name] = round(best, 3)
    spark.stop()
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(os.path.normpath(sf_dir)),
    }))


if __name__ == "__main__":
    main()
