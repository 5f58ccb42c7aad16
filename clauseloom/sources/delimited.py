"""Records of delimited text whose quoted cells may hold line ends, read by many tasks.

A line end closes a record when an even number of quotes stands before it. So
a run of lines maps the state it starts in (inside a quoted cell or not) to
the state it ends in and to the number of records it closes, and these maps
compose: one small row a run gives every run its start, whatever the size of
the file. Only records that go over line ends are gathered by a shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lines of a run.
RUN = 4096


def records(spark: SparkSession, path: str) -> DataFrame:
    """(file, record, text): the records of every file, numbered from 0; their line ends are kept as ``\\n``.

    Quotes are doubled inside quoted cells and stand nowhere else. A quote
    that is never closed makes the rest of its file one record. Blank lines
    outside quotes are records of their own (empty text).
    """
    lines = spark.read.text(path, lineSep="\n").select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        # rises along a block, which one task reads from start to end
        F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"),
    )
    lines = lines.selectExpr("*", f"at DIV {RUN} AS run", "length(line) - length(replace(line, '\"', '')) AS quotes")
    within = "OVER (PARTITION BY file, block, run ORDER BY at ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    told = lines.selectExpr("file", "block", "run", "at", "line", f"sum(quotes) {within} % 2 AS odd")
    # records closed by the lines so far, if the run starts outside (0) or inside (1) a quoted cell
    told = told.selectExpr("*", f"count_if(odd = 0) {within} AS closed0", f"count_if(odd = 1) {within} AS closed1")
    runs = lines.groupBy("file", "block", "run").agg(F.expr("sum(quotes) % 2 AS odd")).join(
        told.groupBy("file", "block", "run").agg(F.expr("max(closed0) AS closed0"), F.expr("max(closed1) AS closed1")), ["file", "block", "run"]
    )
    before = "OVER (PARTITION BY file ORDER BY block, run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    started = runs.selectExpr("*", f"coalesce(sum(odd) {before}, 0) % 2 AS inside")
    started = started.selectExpr("file", "block", "run", "inside", f"coalesce(sum(if(inside = 0, closed0, closed1)) {before}, 0) AS done")
    placed = told.join(started, ["file", "block", "run"]).selectExpr(
        "file", "block", "at", "line", "odd = inside AS closes", "done + if(inside = 0, closed0, closed1) AS closed",
        "lag(odd = inside) OVER (PARTITION BY file, block, run ORDER BY at) AS opens", "inside",
    ).selectExpr("file", "block", "at", "line", "closes", "closed - if(closes, 1, 0) AS record", "coalesce(opens, inside = 0) AS opens")
    alone = placed.filter("opens AND closes").select("file", "record", "line")
    parted = placed.filter("NOT (opens AND closes)").groupBy("file", "record").agg(
        F.expr("array_join(transform(array_sort(collect_list(struct(block, at, line))), x -> x.line), '\n') AS line")
    )
    return alone.unionByName(parted).selectExpr("file", "record", r"regexp_replace(line, '\r$', '') AS text")
