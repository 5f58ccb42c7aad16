"""Pages of a long ordered list, each read from the run that holds it.

``orderBy().offset().limit()`` ends in one task that passes over all rows
before the page. Here the rows are ranged over files in their order once, with
the number of rows before each file, so a page opens the one or two files it
lies in, however deep it is.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows of a file at most.
RUN = 200_000


@dataclass(frozen=True)
class Paged:
    """An ordered list on shared storage."""

    spark: SparkSession
    folder: str
    schema: StructType
    order: tuple[Column, ...]

    def files(self, page: int, page_size: int) -> DataFrame:
        """The files a page lies in, with the rows before each and the total."""
        first = (page - 1) * page_size
        runs = self.spark.read.parquet(f"{self.folder}/counts")
        return runs.filter((F.col("before") < first + page_size) & (F.col("before") + F.col("n") > first))

    def total(self) -> int:
        return self.spark.read.parquet(f"{self.folder}/counts").agg(F.expr("coalesce(sum(n), 0) AS total")).first()[0]

    def page(self, page: int, page_size: int) -> DataFrame:
        """The rows of a page, in no particular order, with the list's total; beyond the end there are none."""
        if page < 1 or page_size < 1:
            raise ValueError("page and page_size start at 1")
        found = self.files(page, page_size).orderBy("before").collect()  # a page's files: two or three at most
        names = [f"{self.folder}/rows/{r['file']}" for r in found]
        if not names:
            return self.spark.createDataFrame([], self.schema).withColumn("total", F.lit(0).cast("long"))
        rows = self.spark.read.schema(self.schema).parquet(*names)
        skipped = (page - 1) * page_size - found[0]["before"]
        return rows.orderBy(*self.order).offset(skipped).limit(page_size).withColumn("total", F.lit(found[0]["total"]).cast("long"))


def paged(rows: DataFrame, order: Sequence[Column], folder: str, run: int = RUN) -> Paged:
    """Write ``rows`` in their order (which must be total for pages to be repeatable) and count the files."""
    spark = rows.sparkSession
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged.write.mode("overwrite").option("maxRecordsPerFile", run).parquet(f"{folder}/rows")
    stored = spark.read.schema(rows.schema).parquet(f"{folder}/rows")
    counts = stored.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.expr("count(*) AS n"))
    # one small row a file; the writer numbers partitions and the files of each in their order
    number = "struct(CAST(regexp_extract(file, '^part-([0-9]+)', 1) AS INT), CAST(regexp_extract(file, '-c([0-9]+)', 1) AS INT))"
    before = f"coalesce(sum(n) OVER (ORDER BY {number} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0L) AS before"
    counts.selectExpr("file", "n", before, "sum(n) OVER () AS total").write.mode("overwrite").parquet(f"{folder}/counts")
    return Paged(spark, folder, rows.schema, tuple(order))
