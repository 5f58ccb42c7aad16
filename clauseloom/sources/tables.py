"""Replace-by-key storage on plain Parquet.

A batch never rewrites earlier data. It adds its rows and the list of keys it
replaces under its own batch number; the current state of a key is what its
newest batch wrote (possibly nothing). A repeated batch overwrites only
itself, so retries and lost executors do no harm.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

K = "contract_id"


def replace_contracts(old: DataFrame, new: DataFrame, touched: DataFrame | None = None) -> DataFrame:
    """Old rows of untouched contracts plus all new rows."""
    keys = (new if touched is None else touched).select(K).distinct()
    return old.join(keys, K, "left_anti").unionByName(new, allowMissingColumns=True)


def write_batch(rows: DataFrame, touched: DataFrame, root: str, batch_id: int, keys: Sequence[str] = (K,)) -> None:
    """Store one batch. The touched list is written last and makes it visible."""
    rows.write.mode("overwrite").parquet(f"{root}/rows/batch_id={batch_id}")
    touched.select(*keys).distinct().write.mode("overwrite").parquet(f"{root}/touched/batch_id={batch_id}")


def _read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("basePath", path).parquet(path)


def read_current(spark: SparkSession, root: str, keys: Sequence[str] = (K,)) -> DataFrame:
    """Rows of each key's newest batch."""
    newest = _read(spark, f"{root}/touched").groupBy(*keys).agg(F.max("batch_id").alias("batch_id"))
    return _read(spark, f"{root}/rows").join(newest, [*keys, "batch_id"]).drop("batch_id")


def append_batch(rows: DataFrame, root: str, batch_id: int) -> None:
    """Add rows of an append-only table under their batch number."""
    rows.write.mode("overwrite").parquet(f"{root}/batch_id={batch_id}")


def read_appended(spark: SparkSession, root: str) -> DataFrame:
    return _read(spark, root)
