"""Scratch tables on the shared folder and small helpers of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseloom.session import BATCH_BYTES, bound_batches, ship  # noqa: F401


def shared_root(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir``, or a temp folder for a local master alone."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    root = "file://" + tempfile.mkdtemp(prefix="clauseloom-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


class Scratch:
    """Parquet tables under one fresh folder of the shared root; they cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        ship(spark)
        self.path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, table: str, *partition_by: str) -> DataFrame:
        """Write ``df`` as ``table`` and read it back."""
        path = f"{self.path}/{table}"
        df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, table: str) -> None:
        """Delete a table that nothing reads any more."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{table}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def text_key() -> F.Column:
    """Tells apart rows of one doc_id (or of none) with different texts, by 128 bits; null and empty texts are alike."""
    return F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))


def crc_of_id(modulus: int) -> F.Column:
    """crc32 of the doc_id as text, modulo; null ids count as empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


#: bytes.translate table that lower-cases A-Z and leaves all else.
ASCII_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
