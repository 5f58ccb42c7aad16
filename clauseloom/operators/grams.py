"""Substring search over a large library of definitions through trigram lists.

Every place of a text gives the three characters that start there, filled up
at the end, so texts that contain a query of three or more characters are in
the lists of all its trigrams, and texts that contain a shorter one are in a
list that starts with it. Lists are ranged by trigram, so a search reads the
row groups of its own; what it finds there is verified on the text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fills up the last two trigrams; never part of a text.
_END = "\\u0000"


def _searched(definitions: DataFrame) -> DataFrame:
    return definitions.selectExpr("*", "array(lower(field_name), lower(coalesce(description, ''))) AS __texts")


@dataclass(frozen=True)
class GramLists:
    """Trigram lists of active definitions."""

    spark: SparkSession
    folder: str

    def candidates(self, query: str) -> DataFrame:
        """field_key of the definitions that can contain the text (already lower-cased, not empty)."""
        lists = self.spark.read.parquet(f"{self.folder}/lists")
        if len(query) < 3:
            return lists.filter(F.col("gram").startswith(query)).select("field_key").distinct()
        wanted = sorted({query[i : i + 3] for i in range(len(query) - 2)})
        met = lists.filter(F.col("gram").isin(wanted)).groupBy("field_key").agg(F.expr("count(*) AS n"))
        return met.filter(F.col("n") == len(wanted)).select("field_key")

    def search(self, query: str, page: int = 1, page_size: int = 20) -> DataFrame:
        """One page of the definitions whose name or description contains the text, with both totals."""
        if page < 1 or not 1 <= page_size <= 100:
            raise ValueError("page starts at 1, page_size is 1 to 100")
        text = self.spark.range(1).select(F.lower(F.lit(query.strip()))).first()[0]
        library = self.spark.read.parquet(f"{self.folder}/definitions")
        hits = library if not text else _searched(library.join(self.candidates(text), "field_key", "left_semi")).filter(
            F.exists("__texts", lambda t: F.contains(t, F.lit(text)))
        ).drop("__texts")
        counts = hits.agg(F.expr("struct(count(*) AS total, count_if(required) AS required) AS c")).scalar()
        shown = hits.orderBy("sort_order", "field_key").offset((page - 1) * page_size).limit(page_size)
        return shown.withColumn("c", counts).selectExpr(*library.columns, "c.total AS total", "c.required AS required_total")


def gram_lists(definitions: DataFrame, folder: str) -> GramLists:
    """Write the lists of the active definitions; a key has one definition."""
    active = definitions.filter("is_active")
    active.repartitionByRange("field_key").write.mode("overwrite").parquet(f"{folder}/definitions")
    each = "transform(filter(__texts, t -> t <> ''), t -> transform(sequence(1, length(t)), i -> substring(concat(t, '{e}{e}'), i, 3)))".replace("{e}", _END)
    grams = _searched(active).selectExpr("field_key", f"explode(array_distinct(flatten({each}))) AS gram")
    grams.repartitionByRange("gram").sortWithinPartitions("gram").write.mode("overwrite").parquet(f"{folder}/lists")
    return GramLists(definitions.sparkSession, folder)
