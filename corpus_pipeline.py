"""The corpus pipeline: language ID, line dedup, near-dedup, passage dedup and packing, one after the other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseloom.llm import language_id, line_dedup, near_dedup, packing, passage_dedup
from clauseloom.llm.shared import Scratch, text_key

#: Documents whose language is less sure than this go; two languages alike sure have 0.5.
LEAST_SCORE = 0.4


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (null and empty ones too) and those of no language in particular go.

    Without a labelled document there is nothing to judge by: all documents with a letter stay then.
    """
    model = language_id.train(docs.select("doc_id", "text", "lang"))
    judged = language_id.predict(docs.select(F.struct(*docs.columns).alias("row")), model, text="row.text")
    sure = F.col("score") >= LEAST_SCORE if model.labels else F.expr(r"row.text RLIKE '\\p{L}'")
    return judged.where(sure).select("row.*")


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten or more documents go; n_chars follows the text."""
    return _with_text(docs, line_dedup.dedup_lines(docs, min_docs=10))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one of the smallest doc_id.

    Documents without words are in no group and stay. Of rows that share that doc_id one stays, and one of the
    rows of a group in which no row has a doc_id.
    """
    scratch = Scratch(spark, "kept")
    groups = near_dedup.near_duplicates(docs, with_class=True)
    best = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "tk")).alias("best")
    grouped = groups.where("group is not null").groupBy("group").agg(best)
    kept = grouped.select("best.doc_id", "best.tk")
    single = groups.where("group is null").select("doc_id", "tk").distinct()
    kept = scratch.keep(kept.unionByName(single), "kept")
    # the columns of docs stay inside a struct, so that no name can clash
    named = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("id"), text_key().alias("key"))
    rows = named.alias("d").join(kept.alias("k"), F.expr("d.id <=> k.doc_id AND d.key = k.tk"), "left_semi").select("row.*")
    # rows alike in doc_id and text are one document; the rare repeats are found by key, without the texts
    twice = rows.groupBy("doc_id", text_key().alias("tk")).agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    return rows if twice else rows.dropDuplicates(["doc_id", "text"])


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes in passages of 400 bytes that also stand elsewhere go; characters cut in two go with them."""
    return _with_text(docs, passage_dedup.remove_repeats(docs, length=400, texts=True))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence of at most 2048 tokens."""
    return packing.pack(docs, length=2048)


def _with_text(docs: DataFrame, changed: DataFrame) -> DataFrame:
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return changed.select(*docs.columns)


STAGES = [
    ("language_id", keep_known_language), ("line_dedup", drop_common_lines), ("near_dedup", keep_one_of_near_copies),
    ("passage_dedup", drop_repeated_passages), ("packing", pack_sequences),
]

#: SQL cannot express the trained classifier, the hashing and the packing of these stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each result is written to the shared folder before the next stage reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return docs
