"""The registered queries of this subpackage: thin digests over the operators, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseloom.llm import (
    byte_bpe, hard_negatives, language_id, line_dedup, near_dedup, packing, passage_dedup, spelling, toxicity, url_filter, vector_dedup,
    vector_packing, vector_search,
)
from clauseloom.llm.shared import crc_of_id


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"), min_docs=10)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), common AS (
  SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10
)
SELECT k.doc_id, count(*) AS n_lines, count(c.key) AS n_dropped,
       sha256(coalesce(string_agg(k.line, chr(10) ORDER BY k.pos) FILTER (WHERE c.key IS NULL), '')) AS kept_sha256
FROM keyed k LEFT JOIN common c ON k.key = c.key
GROUP BY k.doc_id
"""

def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _table(spark, sf_dir, "labels").select("doc_id", "toxic").where(crc_of_id(5) != 0)
    scored = toxicity.score(docs, toxicity.train(docs, labels))
    return scored.select("doc_id", (crc_of_id(5) == 0).alias("held_out"), "score", "predicted", "neighbours", "cosines")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language_id.train(docs.select("doc_id", "text", "lang").where(crc_of_id(4) != 2))
    return language_id.predict(docs.select("doc_id", "text"), model).select("doc_id", (crc_of_id(4) == 2).alias("held_out"), "lang_pred", "score")


def op2_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_vectors(_table(spark, sf_dir, "embeddings"), cosine=0.9)


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op8_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = passage_dedup.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"), length=400)
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), F.length("kept").cast("long").alias("n_kept"))


#: The rules of the registered URL query.
URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def op6_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return vector_search.neighbours(rows, rows.where("vec_id % 20 = 0"), k=20)


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "rule string, verdict string")
    return url_filter.judge(_table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


OP7_SQL = """
WITH rules(rule, host, path, verdict) AS (VALUES
  ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
  ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')
), parts AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
)
SELECT p.page_id, p.host, p.path, max_by(r.rule, length(r.rule)) AS rule,
       coalesce(max_by(r.verdict, length(r.rule)), 'allow') AS verdict
FROM parts p LEFT JOIN rules r ON (p.host = r.host OR suffix(p.host, '.' || r.host)) AND prefix(p.path, r.path)
GROUP BY p.page_id, p.host, p.path
"""


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = byte_bpe.decode(byte_bpe.encode(_table(spark, sf_dir, "documents").select("doc_id", "text")))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.select("vec_id", "embedding", moved.alias("label")), anchors="vec_id % 100 = 0")


def op12_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_packing.pack(_table(spark, sf_dir, "documents").select("doc_id", "text"), vector_packing.Limits(tokens=1024, segments=64, loss=1024))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.words(_table(spark, sf_dir, "documents").select("doc_id", "text"), slips=97))


QUERIES = {
    "op1_toxicity": op1_toxicity, "op2_vector_dedup": op2_vector_dedup, "op3_near_dedup": op3_near_dedup, "op4_language_id": op4_language_id,
    "op5_packing": op5_packing, "op6_vector_search": op6_vector_search, "op7_url_filter": op7_url_filter, "op8_passage_dedup": op8_passage_dedup,
    "op9_line_dedup": op9_line_dedup, "op10_byte_bpe": op10_byte_bpe, "op11_hard_negatives": op11_hard_negatives,
    "op12_vector_packing": op12_vector_packing, "op13_spelling_variants": op13_spelling_variants,
}
ORACLES = {"op7_url_filter": OP7_SQL, "op9_line_dedup": OP9_SQL}
