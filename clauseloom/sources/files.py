"""Intake of uploaded files: type, checks, hash, stored name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clauseloom.functions.text import safe_filename

MB = 1024 * 1024

# Leading bytes (hex) per file type, tested in this order.
SIGNATURES = [
    ("25504446", "pdf"), ("89504E47", "png"), ("FFD8FF", "jpg"), ("47494638", "gif"),
    ("424D", "bmp"), ("49492A00", "tiff"), ("4D4D002A", "tiff"),
]
ALLOWED = ("pdf", "png", "jpg", "jpeg", "gif", "bmp", "tiff", "tif")
BATCH_ALLOWED = ("pdf", "png", "jpg", "jpeg", "bmp")
IMAGE_TYPES = ("png", "jpg", "jpeg", "bmp")
BATCH_FILES = 5


def _in(names: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


def scan_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files under a folder: path, name, size, content.

    The source does not return zero-length files; tables of uploads from
    elsewhere may hold them, and ``validate_intake`` refuses them.
    """
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    )
    return files.selectExpr("path", "regexp_extract(path, '[^/]*$', 0) AS file_name", "length AS file_size", "content")


def file_extension(name: str) -> str:
    return f"CASE WHEN locate('.', {name}) > 0 THEN lower(substring_index({name}, '.', -1)) ELSE '' END"


def file_type(content: str, name: str) -> str:
    """Type by leading bytes, else by an allowed extension, else NULL."""
    arms = " ".join(
        f"WHEN hex(substring({content}, 1, {len(sig) // 2})) = '{sig}' THEN '{kind}'" for sig, kind in SIGNATURES
    )
    ext = file_extension(name)
    return f"CASE {arms} WHEN {ext} IN {_in(ALLOWED)} THEN {ext} END"


def content_hash(content: str) -> str:
    return f"sha2({content}, 256)"


def validate_intake(files: DataFrame, max_size: int = 100 * MB) -> DataFrame:
    """Files with type, hash, stored name and the first reason to refuse (NULL: accepted)."""
    typed = files.selectExpr("*", f"{file_type('content', 'file_name')} AS file_type")
    reason = (
        "CASE WHEN coalesce(file_name, '') = '' THEN 'missing_name' WHEN coalesce(file_size, 0) = 0 THEN 'empty_file' "
        f"WHEN file_size > {max_size} THEN 'too_large' WHEN file_type IS NULL THEN 'unsupported_type' END AS reason"
    )
    return typed.selectExpr(
        *files.columns, "file_type", f"{content_hash('content')} AS content_hash",
        f"{safe_filename('file_name', 'file_type')} AS stored_name", reason,
    )


def duplicate_report(files: DataFrame) -> DataFrame:
    """Content hashes that occur more than once. Duplicates stay allowed."""
    from pyspark.sql import functions as F

    groups = files.groupBy("content_hash").agg(F.expr("count(*) AS copies"), F.expr("min(file_name) AS first_name"))
    return groups.filter("copies > 1")


def validate_batch(files: DataFrame) -> DataFrame:
    """First reason to refuse each file of an upload batch (NULL: accepted).

    A batch holds at most five files; images stay under 5 MB, other files
    under 60 MB. Files without a batch count as one batch. The batch size is a
    mergeable count joined back, not a window.
    """
    from pyspark.sql import functions as F

    from clauseloom.operators.ordered import null_safe_join

    sizes = files.groupBy("batch_id").agg(F.expr("count(*) AS n_files"))
    ext = file_extension("file_name")
    image = f"{ext} IN {_in(IMAGE_TYPES)}"
    if "content_type" in files.columns:
        image = f"({image} OR coalesce(startswith(content_type, 'image/'), false))"
    reason = (
        f"CASE WHEN n_files > {BATCH_FILES} THEN 'too_many_files' WHEN {ext} NOT IN {_in(BATCH_ALLOWED)} THEN 'unsupported_type' "
        f"WHEN file_size > CASE WHEN {image} THEN {5 * MB} ELSE {60 * MB} END THEN 'too_large' END AS reason"
    )
    return null_safe_join(files, sizes, ["batch_id"]).selectExpr(*files.columns, "n_files", reason)
