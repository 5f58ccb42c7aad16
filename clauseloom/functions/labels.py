"""Fixed code-to-label translations (SQL expression text in and out)."""

from __future__ import annotations

from clauseloom.functions.text import lookup

# Labels shown in exports and review lists.
STATUS_LABELS = {"completed": "完成", "failed": "失败", "skipped": "跳过", "processing": "处理中"}
REVIEW_LABELS = {"corrected": "已修正", "approved": "已通过", "rejected": "已驳回", "reviewed": "已复核"}
RECORD_STATUS = {
    "processing": "PROCESSING", "uploaded": "PROCESSING",
    "reviewing": "COMPLETED", "approved": "COMPLETED", "failed": "FAILED",
}
EXTRACTION_LABELS = {"completed": "已提取", "failed": "提取失败", "skipped": "OCR失败", "processing": "提取中"}
OCR_LABELS = {"completed": "OCR完成", "failed": "OCR失败", "processing": "OCR中"}


def status_label(e: str) -> str:
    return lookup(e, STATUS_LABELS, "未处理")


def review_label(e: str) -> str:
    return lookup(e, REVIEW_LABELS, "")


def record_status(e: str) -> str:
    return lookup(e, RECORD_STATUS, "PROCESSING")


def batch_label(ocr_status: str, extraction_status: str) -> str:
    return f"coalesce({lookup(extraction_status, EXTRACTION_LABELS)}, {lookup(ocr_status, OCR_LABELS)}, '等待OCR')"
