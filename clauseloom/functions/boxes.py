"""Bounding boxes as ``struct<x1,y1,x2,y2>`` (SQL expression text in and out)."""

from __future__ import annotations

from clauseloom.schemas import BBOX

CORNERS = ("x1", "y1", "x2", "y2")


def make_box(x1: str, y1: str, x2: str, y2: str) -> str:
    return "named_struct(" + ", ".join(
        f"'{n}', CAST({e} AS DOUBLE)" for n, e in zip(CORNERS, (x1, y1, x2, y2))
    ) + ")"


def box_from_array(arr: str) -> str:
    """Box from an array of exactly four numbers, else NULL."""
    parts = [f"get({arr}, {i})" for i in range(4)]
    whole = " AND ".join(f"{p} IS NOT NULL" for p in parts)
    return f"CASE WHEN size({arr}) = 4 AND {whole} THEN {make_box(*parts)} END"


def decode_box(json: str) -> str:
    """Box stored as JSON text, either an object or a list of four numbers."""
    s = f"from_json({json}, '{BBOX}')"
    complete = " AND ".join(f"{s}.{c} IS NOT NULL" for c in CORNERS)
    listed = box_from_array(f"from_json({json}, 'ARRAY<DOUBLE>')")
    return f"CASE WHEN ltrim({json}) LIKE '[%' THEN {listed} WHEN {complete} THEN {s} END"


def union_box(boxes: str) -> str:
    """Smallest box around the non-NULL ones of an array; NULL when none."""
    low = lambda n: f"array_min(transform({boxes}, b -> b.{n}))"
    high = lambda n: f"array_max(transform({boxes}, b -> b.{n}))"
    box = make_box(low("x1"), low("y1"), high("x2"), high("y2"))
    return f"CASE WHEN exists({boxes}, b -> b IS NOT NULL) THEN {box} END"


def rescale_box(box: str, target_width: str, source_width: str) -> str:
    """Placement of a box on an image shown at another width.

    Width and height never fall below one; an unknown source width gives zeros.
    """
    scale = f"({target_width}) / nullif(CAST({source_width} AS DOUBLE), 0)"
    size = lambda a, b: f"greatest(1D, ({box}.{b} - {box}.{a}) * {scale})"
    cells = {
        "left": f"{box}.x1 * {scale}", "top": f"{box}.y1 * {scale}",
        "width": size("x1", "x2"), "height": size("y1", "y2"),
    }
    known = f"coalesce({source_width}, 0) <> 0"
    return "named_struct(" + ", ".join(
        f"'{n}', CASE WHEN {known} THEN {e} ELSE 0D END" for n, e in cells.items()
    ) + ")"
