"""Removal of repeated byte passages by distributed prefix doubling over synchronised positions.

Ranking every byte position in every round would move some 16 bytes a position, many times the text. So only one
position in about a hundred is sorted at first: the anchor of a window of ``length`` bytes is the leftmost least
hash among its half-length substrings, which equal windows share wherever they stand. A node stands for the windows
of one document that share an anchor. Each round names the bytes common to all windows of a node, at growing offsets
round the anchor; Spark groups the names, nodes with a unique name are dropped, nodes equal as a whole are settled,
and the others are split, their windows compared over a longer common part, until single windows, the full length,
are left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauseloom.llm.shared import Scratch, text_key

#: Windows that a task handles at once, and windows in a node after each split.
SEGMENT, SPLITS = 1 << 19, (16, 1)

_RANDOM = np.random.default_rng(400)
_TABLES = _RANDOM.integers(0, 1 << 63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (a fixed xor-shift-multiply finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of the two odd bases and of their inverses modulo 2^64, as far as needed."""

    def __init__(self):
        self.up = self.down = np.empty((2, 0), np.uint64)

    def reach(self, n: int) -> None:
        if self.up.shape[1] < n:
            rows = [[b, pow(b, -1, 1 << 64)] for b in _BASES]
            grown = [[np.multiply.accumulate(np.r_[np.uint64(1), np.full(n - 1, x, np.uint64)]) for x in pair] for pair in rows]
            self.up, self.down = np.array([g[0] for g in grown]), np.array([g[1] for g in grown])


_POWERS = _Powers()


class _Hashes:
    """Polynomial hashes of any substrings of a buffer, from prefix sums."""

    def __init__(self, buffer: np.ndarray):
        n = len(buffer)
        _POWERS.reach(n + 1)
        self.sums = [np.concatenate(([np.uint64(0)], np.cumsum(_TABLES[k][buffer] * _POWERS.up[k, :n]))) for k in (0, 1)]

    def names(self, k: int, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[k][stop] - self.sums[k][start]) * _POWERS.down[k, start] + (stop - start).astype(np.uint64))


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least value of each run of ``width`` neighbours, from block-wise minima of both directions."""
    n = len(x) - width + 1
    padded = np.concatenate((x, np.full(-len(x) % width, np.iinfo(np.uint64).max, np.uint64))).reshape(-1, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    back = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def _segments(texts: list[memoryview], length: int) -> Iterator[list[tuple[int, int, int]]]:
    """Groups of (row, first window, windows) of about SEGMENT windows."""
    group, size = [], 0
    for row, text in enumerate(texts):
        first, windows = 0, len(text) - length + 1
        while windows > 0:
            take = min(windows, SEGMENT - size)
            group.append((row, first, take))
            first, windows, size = first + take, windows - take, size + take + length
            if size >= SEGMENT - length:
                yield group
                group, size = [], 0
    if group:
        yield group


def anchors(texts: list[memoryview], length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Nodes of the first round, in parts: row, anchor position, least and most offset of its windows, core and whole name."""
    core = length // 2
    for group in _segments(texts, length):
        buffer = np.frombuffer(b"".join(texts[r][s : s + n + length - 1] for r, s, n in group), np.uint8)
        hashes = _Hashes(buffer)
        at = np.arange(len(buffer) - core + 1)
        order = (hashes.names(0, at, at + core) & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
        chosen = (_sliding_min(order, length - core + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        starts = np.cumsum([0, *(n + length - 1 for _, _, n in group)])[:-1]
        window = np.concatenate([np.arange(b, b + n) for b, (_, _, n) in zip(starts, group, strict=True)])
        source = np.repeat(np.arange(len(group)), [n for _, _, n in group])
        anchor = chosen[window]
        first = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (source[1:] != source[:-1])])
        last = np.r_[first[1:], len(anchor)] - 1
        low, high, a, seg = window[first], window[last], anchor[first], source[first]
        shift = np.array([s for _, s, _ in group])[seg] - starts[seg]
        least, most = a - high, a - low
        whole = _mixed(hashes.names(1, low, high + length) + (most * length + least).astype(np.uint64))
        yield np.array([r for r, _, _ in group])[seg], a + shift, least, most, hashes.names(0, a, a + core), whole


def split_nodes(text: memoryview, nodes: np.ndarray, length: int, size: int) -> Iterator[tuple[np.ndarray, ...]]:
    """The parts of ``size`` window offsets of nodes (anchor, least, most) of one text, with their names."""
    nodes = nodes[np.argsort(nodes[:, 0], kind="stable")]
    start = 0
    while start < len(nodes):
        stop = max(start + 1, int(np.searchsorted(nodes[:, 0], nodes[start, 0] + SEGMENT)))
        a, least, most = nodes[start:stop].T
        base = int((a - most).min())
        hashes = _Hashes(np.frombuffer(text[base : int((a - least).max()) + length], np.uint8))
        parts = most // size - least // size + 1
        own = np.repeat(np.arange(len(a)), parts)
        group = np.arange(len(own)) - np.repeat(np.cumsum(parts) - parts, parts) + (least // size)[own]
        lo, hi, at = np.maximum(least[own], group * size), np.minimum(most[own], group * size + size - 1), a[own]
        left = at - group * size - base
        core = _mixed(hashes.names(0, left, left - size + 1 + length) + group.astype(np.uint64))
        whole = _mixed(hashes.names(1, at - hi - base, at - lo - base + length) + (hi * length + lo).astype(np.uint64))
        yield at, lo, hi, core, whole
        start = stop


NODE = "doc_id long, tk binary, a long, lo int, hi int, core long, whole long"
_NAMES = ["doc_id", "tk", "a", "lo", "hi", "core", "whole"]


def _batch(batch: pa.RecordBatch, row: np.ndarray, a, lo, hi, core, whole) -> pa.RecordBatch:
    take = pa.array(row)
    return pa.RecordBatch.from_arrays(
        [batch.column(0).take(take), batch.column(1).take(take), pa.array(a.astype(np.int64)), pa.array(lo.astype(np.int32)),
         pa.array(hi.astype(np.int32)), pa.array(core.view(np.int64)), pa.array(whole.view(np.int64))], _NAMES)


def _bytes(column: pa.Array) -> list[memoryview]:
    return [memoryview(x.as_buffer()) if x.is_valid else memoryview(b"") for x in column.cast(pa.binary())]


def _first_nodes(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in anchors(_bytes(batch.column(2)), length):
                yield _batch(batch, *part)

    return run


def _next_nodes(length: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(_bytes(batch.column(2))):
                nodes = batch.column(3)[i].values
                nodes = np.stack([nodes.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3)], axis=1)
                for part in split_nodes(text, nodes, length, size):
                    yield _batch(batch, np.full(len(part[0]), i), *part)

    return run


def _same(df: DataFrame, marks: DataFrame, how: str) -> DataFrame:
    """Join rows of texts to what is known of them, null ids included."""
    marks = marks.withColumnsRenamed({"doc_id": "_id", "tk": "_tk"})
    return df.join(marks, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tk") == F.col("_tk")), how).drop("_id", "_tk")


def repeated_ranges(docs: DataFrame, scratch: Scratch, length: int) -> DataFrame:
    """(doc_id, tk, start, stop): byte ranges made of windows that start anywhere else too; they may overlap."""
    nodes = docs.select("doc_id", "tk", "text").mapInArrow(_first_nodes(length), NODE)
    found: DataFrame | None = None
    for turn, size in enumerate((*SPLITS, 0)):
        many = nodes.groupBy("core").agg(F.count("*").alias("n")).where("n > 1").select("core")
        many = scratch.keep(many, f"many-{turn}")  # stored, so that the join can split a core of many nodes
        nodes = scratch.keep(nodes.join(many, "core"), f"nodes-{turn}")
        wholes = nodes.groupBy("core", "whole").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "tk", "a", "lo", "hi")).alias("row"))
        wholes = scratch.keep(wholes, f"wholes-{turn}")
        scratch.drop(f"many-{turn}")
        settled = nodes.join(wholes.where("n > 1").select("core", "whole"), ["core", "whole"])
        ranges = settled.select("doc_id", "tk", F.expr("a - hi").alias("start"), F.expr(f"a - lo + {length}").alias("stop"))
        found = ranges if found is None else found.unionByName(ranges)
        if not size:
            return found
        unlike = wholes.groupBy("core").agg(F.count("*").alias("n")).where("n > 1").select("core")
        unlike = scratch.keep(unlike, f"unlike-{turn}")
        rows = wholes.join(unlike, "core").select("row.*")  # one node for each different whole
        listed = rows.groupBy("doc_id", "tk").agg(F.collect_list(F.struct("a", "lo", "hi")).alias("nodes"))
        nodes = _same(docs.select("doc_id", "tk", "text"), listed, "inner").select("doc_id", "tk", "text", "nodes")
        nodes = nodes.mapInArrow(_next_nodes(length, size), NODE)
    return found


def _merged(ranges: np.ndarray) -> np.ndarray:
    """Disjoint, non-touching ranges in order."""
    ranges = ranges[np.argsort(ranges[:, 0], kind="stable")]
    reach = np.maximum.accumulate(ranges[:, 1])
    first = np.flatnonzero(np.r_[True, ranges[1:, 0] > reach[:-1]])
    return np.stack([ranges[first, 0], reach[np.r_[first[1:] - 1, len(ranges) - 1]]], axis=1)


def remove_repeats(docs: DataFrame, length: int = 400, texts: bool = False) -> DataFrame:
    """The columns of ``docs`` but text, plus n_bytes, n_removed, n_spans and ``kept`` (the bytes that stay).

    Texts are UTF-8 bytes. A byte goes if a string of ``length`` bytes that covers it also starts at another place,
    in the same or another document; strings are judged on the input, overlaps count, and no match crosses a
    document. n_spans counts the maximal runs removed. With ``texts`` the result has ``text`` in place of kept:
    the bytes that stay without the broken characters at the cuts. Null and empty texts and texts shorter than
    ``length`` keep all; repeated rows and repeated ids count as documents of their own, null ids too; an empty
    table gives an empty result; columns of ``docs`` with the names added here are replaced.

    Names are pairs of independent 64-bit hashes. Ranges grow with the text of a document, never with a group.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "passages")
    last = "text" if texts else "kept"
    made = ["n_bytes", "n_removed", "n_spans", last]
    columns = [c for c in docs.columns if c != "text" and c not in made]
    own = docs.select("doc_id", text_key().alias("tk"), "text", F.struct(*columns, F.lit(0).alias("_")).alias("carried"))
    own = own.withColumn("doc_id", F.col("doc_id").cast("long"))
    ranges = repeated_ranges(own, scratch, length)
    listed = ranges.groupBy("doc_id", "tk").agg(F.collect_list(F.struct("start", "stop")).alias("ranges"))
    rows = _same(own, listed, "left").select("text", "ranges", "carried")
    carried = rows.schema["carried"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, text in enumerate(_bytes(batch.column(0))):
                held = batch.column(1)[i]
                spans = np.empty((0, 2), np.int64)
                if held.is_valid and len(held.values):
                    spans = _merged(np.stack([held.values.field(k).to_numpy(zero_copy_only=False) for k in (0, 1)], axis=1))
                edges = [0, *spans.ravel().tolist(), len(text)]
                kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                out.append((len(text), len(text) - len(kept), len(spans), kept.decode("utf-8", "ignore") if texts else kept))
            arrays = [pa.array([x[k] for x in out], pa.int64()) for k in range(3)]
            arrays.append(pa.array([x[3] for x in out], pa.string() if texts else pa.binary()))
            yield pa.RecordBatch.from_arrays([*arrays, batch.column(2)], [*made, "carried"])

    schema = f"n_bytes long, n_removed long, n_spans long, {last} {'string' if texts else 'binary'}, carried {carried}"
    return rows.mapInArrow(cut, schema).select(*[f"carried.`{c}`" for c in columns], *made)
