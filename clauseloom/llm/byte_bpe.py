"""Byte-level BPE: encoding of long texts in overlapping chunks, and decoding."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clauseloom.llm.shared import ship

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Longer texts are cut into chunks of so many characters, each with the first OVERLAP of the next.
CHUNK, OVERLAP = 32_768, 512
#: Characters at a chunk's end on which the pattern's look-ahead may depend.
MARGIN = 4
#: Pre-token encodings that a Python worker remembers before it starts anew.
REMEMBERED = 300_000


class Coder:
    """Ids of single pre-tokens by rank, remembered, and bytes of ids."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.merges = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.pieces: dict[str, bytes] = {}
        self.table = np.empty(max(ranks.values()) + 1, object)
        for data, rank in ranks.items():
            self.table[rank] = data

    def pre_tokens(self, text: str, start: int = 0) -> Iterator[tuple[int, str]]:
        for found in self.pattern.finditer(text, start):
            yield found.start(), found.group()

    def ids(self, pieces: list[str]) -> bytes:
        """Little-endian int32 ids of pre-tokens, each merged on its own."""
        known = self.pieces
        if len(known) > REMEMBERED:
            known.clear()
        for piece in {p for p in pieces if p not in known}:
            known[piece] = np.array(self.merges._encode_single_piece(piece.encode("utf-8", "replace")), "<i4").tobytes()
        return b"".join(map(known.__getitem__, pieces))

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(self.table[ids].tolist())


_CODERS: dict[str, Coder] = {}  # one for each Python worker


def _coder(path: str) -> Coder:
    if path not in _CODERS:
        _CODERS[path] = Coder(path)
    return _CODERS[path]


def _lists(parts: list[bytes]) -> pa.Array:
    offsets = np.cumsum([0, *(len(p) // 4 for p in parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(parts), "<i4")))


def _whole(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(path)
        for batch in batches:
            parts = [coder.ids(coder.pattern.findall(t.as_py() or "")) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(parts)], ["doc_id", "ids"])

    return run


CUT = "doc_id long, doc string, copies long, i int, start long, last boolean, text string"


def _cut(chunk: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for row, text in enumerate(batch.column(1)):
                text = text.as_py()
                for i, start in enumerate(range(0, len(text), chunk)):
                    at.append(row)
                    rows.append((i, start, start + chunk >= len(text), text[start : start + chunk + overlap]))
            take = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k).take(take) for k in (0, 2, 3)), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()),
                 pa.array([r[2] for r in rows], pa.bool_()), pa.array([r[3] for r in rows], pa.string())], ["doc_id", "doc", "copies", "i", "start", "last", "text"])

    return run


def boundaries(coder: Coder, text: str, start: int, last: bool, chunk: int, overlap: int) -> tuple[list[int], list[int]]:
    """Places where a pre-token starts in the overlap with the chunk before and in that with the next, as far as
    they can't depend on what follows the chunk."""
    trusted = len(text) if last else len(text) - MARGIN
    at = [k for k, _ in coder.pre_tokens(text) if k < overlap or k >= chunk]
    head = [start + k for k in at if k < overlap and k <= trusted]
    return head, [start + k for k in at if chunk <= k <= trusted]


def _bounded(path: str, chunk: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(path)
        for batch in batches:
            found = [boundaries(coder, t.as_py(), s.as_py(), e.as_py(), chunk, overlap) for s, e, t in zip(*(batch.column(k) for k in (4, 5, 6)), strict=True)]
            both = [pa.array([f[k] for f in found], pa.list_(pa.int64())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *both], ["doc_id", "doc", "copies", "i", "start", "last", "text", "head", "tail"])

    return run


def _between(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(path)
        for batch in batches:
            parts = []
            for start, first, stop, text in zip(*(batch.column(k) for k in (4, 5, 6, 7)), strict=True):
                start, stop, pieces = start.as_py(), stop.as_py(), []
                for k, piece in coder.pre_tokens(text.as_py(), first.as_py() - start):
                    if stop is not None and start + k >= stop:
                        break
                    pieces.append(piece)
                parts.append(coder.ids(pieces))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(4)), _lists(parts)], ["doc_id", "doc", "copies", "i", "ids"])

    return run


def encode(docs: DataFrame, ranks: str = RANKS, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, ids array<int>) for every row: each match of the pattern is merged by rank, without special tokens.

    A text of more than ``chunk`` characters is cut into overlapping chunks, which are pre-tokenised in parallel. Two
    neighbours are stitched at the first place in their overlap where both start a pre-token: the pattern looks only
    ahead, so from there on they agree. Each chunk then encodes from its own stitch to the next. A text with a
    stitch that can't be found (a pre-token longer than the overlap) is pre-tokenised whole. Null and empty texts
    have no ids; repeated rows give repeated results; null ids are kept; an empty table gives an empty result.
    """
    ship(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    is_long = F.coalesce(F.length("text"), F.lit(0)) > chunk
    short = own.where(~is_long).mapInArrow(_whole(ranks), "doc_id long, ids array<int>")
    texts = own.where(is_long).groupBy("doc_id", "text").agg(F.count("*").alias("copies")).select("doc_id", "text", F.md5("text").alias("doc"), "copies")
    chunks = texts.mapInArrow(_cut(chunk, overlap), CUT).repartition("doc_id", "doc", "i")
    chunks = chunks.mapInArrow(_bounded(ranks, chunk, overlap), CUT + ", head array<bigint>, tail array<bigint>")
    row = Window.partitionBy("doc_id", "doc")
    before = F.lag("tail").over(row.orderBy("i"))
    stitch = F.when(F.col("i") == 0, F.lit(0).cast("long")).otherwise(F.array_min(F.array_intersect("head", before)))
    stitched = chunks.withColumn("first", stitch)
    stitched = stitched.withColumn("stop", F.lead("first").over(row.orderBy("i"))).withColumn("lost", F.max(F.col("first").isNull()).over(row))
    parts = stitched.where(~F.col("lost")).select("doc_id", "doc", "copies", "i", "start", "first", "stop", "text")
    parts = parts.mapInArrow(_between(ranks), "doc_id long, doc string, copies long, i int, ids array<int>")
    joined = parts.groupBy("doc_id", "doc", "copies").agg(F.array_sort(F.collect_list(F.struct("i", "ids"))).alias("parts"))
    joined = joined.select("doc_id", "copies", F.flatten("parts.ids").alias("ids"))
    lost = stitched.where("lost").groupBy("doc_id", "doc", "copies").agg(F.array_sort(F.collect_list(F.struct("i", F.substring("text", 1, chunk).alias("text")))).alias("parts"))
    lost = lost.select("doc_id", "copies", F.array_join("parts.text", "").alias("text"))
    lost = lost.select("doc_id", "text", F.explode(F.expr("sequence(1L, copies)"))).select("doc_id", "text")
    whole = lost.mapInArrow(_whole(ranks), "doc_id long, ids array<int>")
    copied = joined.select("doc_id", "ids", F.explode(F.expr("sequence(1L, copies)"))).select("doc_id", "ids")
    return short.unionByName(copied).unionByName(whole)


def decode(encoded: DataFrame, ranks: str = RANKS) -> DataFrame:
    """(doc_id, ids, decoded): the bytes of the ids, one after the other; null ids decode to no bytes."""
    ship(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(ranks)
        for batch in batches:
            out = [coder.decode(x.values.to_numpy()) if x.is_valid else b"" for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded binary")
