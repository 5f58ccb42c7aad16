"""Line de-duplication over levelled sorted runs of line hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauseloom.llm.shared import ASCII_LOWER, Scratch, text_key

#: Sets of frequent line keys up to this many rows (16 bytes each) go to every task; larger ones are joined.
BROADCAST_KEYS = 1 << 18


def line_keys(text: str | None) -> tuple[list[bytes], list[bytes]]:
    """The lines of a text and the 128-bit digests of their keys; a line with an empty key has digest b''."""
    lines = (text or "").encode("utf-8", "surrogatepass").split(b"\n")
    keys = [x.strip().translate(ASCII_LOWER) for x in lines]  # bytes.strip() takes exactly 0x20 and 0x09-0x0D
    return lines, [xxhash.xxh3_128_digest(k) if k else b"" for k in keys]


def _numbers(digests: list[bytes]) -> list[np.ndarray]:
    pairs = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
    return [np.ascontiguousarray(pairs[:, 0]), np.ascontiguousarray(pairs[:, 1])]


def _distinct_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        run, found = [], []
        for at, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            own = {k for k in line_keys(text.as_py())[1] if k}
            found.extend(own)
            run.extend([at] * len(own))
        h1, h2 = _numbers(found)
        yield pa.RecordBatch.from_arrays([pa.array(run, pa.int32()), pa.array(h1), pa.array(h2)], ["run", "h1", "h2"])


class LineRuns:
    """Sorted runs (h1, h2, n) in levels; ``fanout`` runs of a level are compacted into one run of the next.

    n counts documents and a key's count is the sum over all runs, so a batch is one append and nothing earlier
    is rewritten until its level is full. Compaction moves the keys that have reached ``min_docs`` into settled
    runs; every later batch is merge-anti-joined with those before it is added, for a settled key needs no more
    counting. The runs are tables of the shared folder.
    """

    def __init__(self, scratch: Scratch, min_docs: int, fanout: int = 4):
        self.scratch, self.min_docs, self.fanout, self.made = scratch, min_docs, fanout, 0
        self.levels: list[list[tuple[str, DataFrame]]] = []
        self.settled: list[DataFrame] = []

    def unsettled(self, keys: DataFrame) -> DataFrame:
        """The rows (h1, h2, ...) of a batch whose key is in no settled run."""
        for run in self.settled:
            keys = keys.join(run.hint("merge"), ["h1", "h2"], "left_anti")
        return keys

    def add(self, run: DataFrame, table: str, level: int = 0) -> None:
        """Take the stored sorted run of one batch, then compact the levels that are full."""
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append((table, self.unsettled(run)))
        if len(self.levels[level]) < self.fanout:
            return
        full, self.levels[level] = self.levels[level], []
        self.made += 1
        merged = self.scratch.keep(_sum([r for _, r in full]).sortWithinPartitions("h1", "h2"), f"run-{self.made}")
        for old, _ in full:
            self.scratch.drop(old)
        self.settled.append(merged.where(F.col("n") >= self.min_docs).select("h1", "h2"))
        self.add(merged.where(F.col("n") < self.min_docs), f"run-{self.made}-{level + 1}", level + 1)

    def frequent(self) -> DataFrame:
        """The keys (h1, h2) of at least ``min_docs`` documents, each once."""
        left = [run for level in self.levels for _, run in level]
        found = _sum(left).where(F.col("n") >= self.min_docs).select("h1", "h2")
        for run in self.settled:
            found = found.unionByName(run)
        return found


def _sum(runs: list[DataFrame]) -> DataFrame:
    both = runs[0]
    for run in runs[1:]:
        both = both.unionByName(run)
    return both.groupBy("h1", "h2").agg(F.sum("n").alias("n"))


def count_runs(docs: DataFrame, scratch: Scratch, min_docs: int, batches: int = 8, fanout: int = 4) -> LineRuns:
    """Runs over ``docs``: the documents arrive in ``batches`` batches, each adding its own sorted run."""
    runs = LineRuns(scratch, min_docs, fanout)
    run = F.pmod(F.xxhash64("doc_id", text_key()), F.lit(batches)).cast("int").alias("run")
    found = docs.select(run, "text").mapInArrow(_distinct_keys, "run int, h1 long, h2 long")
    counted = found.groupBy("run", "h1", "h2").agg(F.count("*").alias("n")).sortWithinPartitions("run", "h1", "h2")
    stored = scratch.keep(counted, "batches", "run")
    for i in range(batches):
        runs.add(stored.where(F.col("run") == i).select("h1", "h2", "n"), f"batches/run={i}")
    return runs


OUT = "n_lines long, n_dropped long, text string"


def _dropped(texts: list[str | None], gone: list[set[bytes]]) -> tuple[list[int], list[int], list[bytes]]:
    total, dropped, kept = [], [], []
    for text, out in zip(texts, gone, strict=True):
        lines, keys = line_keys(text)
        left = [x for x, k in zip(lines, keys, strict=True) if not k or k not in out]
        total.append(len(lines))
        dropped.append(len(lines) - len(left))
        kept.append(b"\n".join(left))
    return total, dropped, kept


def drop_lines(docs: DataFrame, frequent: DataFrame, scratch: Scratch) -> DataFrame:
    """The columns of ``docs`` with ``text`` replaced by the lines that stay, plus n_lines and n_dropped.

    Up to BROADCAST_KEYS keys are sent to every task. A larger set is joined to the keys of each document;
    the keys found come back as one list per document.
    """
    spark = docs.sparkSession
    frequent = scratch.keep(frequent, "frequent")
    columns = [c for c in docs.columns if c not in ("text", "n_lines", "n_dropped")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in columns)
    schema = f"{schema}, {OUT}" if columns else OUT
    if frequent.count() <= BROADCAST_KEYS:
        rows = frequent.toArrow()
        pairs = np.column_stack([rows.column(0).to_numpy(), rows.column(1).to_numpy()]).astype("<i8")
        known = spark.sparkContext.broadcast(pairs.tobytes())

        def by_set(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            data = known.value
            out = {data[i : i + 16] for i in range(0, len(data), 16)}
            for batch in batches:
                yield _rebuilt(batch, columns, [out] * batch.num_rows)

        return docs.select(*columns, "text").mapInArrow(by_set, schema)
    frequent = frequent.select("h1", "h2")
    keyed = docs.select("doc_id", text_key().alias("_tk"), "text").mapInArrow(_keys_of_rows, "doc_id long, tk binary, h1 long, h2 long")
    digest = F.struct("h1", "h2")
    per_doc = keyed.join(frequent, ["h1", "h2"], "left_semi").groupBy("doc_id", "tk").agg(F.collect_set(digest).alias("gone"))
    # the user's columns stay inside a struct, so that no name can clash
    rows = docs.select(F.struct(*columns, "text").alias("row"), F.col("doc_id").alias("id"), text_key().alias("key")).alias("d")
    rows = rows.join(per_doc.alias("p"), F.expr("d.id <=> p.doc_id AND d.key = p.tk"), "left").select("row", "gone")

    def by_list(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone = [
                {np.array([x["h1"], x["h2"]], "<i8").tobytes() for x in row or []}
                for row in batch.column(1).to_pylist()
            ]
            yield _rebuilt(pa.RecordBatch.from_struct_array(batch.column(0)), columns, gone)

    return rows.mapInArrow(by_list, schema)


def _keys_of_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, found = [], []
        for i, text in enumerate(batch.column(2)):
            own = {k for k in line_keys(text.as_py())[1] if k}
            found.extend(own)
            at.extend([i] * len(own))
        take = pa.array(at, pa.int32())
        h1, h2 = _numbers(found)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(take), batch.column(1).take(take), pa.array(h1), pa.array(h2)], ["doc_id", "tk", "h1", "h2"])


def _rebuilt(batch: pa.RecordBatch, columns: list[str], gone: list[set[bytes]]) -> pa.RecordBatch:
    total, dropped, kept = _dropped([x.as_py() for x in batch.column(len(columns))], gone)
    texts = pa.array(kept, pa.binary()).cast(pa.string())
    arrays = [batch.column(i) for i in range(len(columns))]
    return pa.RecordBatch.from_arrays([*arrays, pa.array(total, pa.int64()), pa.array(dropped, pa.int64()), texts],
                                      [*columns, "n_lines", "n_dropped", "text"])


def dedup_lines(docs: DataFrame, min_docs: int = 10, batches: int = 8, fanout: int = 4) -> DataFrame:
    """Remove from every document the lines whose key is found in at least ``min_docs`` documents.

    A line's key is the line stripped of 0x20 and 0x09-0x0D with A-Z lower-cased; empty keys are never removed.
    A document counts once for a key however often it repeats the line. Null text is one empty line; an empty
    table gives an empty result; rows that repeat a doc_id count as documents of their own; other columns are
    carried along (columns named n_lines or n_dropped are replaced).
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lines")
    runs = count_runs(docs, scratch, min_docs, batches, fanout)
    return drop_lines(docs, runs.frequent(), scratch)

