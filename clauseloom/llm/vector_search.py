"""Approximate nearest neighbours by largest inner product: an adaptive scan of dimensions within probed lists."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clauseloom.llm import vectors as vec
from clauseloom.llm.shared import Scratch

#: Vectors that lists and rotation are fitted on; rows of a list aimed at; the most lists; queries in a block.
FITTED, PER_LIST, LISTS, QUERIES = 8192, 2048, 1024, 256
#: Dimensions of a column block, and deviations that the hypothesis test allows: a candidate is dropped if its partial
#: distance, scaled up, exceeds the limit by more than TEST / sqrt(dimensions seen).
COLUMNS, TEST = 16, 2.5
#: Share of true neighbours of the fitted sample that the probed lists must hold.
AIM = 0.97


@dataclass
class Layout:
    """What every task needs: rotation, list centres and the norm all vectors are lifted to."""

    rotation: np.ndarray
    centres: np.ndarray
    norm: float
    probes: int

    def lifted(self, x: np.ndarray) -> np.ndarray:
        """Vectors with one component more, so that all have one norm and the largest inner product is the least distance."""
        rest = np.maximum(self.norm**2 - (x * x).sum(axis=1), 0)
        return np.concatenate([x, np.sqrt(rest)[:, None]], axis=1)

    def turned(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        lifted = np.concatenate([x, np.zeros((len(x), 1))], axis=1) if query else self.lifted(x)
        return lifted @ self.rotation

    def lists(self, x: np.ndarray, query: bool = False, most: int = 1) -> np.ndarray:
        """The ``most`` nearest lists of each vector, nearest first."""
        lifted = np.concatenate([x, np.zeros((len(x), 1))], axis=1) if query else self.lifted(x)
        apart = (self.centres**2).sum(axis=1) - 2 * lifted @ self.centres.T
        return np.argsort(apart, axis=1, kind="stable")[:, :most]


def fit(x: np.ndarray, norm: float, rows: int, wanted: int, seed: int = 5) -> Layout:
    """Lists by k-means on the fitted sample, and as many probes as hold AIM of the sample's own neighbours."""
    rng = np.random.default_rng(seed)
    dim = x.shape[1] + 1
    rotation, _ = np.linalg.qr(rng.normal(size=(dim, dim)))
    layout = Layout(rotation, np.zeros((1, dim)), norm, 1)
    points = np.unique(layout.lifted(x), axis=0)
    lists = min(LISTS, max(1, rows // PER_LIST), max(1, len(points) // 8))
    centres = points[rng.choice(len(points), lists, replace=False)]
    for _ in range(8):
        near = np.argmin((centres**2).sum(axis=1) - 2 * points @ centres.T, axis=1)
        n = np.bincount(near, minlength=lists)
        sums = np.stack([np.bincount(near, points[:, k], lists) for k in range(dim)], axis=1)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    layout.centres = centres
    queries = x[rng.choice(len(x), min(256, len(x)), replace=False)]
    at = layout.lists(x)[:, 0]
    order = layout.lists(queries, query=True, most=lists)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(lists)[None, :].repeat(len(queries), axis=0), axis=1)
    dots = queries @ x.T
    # neighbours as far down in the sample as the sample is a part of all rows, but the wanted number at least
    best = np.argsort(-dots, axis=1, kind="stable")[:, 1 : wanted + 1]
    needed = np.sort(np.take_along_axis(place, at[best], axis=1).ravel())
    layout.probes = int(needed[min(len(needed) - 1, int(np.ceil(AIM * len(needed))))]) + 1 if len(needed) else lists
    return layout


class Scan:
    """The rows of one block in rotated column blocks, nearest rows kept by exact inner product."""

    def __init__(self, layout: Layout, ids: np.ndarray, x: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.layout, self.ids, self.x = layout, ids[order], x[order]
        turned = layout.turned(self.x)
        cuts = range(0, turned.shape[1], COLUMNS)
        self.columns = [np.ascontiguousarray(turned[:, c : c + COLUMNS]) for c in cuts]
        self.width = turned.shape[1]

    def best(self, ids: np.ndarray, x: np.ndarray, k: int, limits: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query row, ids, scores) of up to ``k`` rows that score at least the query's limit."""
        turned = self.layout.turned(x, query=True)
        parts = [turned[:, c : c + COLUMNS] for c in range(0, self.width, COLUMNS)]
        first = self.columns[0]
        seen = (first**2).sum(axis=1) - 2 * parts[0] @ first.T + (parts[0] ** 2).sum(axis=1)[:, None]
        norms = (x * x).sum(axis=1) + self.layout.norm**2
        for q in range(len(ids)):
            some = np.arange(min(len(self.ids), 4 * k)) if limits[q] == -np.inf else np.empty(0, np.int64)
            limit = limits[q]
            if len(some) and len(some) == 4 * k:  # no limit yet: the k-th best of the first rows is one
                exact = np.sort((self.x[some] * x[q]).sum(axis=1)[self.ids[some] != ids[q]])
                limit = exact[-k] if len(exact) >= k else limit
            at = np.arange(len(self.ids))
            if limit > -np.inf:
                most = norms[q] - 2 * limit + 1e-9 * norms[q]
                part, done = seen[q], min(COLUMNS, self.width)
                for c in range(1, len(self.columns) + 1):
                    factor = (done / self.width) * (1 + TEST / np.sqrt(done)) ** 2 if done < self.width else 1.0
                    keep = part <= most * min(factor, 1.0) + 1e-9 * norms[q]
                    at, part = at[keep], part[keep]
                    if c == len(self.columns) or not len(at):
                        break
                    gap = self.columns[c][at] - parts[c][q]
                    part, done = part + np.einsum("ij,ij->i", gap, gap), min(done + COLUMNS, self.width)
            at = at[self.ids[at] != ids[q]]
            scores = (self.x[at] * x[q]).sum(axis=1)
            order = np.lexsort((self.ids[at], -scores))[:k]
            order = order[scores[order] >= limits[q]]
            yield q, self.ids[at[order]], scores[order]


def _packed(frame: pd.DataFrame) -> dict:
    return {"n": [len(frame)], "ids": [frame["vec_id"].to_numpy(np.int64).tobytes()], "payload": [vec.pack(frame)]}


def _block(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"block": [key[0]], "list": [frame["list"].iloc[0]], **_packed(frame)})


def _queries(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"list": [key[0]], **_packed(frame), "limits": [frame["limit"].to_numpy(float).tobytes()]})


def neighbours(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: for each query the ``k`` rows of ``vectors`` found with the largest inner product.

    Both have vec_id and embedding; a query's own vec_id is no candidate. Scores are inner products of the original
    vectors in double precision, ties go to the smaller vec_id, and a query with fewer candidates gets them all.
    Lists, rotation and the number of probes are fitted on a bounded sample; all rows are indexed. A list of more
    than one block's rows is spread over blocks. Every query first scans its nearest list, whose k-th score is its
    limit; then the other probed lists return only rows above it. Within a list the rotated vectors are scanned a
    column block at a time and dropped once their partial distance makes it unlikely that they reach the limit.
    Null, empty and zero vectors and those with null or non-finite components take no part, neither do vectors of
    another length than most of the sample; rows that repeat are candidates of their own, with their ids; rows with
    a null vec_id take no part. Empty tables give an empty result.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "search")
    schema = "query_id long, rank int, vec_id long, score double"
    rows = scratch.keep(vec.read(vectors).where("cls is not null and vec_id is not null"), "rows")
    fitted = vec.sample(rows, FITTED)
    if not fitted:
        return spark.createDataFrame([], schema)
    dims = sorted(r["dim"] for r in fitted)
    dim = dims[len(dims) // 2]
    rows = rows.where(F.col("dim") == dim)
    total = rows.agg(F.count("*").alias("n"), F.max("norm").alias("norm")).first()
    layout = fit(vec.matrix([r["data"] for r in fitted if r["dim"] == dim], dim), total["norm"], total["n"], k)
    sent = spark.sparkContext.broadcast(layout)  # LISTS centres at most

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = vec.matrix(batch.column(1).to_pylist(), dim)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sent.value.lists(x)[:, 0].astype(np.int32))], ["vec_id", "data", "list"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = vec.matrix(batch.column(1).to_pylist(), dim)
            found = sent.value.lists(x, query=True, most=sent.value.probes).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(found), pa.list_(pa.int32()))], ["vec_id", "data", "lists"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, scan = None, None
        for batch in batches:
            for row in range(batch.num_rows):
                block, n, ids, payload, m, q_ids, q_payload, limits = (batch.column(c)[row].as_py() for c in range(8))
                if block != last:
                    last, scan = block, Scan(sent.value, np.frombuffer(ids, "<i8"), vec.unpack(payload, n, dim))
                q_ids = np.frombuffer(q_ids, "<i8")
                out = list(scan.best(q_ids, vec.unpack(q_payload, m, dim), k, np.frombuffer(limits, "<f8")))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([np.full(len(i), q_ids[q]) for q, i, _ in out])), pa.array(np.concatenate([i for _, i, _ in out])),
                     pa.array(np.concatenate([s for _, _, s in out]))], ["query_id", "vec_id", "score"])

    placed = scratch.keep(rows.select("vec_id", "data").mapInArrow(assign, "vec_id long, data binary, list int"), "placed")
    sizes = {r["list"]: r["n"] for r in placed.groupBy("list").agg(F.count("*").alias("n")).collect()}
    number = vec.salted(F.col("list"), F.col("vec_id"), sizes)
    blocks = placed.withColumn("block", number).groupBy("block").applyInPandas(_block, "block long, list int, n long, ids binary, payload binary")
    blocks = scratch.keep(blocks, "blocks")
    scratch.drop("placed")
    asked = vec.read(queries).where("cls is not null and vec_id is not null").where(F.col("dim") == dim).dropDuplicates(["vec_id"]).select("vec_id", "data")
    asked = scratch.keep(asked.mapInArrow(probe, "vec_id long, data binary, lists array<int>"), "asked")
    groups = max(1, -(-asked.count() // QUERIES))

    def scanned(probes: DataFrame) -> DataFrame:
        """``probes``: vec_id, data, limit, list."""
        group = F.pmod(F.xxhash64("vec_id"), F.lit(groups))
        packs = probes.groupBy("list", group.alias("part")).applyInPandas(_queries, "list int, n long, ids binary, payload binary, limits binary")
        packs = packs.select("list", F.col("n").alias("m"), F.col("ids").alias("q_ids"), F.col("payload").alias("q_payload"), "limits")
        both = blocks.join(packs, "list").select("block", "n", "ids", "payload", "m", "q_ids", "q_payload", "limits")
        return both.mapInArrow(search, "query_id long, vec_id long, score double")

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    near = asked.select("vec_id", "data", F.lit(float("-inf")).alias("limit"), F.col("lists")[0].alias("list"))
    near = scratch.keep(scanned(near).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "near")
    limits = near.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("limit"))
    rest = asked.select("vec_id", "data", F.explode(F.slice("lists", 2, max(1, layout.probes))).alias("list")).join(limits, "vec_id", "left")
    rest = rest.select("vec_id", "data", F.coalesce("limit", F.lit(float("-inf"))).alias("limit"), "list")
    found = near.select("query_id", "vec_id", "score").unionByName(scanned(rest))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
