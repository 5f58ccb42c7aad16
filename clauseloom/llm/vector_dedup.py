"""Near-duplicate vectors: all pairs above a cosine, by dual traversal of cover trees."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauseloom.llm import vectors as vec
from clauseloom.llm.graph import components
from clauseloom.llm.shared import Scratch

#: Vectors that the upper tree is fitted on, and the most cells it may have.
FITTED, CELLS = 2048, 256
#: Vectors in a leaf, and centres tried for a level of a block's tree before the rest stays with its parent.
LEAF, TRIED = 64, 48
#: Rounding that distances from dot products of unit vectors may have; bounds are widened by it.
SLACK = 1e-6


def farthest_first(points: np.ndarray, most: int, radius: float) -> np.ndarray:
    """Rows of nested centres: each next one is the farthest from those before, until all lie within ``radius``.

    The first k of them cover the points within the distance of the k+1st, so halving radii cut the order into the
    levels of a cover tree.
    """
    chosen, gap = [0], 2 - 2 * points @ points[0]
    while len(chosen) < min(most, len(points)):
        at = int(np.argmax(gap))
        if gap[at] <= radius * radius:
            break
        chosen.append(at)
        gap = np.minimum(gap, 2 - 2 * points @ points[at])
    return np.array(chosen)


@dataclass
class CoverTree:
    """A block's unit vectors in tree order. A node is a range of them with a centre and a covering radius; its
    children cover it at half its radius, what they do not reach stays together as a last child."""

    points: np.ndarray
    order: np.ndarray = field(default=None)
    nodes: list[tuple[int, int, np.ndarray, float, list[int]]] = field(default_factory=list)

    def __post_init__(self):
        pieces: list[np.ndarray] = []
        self._add(np.arange(len(self.points)), self.points[0], pieces, 0)
        self.order = np.concatenate(pieces)
        self.points = np.ascontiguousarray(self.points[self.order])

    def _add(self, rows: np.ndarray, centre: np.ndarray, pieces: list[np.ndarray], start: int) -> int:
        own = self.points[rows]
        radius = float(np.sqrt(np.maximum(2 - 2 * own @ centre, 0).max())) + SLACK
        number = len(self.nodes)
        self.nodes.append(None)
        groups: list[tuple[np.ndarray, np.ndarray]] = []
        if len(rows) > LEAF and radius > 8 * SLACK:
            left = np.arange(len(rows))
            for _ in range(TRIED):
                if not len(left):
                    break
                at = own[left[0]]
                near = 2 - 2 * own[left] @ at <= (radius / 2) ** 2
                near[0] = True
                groups.append((left[near], at))
                left = left[~near]
            if len(left) > len(rows) // 2:
                groups = []  # hardly anything is near anything else: a level would not divide the node
            elif len(left):
                groups.append((left, centre))
        children, at = [], start
        if len(groups) > 1:
            for group, middle in groups:
                children.append(self._add(rows[group], middle, pieces, at))
                at += len(group)
        else:
            pieces.append(rows)
        self.nodes[number] = (start, start + len(rows), centre, radius, children)
        return number


def linked(a: CoverTree, b: CoverTree, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """All (row of a, row of b) in tree order with a cosine of at least ``cosine``; once each if both are one tree."""
    reach = np.sqrt(max(2 - 2 * cosine, 0)) + SLACK
    stack, xs, ys = [(0, 0)], [], []
    while stack:
        i, j = stack.pop()
        a0, a1, ca, ra, kids_a = a.nodes[i]
        b0, b1, cb, rb, kids_b = b.nodes[j]
        if np.sqrt(max(2 - 2 * float(ca @ cb), 0)) > reach + ra + rb or (a is b and a0 >= b1):
            continue
        if kids_a and (not kids_b or a1 - a0 >= b1 - b0):
            stack.extend((k, j) for k in kids_a)
        elif kids_b:
            stack.extend((i, k) for k in kids_b)
        else:
            for s in range(a0, a1, 1024):
                x, y = np.nonzero(a.points[s : min(a1, s + 1024)] @ b.points[b0:b1].T >= cosine - 1e-9)
                xs.append(x + s)
                ys.append(y + b0)
    x, y = (np.concatenate(v) if v else np.empty(0, np.int64) for v in (xs, ys))
    if a is b:
        keep = x < y
        x, y = x[keep], y[keep]
    return x, y


def _forest(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The smallest row joined to each of ``n`` rows by the links (x, y)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[x], label[y])
        before = label.copy()
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        label = label[label]
        if (label == before).all():
            return label


def _block():
    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("cls", ignore_index=True)
        return pd.DataFrame({"block": [key[0]], "cell": [frame["cell"][0]], "n": [len(frame)], "radius": [frame["gap"].max()],
                             "ids": [frame["cls"].to_numpy(np.int64).tobytes()], "copies": [frame["n"].to_numpy(np.int64).tobytes()], "payload": [vec.pack(frame)]})

    return run


def _compare(dim: int, cosine: float):
    def tree(ids, copies, payload):
        ids, copies = np.frombuffer(ids, "<i8"), np.frombuffer(copies, "<i8")
        raw = vec.unpack(payload, len(ids), dim)
        scale = np.abs(raw).max(axis=1, keepdims=True)
        unit = raw / scale
        made = CoverTree(unit / np.sqrt((unit * unit).sum(axis=1, keepdims=True)))
        return made, ids[made.order], copies[made.order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, a = None, None
        for batch in batches:
            for row in range(batch.num_rows):
                name_a, ids_a, copies_a, data_a, name_b, ids_b, copies_b, data_b = (batch.column(k)[row].as_py() for k in range(8))
                if name_a != last:
                    last, a = name_a, tree(ids_a, copies_a, data_a)
                b = a if name_a == name_b else tree(ids_b, copies_b, data_b)
                x, y = linked(a[0], b[0], cosine)
                close = np.flatnonzero(np.abs((a[0].points[x] * b[0].points[y]).sum(axis=1) - cosine) < 1e-8)
                if len(close):  # next to the limit: the cosine itself decides
                    keep = np.ones(len(x), bool)
                    keep[close] = (a[0].points[x[close]] * b[0].points[y[close]]).sum(axis=1) >= cosine
                    x, y = x[keep], y[keep]
                shift = 0 if b is a else len(a[1])
                ids = a[1] if b is a else np.concatenate([a[1], b[1]])
                links = np.bincount(x, b[2][y], len(ids)) + np.bincount(y + shift, a[2][x], len(ids))
                label = _forest(len(ids), x, y + shift)
                some = np.flatnonzero(links)
                yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(links[some].astype(np.int64)), pa.array(ids[label[some]])], ["a", "links", "b"])

    return run


def near_vectors(vectors: DataFrame, cosine: float = 0.9, block: int = vec.BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors`` (vec_id, embedding).

    Two vectors are linked if their cosine, in double precision, is at least ``cosine``; n_links counts all other
    rows linked directly, copies included; component_id is the smallest vec_id reachable. Equal vectors are one class
    with a number of copies, so copies never meet as pairs (classes are named by a 64-bit digest). The upper levels
    of the cover tree are centres at halving radii, fitted on a bounded sample; every class goes to its nearest one,
    cells of more than ``block`` classes are spread over blocks, and pairs of cells are pruned by their covering
    radii. For each pair of blocks left, one task builds both blocks' trees and descends them together; it returns
    a count and one edge to the smallest row joined for each class, never the pairs. Vectors that are null, empty,
    zero or hold null or non-finite components, and vectors of different lengths, link with nothing; rows that
    repeat are copies; a null vec_id takes part; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "vectors")
    rows = scratch.keep(vec.read(vectors), "rows")
    classes = scratch.keep(rows.where("cls is not null").groupBy("cls", "dim").agg(
        F.min("vec_id").alias("least"), F.count("*").alias("n"), F.min("data").alias("data")), "classes")
    edges = None
    for dim in [r["dim"] for r in classes.select("dim").distinct().collect()]:
        found = scratch.keep(_of_dimension(scratch, classes.where(F.col("dim") == dim), dim, cosine, block), f"links-{dim}")
        edges = found if edges is None else edges.unionByName(found)
    if edges is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    roots = components(scratch, edges.select("a", "b"))
    top = classes.join(roots.select(F.col("node").alias("cls"), "root"), "cls", "left").select("cls", "least", "n", F.coalesce("root", "cls").alias("root"))
    top = scratch.keep(top, "roots")
    least = top.groupBy("root").agg(F.min("least").alias("component_id"))
    counted = edges.groupBy("a").agg(F.sum("links").alias("links")).select(F.col("a").alias("cls"), "links")
    result = top.join(least, "root").join(counted, "cls", "left")
    result = scratch.keep(result.select("cls", "component_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")), "result")
    own = F.when(F.col("cls").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    out = rows.select("vec_id", "cls").join(result, "cls", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), own.eqNullSafe(F.col("vec_id")).alias("kept"))


def _of_dimension(scratch: Scratch, classes: DataFrame, dim: int, cosine: float, block: int) -> DataFrame:
    """(a, links, b): links of class a within a pair of blocks, and the class it is joined to there."""
    spark = scratch.spark
    fitted = vec.matrix([r["data"] for r in vec.sample(classes, FITTED)], dim)
    fitted = fitted / np.abs(fitted).max(axis=1, keepdims=True)
    fitted = fitted / np.sqrt((fitted * fitted).sum(axis=1, keepdims=True))
    wanted = min(CELLS, max(1, -(-classes.count() // block)))
    centres = fitted[farthest_first(fitted, wanted, np.sqrt(max(2 - 2 * cosine, 0)))]
    sent = spark.sparkContext.broadcast(centres)  # CELLS vectors at most

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = vec.matrix(batch.column(2).to_pylist(), dim)
            x = x / np.abs(x).max(axis=1, keepdims=True) if len(x) else x
            dots = (x / np.sqrt((x * x).sum(axis=1, keepdims=True))) @ sent.value.T
            cell = np.argmax(dots, axis=1) if len(x) else np.empty(0, np.int64)
            gap = np.sqrt(np.maximum(2 - 2 * dots[np.arange(len(x)), cell], 0)) + SLACK
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(gap)], ["cls", "n", "data", "cell", "gap"])

    placed = scratch.keep(classes.select("cls", "n", "data").mapInArrow(assign, "cls long, n long, data binary, cell int, gap double"), f"placed-{dim}")
    cells = {r["cell"]: (r["n"], r["gap"]) for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("gap").alias("gap")).collect()}
    number = vec.salted(F.col("cell"), F.col("cls"), {c: n for c, (n, _) in cells.items()}, block)
    shape = "block long, cell int, n long, radius double, ids binary, copies binary, payload binary"
    blocks = scratch.keep(placed.withColumn("block", number).groupBy("block").applyInPandas(_block(), shape), f"blocks-{dim}")
    scratch.drop(f"placed-{dim}")
    apart = np.sqrt(np.maximum(2 - 2 * centres @ centres.T, 0))
    reach = np.sqrt(max(2 - 2 * cosine, 0)) + SLACK
    near = [(a, b) for a in cells for b in cells if a <= b and apart[a, b] <= reach + cells[a][1] + cells[b][1]]
    names = blocks.select("block", "cell")
    pairs = spark.createDataFrame(near, "ca int, cb int").join(names.select(F.col("cell").alias("ca"), F.col("block").alias("a")), "ca")
    pairs = pairs.join(names.select(F.col("cell").alias("cb"), F.col("block").alias("b")), "cb").where("ca < cb or a <= b").select("a", "b")
    sides = ["ids", "copies", "payload"]
    left = blocks.select(F.col("block").alias("a"), *[F.col(c).alias(f"{c}_a") for c in sides])
    right = blocks.select(F.col("block").alias("b"), *[F.col(c).alias(f"{c}_b") for c in sides])
    both = pairs.join(left, "a").join(right, "b").select("a", "ids_a", "copies_a", "payload_a", "b", "ids_b", "copies_b", "payload_b")
    return both.mapInArrow(_compare(dim, cosine), "a long, links long, b long")
