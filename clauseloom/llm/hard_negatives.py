"""Hard negatives of labelled vectors: inner-product search in cover trees over norm-augmented candidates."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clauseloom.llm.shared import Scratch

#: Vectors that the upper tree's centres are chosen among, and the most cells; cells follow the row count up to then.
FITTED, CELLS = 8192, 2048
#: Candidates of a block, anchors of a group, and blocks that one task searches for one group.
BLOCK, GROUP, TILE = 4096, 8192, 16
#: Candidates of a leaf, and the most children of a node; a node that halving the radius divides no better is a leaf.
LEAF, CHILDREN = 128, 64
#: Scores compared at a time.
CELLS_AT_ONCE = 1 << 21
#: Vectors of a larger norm take no part, since their scores need not fit a long.
LARGEST_NORM = 2.0**31
#: Below and above all scores.
NONE, EVERY = -(1 << 62) - 1, 1 << 62

ROW = "vec_id long, label long, dim int, data binary, square double, anchor boolean"


def read(vectors: DataFrame, scale: float, anchors: str) -> DataFrame:
    """(vec_id, label, dim, data, square, anchor) of the rows that take part; data are the scaled floors as int32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, data, square, dim = [], [], [], []
            for i, x in enumerate(batch.column(2)):
                if not x.is_valid or x.values.null_count or not len(x.values):
                    continue
                v = x.values.to_numpy(zero_copy_only=False).astype(np.float64)
                with np.errstate(over="ignore", invalid="ignore"):
                    q = np.floor(scale * v)
                    own = float((q * q).sum())
                if np.isfinite(v).all() and own < LARGEST_NORM**2:
                    at.append(i)
                    data.append(q.astype("<i4").tobytes())
                    square.append(own)
                    dim.append(len(v))
            take = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), pa.array(dim, pa.int32()), pa.array(data, pa.binary()),
                 pa.array(square, pa.float64()), batch.column(3).take(take)], ["vec_id", "label", "dim", "data", "square", "anchor"])

    own = vectors.where("vec_id is not null and label is not null")
    return own.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), "embedding", F.coalesce(F.expr(anchors), F.lit(False)).alias("a")).mapInArrow(run, ROW)


def integers(data: list[bytes], dim: int) -> np.ndarray:
    """Packed vectors as rows of whole numbers."""
    return np.frombuffer(b"".join(data), "<i4").reshape(-1, dim).astype(np.float64)


def on_sphere(x: np.ndarray, top: float) -> np.ndarray:
    """Candidates with one more component, which brings all to the norm ``top``; then scaled to unit length."""
    if top == 0:
        return np.hstack([np.zeros_like(x), np.ones((len(x), 1))])
    rest = np.sqrt(np.maximum(top * top - (x * x).sum(axis=1, keepdims=True), 0))
    out = np.hstack([x, rest]) / top
    return out / np.sqrt((out * out).sum(axis=1, keepdims=True))


def bounds(cosine: np.ndarray, radius: np.ndarray, length: np.ndarray, top: float) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of an anchor of norm ``length`` with anything within the angle ``radius`` of
    a centre on the sphere of radius ``top``, given the anchor's cosine with the centre."""
    angle, size = np.arccos(np.clip(cosine, -1, 1)), length * top
    slack = 1e-7 * size + 1e-6  # arccos and cos round; scores are whole numbers
    return size * np.cos(np.minimum(np.pi, angle + radius)) - slack, size * np.cos(np.maximum(0, angle - radius)) + slack


@dataclass
class Tree:
    """A cover tree over a block. Nodes of a level cover their rows within an angle that belongs to the level's chord;
    their children cover them within half the chord, and a node's centre is the centre of its first child too. A
    node is a range of the rows in tree order."""

    rows: np.ndarray
    top: float
    order: np.ndarray = field(default=None)
    centres: list[np.ndarray] = field(default_factory=list)
    radii: list[float] = field(default_factory=list)
    ranges: list[tuple[int, int]] = field(default_factory=list)
    children: list[list[int]] = field(default_factory=list)

    def __post_init__(self):
        unit = on_sphere(self.rows, self.top)
        stack, pieces, at = [(np.arange(len(unit)), unit[0], -1)], [], 0
        while stack:
            own, centre, parent = stack.pop()
            chord = np.sqrt(max(float((2 - 2 * unit[own] @ centre).max()), 0.0))
            number = len(self.centres)
            self.centres.append(centre)
            self.radii.append(2 * np.arcsin(min(1.0, chord / 2)) + 1e-7)
            self.ranges.append((at, at + len(own)))
            self.children.append([])
            if parent >= 0:
                self.children[parent].append(number)
            parts = self._halved(unit, own, centre, chord) if len(own) > LEAF else []
            if parts:
                stack.extend((part, middle, number) for part, middle in reversed(parts))
            else:
                pieces.append(own)
                at += len(own)
        self.order = np.concatenate(pieces)
        self.rows = np.ascontiguousarray(self.rows[self.order])
        self.centres, self.radii = np.array(self.centres), np.array(self.radii)

    @staticmethod
    def _halved(unit: np.ndarray, own: np.ndarray, centre: np.ndarray, chord: float) -> list[tuple[np.ndarray, np.ndarray]]:
        """The rows covered within half the chord by a few of them; what those do not cover is the last part. Nothing
        if that is most."""
        reach, parts, first, n = chord / 2, [], centre, len(own)
        while len(own) and chord > 1e-6:
            near = 2 - 2 * unit[own] @ centre <= reach * reach
            if near.any():
                parts.append((own[near], centre))
                own = own[~near]
            if len(parts) == CHILDREN and len(own):
                return [*parts, (own, first)] if 2 * len(own) < n else []
            centre = unit[own[0]] if len(own) else centre
        return parts if len(parts) > 1 else []


@dataclass
class Anchors:
    """A group of anchors, the windows of scores each one looks in, and the best ``k`` found of each window."""

    rows: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    low: np.ndarray
    high: np.ndarray
    same: bool
    k: int

    def __post_init__(self):
        n, windows = self.low.shape
        self.length = np.sqrt((self.rows * self.rows).sum(axis=1))
        self.unit = self.rows / np.maximum(self.length, 1e-300)[:, None]
        self.scores = np.full((n, windows, self.k), NONE)
        self.found = np.full((n, windows, self.k), np.iinfo(np.int64).max)
        self.low = self.low.copy()  # rises to the k-th best

    def alive(self, some: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Those of ``some`` for which a range of scores meets a window."""
        return ((most[:, None] >= self.low[some]) & (least[:, None] <= self.high[some])).any(axis=1)

    def verify(self, some: np.ndarray, rows: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> None:
        """Exact scores of a leaf."""
        step = max(1, CELLS_AT_ONCE // max(1, len(ids)))
        for i in range(0, len(some), step):
            own = some[i : i + step]
            score = products(self.rows[own], rows)
            fits = (self.labels[own][:, None] == labels) if self.same else (self.labels[own][:, None] != labels)
            fits &= self.ids[own][:, None] != ids
            for window in range(self.low.shape[1]):
                x, y = np.nonzero(fits & (score >= self.low[own, window][:, None]) & (score <= self.high[own, window][:, None]))
                if len(x):
                    self._merge(own, window, x, score[x, y].astype(np.int64), ids[y])

    def _merge(self, own: np.ndarray, window: int, x: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        hit = np.unique(x)
        at = np.concatenate([x, np.repeat(hit, self.k)])
        score = np.concatenate([score, self.scores[own[hit], window].ravel()])
        ids = np.concatenate([ids, self.found[own[hit], window].ravel()])
        order = np.lexsort((ids, -score, at))
        at, score, ids = at[order], score[order], ids[order]
        starts = np.searchsorted(at, hit)  # each has k rows at least
        best = starts[:, None] + np.arange(self.k)
        self.scores[own[hit], window], self.found[own[hit], window] = score[best], ids[best]
        self.low[own[hit], window] = np.maximum(self.low[own[hit], window], score[best[:, -1]])

    def results(self) -> pd.DataFrame:
        x, window, rank = np.nonzero(self.scores > NONE)
        return pd.DataFrame({"at": x.astype(np.int32), "win": window.astype(np.int32), "other": self.found[x, window, rank], "score": self.scores[x, window, rank]})


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exactly: in doubles while they stay below 2^53, else in 64-bit integers."""
    most = np.sqrt((a * a).sum(axis=1).max(initial=0) * (b * b).sum(axis=1).max(initial=0))
    return a @ b.T if most < 2.0**52 else a.astype(np.int64) @ b.astype(np.int64).T


def search(tree: Tree, ids: np.ndarray, labels: np.ndarray, anchors: Anchors) -> None:
    """Best-first descent for a group of anchors at once: the node that promises most to any of them is next."""
    ids, labels = ids[tree.order], labels[tree.order]
    heap = [(-np.inf, 0, np.arange(len(anchors.ids)), None, None)]
    while heap:
        _, node, some, least, most = heapq.heappop(heap)
        if least is not None:  # windows may have risen since
            keep = anchors.alive(some, least, most)
            some = some[keep]
        if not len(some):
            continue
        kids = tree.children[node]
        if not kids:
            start, stop = tree.ranges[node]
            anchors.verify(some, tree.rows[start:stop], ids[start:stop], labels[start:stop])
            continue
        cosine = anchors.unit[some] @ tree.centres[kids][:, :-1].T
        for k, kid in enumerate(kids):
            low, high = bounds(cosine[:, k], tree.radii[kid], anchors.length[some], tree.top)
            keep = anchors.alive(some, low, high)
            if keep.any():
                heapq.heappush(heap, (-high[keep].max(), kid, some[keep], low[keep], high[keep]))


def _block(dim: int):
    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["vec_id", "label", "data"], ignore_index=True)
        return pd.DataFrame({"cell": [key[0]], "salt": [key[1]], "n": [len(frame)], "ids": [frame["vec_id"].to_numpy(np.int64).tobytes()],
                             "labels": [frame["label"].to_numpy(np.int64).tobytes()], "payload": [b"".join(frame["data"])]})

    return run


BLOCKS = "cell int, salt long, n int, ids binary, labels binary, payload binary"


def _longs(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<i8")


def _anchors(row: dict, dim: int, k: int, low: np.ndarray, high: np.ndarray, same: bool) -> Anchors:
    return Anchors(integers([row["payload"]], dim), _longs(row["ids"]), _longs(row["labels"]), low, high, same, k)


def _windows(row: dict) -> tuple[np.ndarray, np.ndarray]:
    shape = row["n"], -1
    return _longs(row["low"]).reshape(shape), _longs(row["high"]).reshape(shape)


def _searched(dim: int, top: float, k: int, same: bool):
    def run(key: tuple, groups: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        if not len(groups) or not len(blocks):
            return pd.DataFrame(columns=["grp", "at", "win", "other", "score"], dtype="int64")
        row = groups.iloc[0].to_dict()
        anchors = _anchors(row, dim, k, *_windows(row), same)
        # the blocks nearest to the group come first, so that the windows rise early
        for cell in sorted(blocks.to_dict("records"), key=lambda b: (-b["promise"], b["cell"], b["salt"])):
            search(Tree(integers([cell["payload"]], dim), top), _longs(cell["ids"]), _longs(cell["labels"]), anchors)
        return anchors.results().assign(grp=int(key[0]))[["grp", "at", "win", "other", "score"]]

    return run


FOUND = "grp long, at int, win int, other long, score long"


@dataclass
class _Upper:
    """The upper tree of one dimension: centres of cells on the sphere, their covering angles, and the tables."""

    scratch: Scratch
    dim: int
    top: float
    centres: np.ndarray
    radii: np.ndarray
    blocks: DataFrame
    count: int

    def pairs(self, groups: DataFrame, home: bool) -> DataFrame:
        """(grp, cell, promise): the cells that a group must look in; with ``home`` its own cell, otherwise the others."""
        dim, top = self.dim, self.top
        sent = self.scratch.spark.sparkContext.broadcast((self.centres, self.radii))  # CELLS rows at most

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            centres, radii = sent.value
            for frame in batches:
                for row in frame.to_dict("records"):
                    anchors = _anchors(row, dim, 1, *_windows(row), True)
                    cosine, some, out = anchors.unit @ centres[:, :-1].T, np.arange(row["n"]), []
                    for cell in range(len(centres)):
                        low, high = bounds(cosine[:, cell], radii[cell], anchors.length, top)
                        if radii[cell] >= 0 and (cell == row["cell"]) == home and anchors.alive(some, low, high).any():
                            out.append((row["grp"], cell, float(high.max())))
                    yield pd.DataFrame(out, columns=["grp", "cell", "promise"])

        return groups.select("grp", "cell", "n", "ids", "labels", "payload", "low", "high").mapInPandas(run, "grp long, cell int, promise double")

    def search(self, groups: DataFrame, k: int, same: bool, home: bool, name: str) -> DataFrame:
        """The best of each window in the cells looked in, found a tile of blocks at a time."""
        tiles = F.lit(max(1, -(-self.count // TILE)))
        wanted = self.scratch.keep(self.pairs(groups, home), f"{name}-pairs")
        tiled = wanted.join(self.blocks, "cell").withColumn("tile", F.pmod(F.xxhash64("cell", "salt"), tiles))
        needed = wanted.join(self.blocks.select("cell", "salt"), "cell").select("grp", F.pmod(F.xxhash64("cell", "salt"), tiles).alias("tile")).distinct()
        left = needed.join(groups, "grp")
        left = left.select(*[F.col(c).alias(c) for c in left.columns]).groupBy("grp", "tile")  # other columns than those of tiled
        found = left.cogroup(tiled.groupBy("grp", "tile")).applyInPandas(_searched(self.dim, self.top, k, same), FOUND)
        return self.scratch.keep(found, name)


def _best(found: DataFrame, k: int) -> DataFrame:
    row = Window.partitionBy("grp", "at", "win").orderBy(F.desc("score"), "other")
    return found.withColumn("rank", F.row_number().over(row)).where(F.col("rank") <= k)


def _with_windows(windows: int, bound):
    """Groups with the windows that ``bound`` makes of the scores found so far (n x windows, NONE where there is none)."""

    def run(key: tuple, groups: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        n = int(groups["n"][0])
        scores = np.full((n, windows), NONE)
        scores[found["at"].to_numpy(), found["rank"].to_numpy() - 1] = found["score"].to_numpy()
        low, high = bound(scores)
        return groups.assign(low=[low.astype("<i8").tobytes()], high=[high.astype("<i8").tobytes()])

    return run


GROUPS = "grp long, cell int, n int, ids binary, labels binary, payload binary, low binary, high binary"


def mine(vectors: DataFrame, anchors: str, positives: int = 5, negatives: int = 5, least: float = 0.8, scale: float = 256.0) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for ``vectors`` (vec_id, embedding, label).

    Components become floor(scale * x), scores are integer inner products; higher ones come first, ties by smaller
    vec_id. Anchors are the rows for which the SQL condition ``anchors`` holds. The positives of an anchor are its
    first ``positives`` other rows of its label; for each, the first ``negatives`` rows of other labels are returned
    whose score is from ``least`` times (in whole hundredths) the positive's score up to that score.

    All rows are candidates. They get one more component that brings all to one norm, so that inner products follow
    angles; cells round centres fitted on a bounded sample are the upper level of a cover tree, blocks of a cell
    have trees of their own. Groups of anchors of one cell look in their own cell for the positives, then in those
    cells whose covering radius lets them hold better ones, then in those that can hold a score within a window; in a
    block the descent is best-first, and leaves are compared exactly. Results are partial lists of k rows, merged
    by rank; pairs are never written. A group meets a tile of blocks in one task, so no task grows with the data, and
    cells of any size are spread over blocks.

    Rows with a null vec_id, label, vector or component, a non-finite component, an empty vector, or a norm of 2^31
    and more after scaling take no part; zero vectors do. Rows of one vec_id are candidates each, but never of the
    anchor of that id; equal anchors are answered once. Vectors of different lengths never meet. An anchor without
    positives, or a positive without rows in its window, gives no rows; an empty table gives an empty result.
    """
    if not 0 <= least <= 1 or positives < 1 or negatives < 1:
        raise ValueError("least is from 0 to 1; positives and negatives are at least 1")
    scratch = Scratch(vectors.sparkSession, "negatives")
    rows = scratch.keep(read(vectors, scale, anchors), "rows")
    stats = rows.groupBy("dim").agg(F.count("*").alias("n"), F.max("square").alias("square"), F.count_if("anchor").alias("anchors"))
    out = None
    for s in stats.collect():  # one row a vector length
        if s["anchors"]:
            made = _of_dimension(scratch, rows.where(F.col("dim") == s["dim"]), s["dim"], s["n"], s["square"] ** 0.5, positives, negatives, round(100 * least))
            out = made if out is None else out.unionByName(made)
    shape = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    return scratch.spark.createDataFrame([], shape) if out is None else out


def _of_dimension(scratch: Scratch, rows: DataFrame, dim: int, n: int, top: float, positives: int, negatives: int, percent: int) -> DataFrame:
    spark = scratch.spark
    drawn = rows.select("data").orderBy(F.xxhash64("data", "vec_id"), "vec_id").limit(FITTED).collect()
    sample = on_sphere(integers([bytes(r["data"]) for r in drawn], dim), top)
    centres = _spread(sample, min(CELLS, max(1, -(-n // BLOCK))))
    sent = spark.sparkContext.broadcast(centres)  # CELLS rows at most

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                unit = on_sphere(integers(batch.column(2).to_pylist(), dim), top)
                dots = unit @ sent.value.T
                cell = np.argmax(dots, axis=1)
                gap = np.sqrt(np.maximum(2 - 2 * dots[np.arange(len(cell)), cell], 0))
                angle = 2 * np.arcsin(np.minimum(1, gap / 2)) + 1e-7
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(angle)], ["vec_id", "label", "data", "anchor", "cell", "angle"])

    placed = rows.select("vec_id", "label", "data", "anchor").mapInArrow(assign, "vec_id long, label long, data binary, anchor boolean, cell int, angle double")
    placed = scratch.keep(placed, f"placed-{dim}")
    cells = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("angle"), F.count_if("anchor").alias("anchors")).collect()
    radii = np.full(len(centres), -1.0)
    radii[[c["cell"] for c in cells]] = [c["angle"] for c in cells]

    def salt(sizes: dict[int, int], most: int):
        parts = F.create_map(*[F.lit(x).cast("int") for c, m in sizes.items() for x in (c, -(-m // most))])
        return F.pmod(F.xxhash64("vec_id", "label", "data"), parts[F.col("cell")]).alias("salt")

    blocks = placed.select("cell", salt({c["cell"]: c["n"] for c in cells}, BLOCK), "vec_id", "label", "data")
    blocks = scratch.keep(blocks.groupBy("cell", "salt").applyInPandas(_block(dim), BLOCKS), f"blocks-{dim}")
    sizes = {c["cell"]: c["anchors"] for c in cells if c["anchors"]}
    groups = placed.where("anchor").select("cell", "vec_id", "label", "data").distinct()
    groups = groups.select("cell", salt(sizes, GROUP), "vec_id", "label", "data").groupBy("cell", "salt").applyInPandas(_block(dim), BLOCKS)
    groups = groups.withColumn("grp", F.col("cell").cast("long") * (1 << 32) + F.col("salt")).drop("salt")
    groups = scratch.keep(groups, f"groups-{dim}")
    upper = _Upper(scratch, dim, top, centres, radii, blocks, sum(-(-c["n"] // BLOCK) for c in cells))

    def with_windows(found: DataFrame, windows: int, bound, name: str) -> DataFrame:
        own = groups.groupBy("grp").cogroup(found.select("grp", "at", "rank", "score").groupBy("grp"))
        return scratch.keep(own.applyInPandas(_with_windows(windows, bound), GROUPS), name)

    def upward(scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low = scores[:, -1:]  # the last of the positives so far, if there are enough
        return low, np.full(low.shape, EVERY)

    def between(scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        there = scores > NONE
        return np.where(there, _share(scores, percent), EVERY), np.where(there, scores, NONE)

    none = spark.createDataFrame([], FOUND + ", rank int")
    at_home = upper.search(with_windows(none, positives, upward, f"start-{dim}"), positives, True, True, f"home-{dim}")
    started = with_windows(_best(at_home, positives), positives, upward, f"risen-{dim}")
    better = upper.search(started, positives, True, False, f"away-{dim}")
    chosen = scratch.keep(_best(at_home.unionByName(better), positives), f"positives-{dim}")
    windowed = with_windows(chosen, positives, between, f"windows-{dim}")
    near = upper.search(windowed, negatives, False, True, f"near-{dim}").unionByName(upper.search(windowed, negatives, False, False, f"far-{dim}"))
    near = _best(near, negatives)
    ids = windowed.select("grp", "ids").mapInPandas(_ids, "grp long, at int, anchor_id long")
    named = chosen.select("grp", "at", (F.col("rank") - 1).alias("win"), F.col("other").alias("positive_id"), F.col("score").alias("positive_score")).join(ids, ["grp", "at"])
    near = near.select("grp", "at", "win", "rank", F.col("other").alias("negative_id"), F.col("score").alias("negative_score"))
    return named.join(near, ["grp", "at", "win"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _share(whole: np.ndarray, percent: int) -> np.ndarray:
    """The least whole number of at least ``percent`` hundredths of each one, without overflow."""
    return whole // 100 * percent - -(whole % 100 * percent) // 100


def _ids(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in batches:
        for grp, ids in zip(frame["grp"], frame["ids"], strict=True):
            own = _longs(ids)
            yield pd.DataFrame({"grp": grp, "at": np.arange(len(own), dtype=np.int32), "anchor_id": own})


def _spread(unit: np.ndarray, most: int) -> np.ndarray:
    """Nested centres: each next one is the sample's farthest from those before, as long as it differs from them."""
    chosen, gap = [0], 2 - 2 * unit @ unit[0]
    while len(chosen) < min(most, len(unit)):
        at = int(np.argmax(gap))
        if gap[at] <= 1e-9:
            break
        chosen.append(at)
        gap = np.minimum(gap, 2 - 2 * unit @ unit[at])
    return unit[chosen]
