"""Near-duplicate documents by MinHash banding, exact confirmation and connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauseloom.llm.graph import components
from clauseloom.llm.shared import ASCII_LOWER, Scratch, text_key

#: Words in a shingle.
WIDTH = 5
#: 32 bands of 4 minima: two sets of similarity 0.75 miss every band with a chance of 5e-6, closer ones sooner never.
BANDS, ROWS = 32, 4
#: Bits in which a byte mixed from each of the 128 minima of two sets may differ for the pair to be confirmed on full sets.
#: Half of the bits of unequal minima differ: at similarity 0.75 that makes 128 with a deviation of 21, so a linked
#: pair has more than 234 with a chance of about 3e-7; unlinked ones of similarity below a half mostly have more.
DIFFER = 234
#: Rounds in which a bucket's members meet one hub each, before the pairs that are left are compared; with no more
#: than PAIRS_LEFT such pairs for each member left they are compared at once.
HUB_ROUNDS, PAIRS_LEFT = 1, 8
#: Single bits mixed from so many more minima tell the members that are left apart: half of those of unequal minima
#: differ, at similarity 0.75 in all 256 with a deviation of 15 for small sets and large, so a linked pair has more than
#: 331 with a chance of about 3e-7, and one of similarity below two thirds mostly has more.
FINE, FINE_DIFFER = 2048, 331

_RANDOM = np.random.default_rng(20240229)
_A = _RANDOM.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
_B = _RANDOM.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
_FINE_A = _RANDOM.integers(0, 1 << 32, FINE, dtype=np.uint32) | np.uint32(1)
_FINE_B = _RANDOM.integers(0, 1 << 32, FINE, dtype=np.uint32)
_OWN = np.arange(FINE, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
_STEPS = _RANDOM.integers(1, 1 << 63, WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (a fixed xor-shift-multiply finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit names of the text's five-word shingles; fewer words are one shingle as a whole."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(ASCII_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    names = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    if len(words) < WIDTH:
        return _mixed(np.array([xxhash.xxh3_64_intdigest(b" ".join(words), 1)], np.uint64))
    n = len(words) - WIDTH + 1
    total = np.zeros(n, np.uint64)
    for i in range(WIDTH):
        total += _mixed(names[i : i + n] * _STEPS[i] + np.uint64(i))
    return np.unique(_mixed(total))


def minima(names: np.ndarray, a: np.ndarray = _A, b: np.ndarray = _B) -> np.ndarray:
    """The least value of each of the hashes a * x + b modulo 2^32 over a set's names, upper halves."""
    upper = (names >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(a), np.iinfo(np.uint32).max, np.uint32)
    held = np.empty((max(1, 32_768 // len(a)), len(a)), np.uint32)
    for i in range(0, len(upper), len(held)):
        part = upper[i : i + len(held), None]
        values = np.multiply(part, a, out=held[: len(part)])
        np.add(values, b, out=values)
        np.minimum(least, values.min(axis=0), out=least)
    return least


def bands(least: np.ndarray) -> np.ndarray:
    """One 64-bit name for each band of minima."""
    pairs = least.reshape(BANDS, ROWS // 2, 2).astype(np.uint64)
    joined = pairs[:, :, 0] << np.uint64(32) | pairs[:, :, 1]
    name = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS // 2):
        name = _mixed(name * _STEPS[0] + joined[:, k])
    return name.view(np.int64)


def mixed(least: np.ndarray) -> np.ndarray:
    """64 bits of each minimum and its number. The low bits of a * x + b follow the low bits of x alone, whatever the
    hash: taken as they are, those of all minima would agree or differ together."""
    return _mixed(least.astype(np.uint64) ^ _OWN[: len(least)])


SKETCH = "doc_id long, tk binary, n_shingles int, cls binary, sig array<bigint>, bands array<bigint>"
LONGS = BANDS * ROWS // 8


def _alike(a: str, b: str, longs: int = LONGS, differ: int = DIFFER) -> str:
    """SQL: two signatures, arrays of longs, differ in few bits."""
    return " + ".join(f"bit_count({a}[{k}] ^ {b}[{k}])" for k in range(longs)) + f" <= {differ}"


def _fine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        least = (minima(shingles(t.as_py()), _FINE_A, _FINE_B) for t in batch.column(1))
        bits = [np.packbits((mixed(x) >> np.uint64(63)).astype(np.uint8)).view(np.int64) for x in least]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits, pa.list_(pa.int64()))], ["cls", "fine"])


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, cls, sig, filed = [], [], [], []
        for text in batch.column(2):
            names = shingles(text.as_py())
            n.append(len(names))
            cls.append(xxhash.xxh3_128_digest(names.tobytes()) if len(names) else None)
            least = minima(names)
            sig.append((mixed(least) >> np.uint64(56)).astype(np.uint8).view(np.int64) if len(names) else None)
            filed.append(bands(least) if len(names) else None)
        lists = [pa.array(x, pa.list_(pa.int64())) for x in (sig, filed)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(n, pa.int32()), pa.array(cls, pa.binary()), *lists],
            ["doc_id", "tk", "n_shingles", "cls", "sig", "bands"])


def _confirmed(threshold_pct: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, None
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                a, b = a.as_py(), shingles(b.as_py())
                if a != last:
                    last, own = a, shingles(a)
                both = len(np.intersect1d(own, b, assume_unique=True))
                keep.append(100 * both >= threshold_pct * (len(own) + len(b) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


class _Pairs:
    """Confirms candidate pairs of classes (a, b) and remembers which pairs have been looked at."""

    def __init__(self, scratch: Scratch, docs: DataFrame, classes: DataFrame, threshold_pct: int):
        self.scratch, self.docs, self.classes, self.pct, self.rounds = scratch, docs, classes, threshold_pct, 0
        self.seen: DataFrame | None = None

    def texts(self, some: DataFrame) -> DataFrame:
        """(cls, text) of a document of each class in ``some``; rows that repeat come more than once."""
        wanted = self.classes.join(some, "cls", "left_semi").select("cls", F.col("doc_id").alias("_id"), F.col("tk").alias("_tk"))
        same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tk") == F.col("_tk"))
        return self.docs.join(wanted, same).select("cls", "text")

    def links(self, pairs: DataFrame) -> DataFrame | None:
        """The linked ones among ``pairs``; None if none is new."""
        self.rounds += 1
        if self.seen is not None:
            pairs = pairs.join(self.seen, ["a", "b"], "left_anti")
        sides = self.classes.select("cls", "n_shingles", "sig")
        a = sides.select(F.col("cls").alias("a"), F.col("n_shingles").alias("na"), F.col("sig").alias("sa"))
        b = sides.select(F.col("cls").alias("b"), F.col("n_shingles").alias("nb"), F.col("sig").alias("sb"))
        sized = F.expr(f"100L * least(na, nb) >= {self.pct}L * greatest(na, nb)")
        found = pairs.join(b, "b").join(a, "a").where(sized & F.expr(_alike("sa", "sb"))).select("a", "b")
        found = self.scratch.keep(found, f"pairs-{self.rounds}")
        if found.isEmpty():
            return None
        self.seen = found if self.seen is None else self.seen.unionByName(found)
        ends = found.select(F.col("a").alias("cls")).unionByName(found.select(F.col("b").alias("cls"))).distinct()
        texts = self.scratch.keep(self.texts(ends), f"texts-{self.rounds}")
        with_b = found.join(texts.select(F.col("cls").alias("b"), F.col("text").alias("tb")), "b")
        with_both = with_b.join(texts.select(F.col("cls").alias("a"), F.col("text").alias("ta")), "a")
        checked = with_both.select("a", "b", "ta", "tb").mapInArrow(_confirmed(self.pct), "a binary, b binary")
        checked = self.scratch.keep(checked.distinct(), f"links-{self.rounds}")
        self.scratch.drop(f"texts-{self.rounds}")
        return checked


def _joined(scratch: Scratch, labels: DataFrame | None, links: DataFrame, turn: int) -> DataFrame:
    """(node, root) after new links: the roots so far are contracted to nodes of the next component run."""
    if labels is None:
        return scratch.keep(components(scratch, links, f"components{turn}"), f"labels-{turn}")
    a = labels.select(F.col("node").alias("a"), F.col("root").alias("ra"))
    b = labels.select(F.col("node").alias("b"), F.col("root").alias("rb"))
    lifted = links.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    moved = components(scratch, lifted, f"components{turn}")
    old = labels.join(moved.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left")
    old = old.select("node", F.coalesce("top", "root").alias("root"))
    new = moved.join(labels.select("node"), "node", "left_anti")
    return scratch.keep(old.unionByName(new), f"labels-{turn}")


def near_duplicates(docs: DataFrame, threshold_pct: int = 75, with_class: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every document; ``with_class`` adds tk (a digest of the text) and
    group (the component by content, null without words), which tell rows apart where doc_ids do not.

    Words are runs of anything but 0x20 and 0x09-0x0D with A-Z lower-cased. Documents of equal shingle sets form a
    class; classes whose sets have ``100 * intersection >= threshold_pct * union`` are linked, confirmed on the full
    sets. component_id is the smallest doc_id reachable, kept is doc_id = component_id.

    No bucket is expanded into all its pairs at first: in each round every member of a bucket meets one hub of it,
    the links found are contracted to components, and only buckets that still hold two components go on. After
    HUB_ROUNDS rounds, or once few are left, the remaining pairs of different components in a bucket are compared
    too, so that no candidate is lost. A document without words (null or empty text) has n_shingles 0 and is its own component.
    Repeated rows and rows that share a doc_id count as documents of their own; a null doc_id takes part, and is
    never a component_id while another id can be reached. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("tk"), "text")
    sketch = scratch.keep(docs.select("doc_id", "tk", "text").mapInArrow(_sketched, SKETCH), "sketch")
    classes = scratch.keep(
        sketch.where("cls is not null").groupBy("cls").agg(
            F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "tk", "n_shingles")).alias("row"),
            F.first("sig").alias("sig"), F.first("bands").alias("bands"))  # alike in all rows of a class
        .select("cls", "least", "row.*", "sig", "bands"), "classes")
    pairs = _Pairs(scratch, docs, classes, threshold_pct)
    filed = classes.select("cls", F.explode("bands").alias("bucket"))
    sizes = filed.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    shared = scratch.keep(filed.join(sizes, "bucket"), "shared")
    # the hub of a bucket is its member with most company over all buckets: of copies edited apart, the original
    company = shared.groupBy("cls").agg(F.sum("size").alias("company"))
    hubs = shared.join(company, "cls").groupBy("bucket").agg(F.max(F.struct("company", "cls")).alias("h")).select("bucket", F.col("h.cls").alias("hub"))
    members = scratch.keep(shared.select("bucket", "cls").join(scratch.keep(hubs, "hubs"), "bucket"), "members")
    scratch.drop("shared")
    scratch.drop("hubs")
    labels: DataFrame | None = None
    found = pairs.links(members.where("cls <> hub").select(F.least("hub", "cls").alias("a"), F.greatest("hub", "cls").alias("b")).distinct())
    if found is not None:
        labels = _joined(scratch, labels, found, 1)
    for turn in range(2, HUB_ROUNDS + 2):
        at = members.select("bucket", "cls", F.col("cls").alias("root"))  # without links so far each class is its own root
        if labels is not None:
            at = at.drop("root").join(labels.select(F.col("node").alias("cls"), "root"), "cls", "left")
            at = at.select("bucket", "cls", F.coalesce("root", "cls").alias("root"))
        spread = at.groupBy("bucket").agg(
            F.min("root").alias("r0"), F.max("root").alias("r1"),
            F.min_by(F.struct("cls", "root"), F.xxhash64("cls", F.lit(turn))).alias("h")).where("r0 <> r1")
        left = scratch.keep(at.join(spread.select("bucket", F.col("h.cls").alias("hub"), F.col("h.root").alias("hub_root")), "bucket"), f"left-{turn}")
        sizes = left.groupBy("bucket").agg(F.count("*").alias("n")).agg(F.sum("n").alias("n"), F.sum(F.expr("n * (n - 1) div 2")).alias("pairs")).first()
        if not sizes["n"]:
            break
        last = turn > HUB_ROUNDS or sizes["pairs"] <= PAIRS_LEFT * sizes["n"]
        if not last:
            tried = left.where("root <> hub_root").select(F.least("hub", "cls").alias("a"), F.greatest("hub", "cls").alias("b"))
        else:
            fine = pairs.texts(left.select("cls").distinct()).mapInArrow(_fine, "cls binary, fine array<bigint>").dropDuplicates(["cls"])
            signed = left.select("bucket", "cls", "root").join(classes.select("cls", "n_shingles").join(scratch.keep(fine, "fine"), "cls"), "cls")
            x, y = (signed.select("bucket", *[F.col(c).alias(f"{c}_{side}") for c in ("cls", "root", "n_shingles", "fine")]) for side in "xy")
            sized = f"100L * least(n_shingles_x, n_shingles_y) >= {threshold_pct}L * greatest(n_shingles_x, n_shingles_y)"
            # the estimate is part of the join: pairs that do not look alike are never rows
            fit = F.expr(f"cls_x < cls_y and root_x <> root_y and {sized} and {_alike('fine_x', 'fine_y', FINE // 64, FINE_DIFFER)}")
            tried = x.join(y, (x["bucket"] == y["bucket"]) & fit).select(F.col("cls_x").alias("a"), F.col("cls_y").alias("b"))
        found = pairs.links(tried.distinct())
        if found is not None:
            labels = _joined(scratch, labels, found, turn)
        if last:
            break
    top = classes.select("cls", "least", F.col("cls").alias("root"))
    if labels is not None:
        own = labels.select(F.col("node").alias("cls"), F.col("root").alias("found"))
        rooted = top.join(own, "cls", "left").select("cls", "least", F.coalesce("found", "root").alias("root"))
        ids = rooted.groupBy("root").agg(F.min("least").alias("first"))
        top = scratch.keep(rooted.join(ids, "root").select("cls", "root", F.col("first").alias("least")), "result")
    out = sketch.select("doc_id", "tk", "n_shingles", "cls").join(top, "cls", "left")
    own = F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("least"))
    out = out.select("doc_id", F.col("n_shingles").cast("long").alias("n_shingles"), own.alias("component_id"),
                     own.eqNullSafe(F.col("doc_id")).alias("kept"), "tk", F.col("root").alias("group"))
    return out if with_class else out.drop("tk", "group")
