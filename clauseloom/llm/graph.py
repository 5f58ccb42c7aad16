"""Connected components by alternating large-star and small-star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauseloom.llm.shared import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    """Link each larger neighbour of a node to the smallest node around it."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def components(scratch: Scratch, links: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): root is the smallest node reachable.

    Every round is two joins on pre-aggregated minima, so a hub of any degree is reduced map-side and its
    edges can be split over tasks. Rounds grow with the logarithm of the longest path. Nulls, loops and
    repeated links are ignored; an empty input gives an empty result.
    """
    edges = (
        links.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    edges, mark, turn = scratch.keep(edges, f"{name}-0"), None, 0
    while True:
        # Nothing but the sum of hashes of the edge set reaches the driver.
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if now == mark or not now[0]:
            break
        mark, turn = now, turn + 1
        starred = _small_star(_large_star(edges)).distinct()
        edges = scratch.keep(starred, f"{name}-{turn}")
        scratch.drop(f"{name}-{turn - 1}")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
