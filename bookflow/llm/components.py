"""Connected components of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookflow.session import materialize

MAX_ROUNDS = 60


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): root is the smallest node of its component.

    Each round is written to shared storage, which ends the lineage. A star's hub is joined, not
    collected: its neighbours are reduced by a partial minimum and skewed hubs are split by AQE. The rounds
    end when one changes no edge, by the count and two sums of 64-bit hashes; should MAX_ROUNDS not
    be enough, an error is raised.
    """
    pairs = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    edges = materialize(pairs.where("u <> v").distinct(), "links")
    seen = None
    for _ in range(MAX_ROUNDS):
        hashed = F.xxhash64("u", "v").cast("decimal(38, 0)")
        mark = edges.agg(F.count("*"), F.sum(hashed), F.bit_xor(F.xxhash64("v", "u"))).first()
        if mark == seen:
            break
        seen = mark
        edges = materialize(_star(_star(edges, large=True), large=False), "links")
    else:
        raise RuntimeError(f"components still change after {MAX_ROUNDS} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        edges.select("v", "v").distinct()
    )


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Point each node's larger (large) or smaller (small) neighbours at the least of them and itself.

    ``edges`` has u > v. Large: u's larger neighbours are those that have it as v.
    """
    both = edges.select(F.col("u").alias("c"), F.col("v").alias("x"))
    if large:
        both = both.union(edges.select("v", "u"))
    least = both.groupBy("c").agg(F.min("x").alias("m")).select("c", F.least("c", "m").alias("m"))
    moved = both.where("x > c" if large else "x < c").join(least, "c").where("x <> m").select("x", "m")
    if not large:
        moved = moved.union(least.where("c <> m").select("c", "m"))
    return moved.select(F.greatest("x", "m").alias("u"), F.least("x", "m").alias("v")).distinct()
