"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievegrid.session import stage, unstage


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 30)))).first()
    return tuple(row)


#: Edges of one node above which they stay where they lie, and the node's least neighbour goes to them.
HUB = 1 << 17


def _with_least(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(u, v, m) with m, u's least neighbour, and the staged (u, m, n) of all nodes.

    Edges of one node meet its least neighbour in one task, but those of hubs, a row for HUB edges at most, which are broadcast.
    """
    least = stage(edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), "least")
    hubs = least.where(F.col("n") > HUB).select("u", "m")
    if hubs.isEmpty():
        return edges.join(least.drop("n"), "u"), least
    others = edges.join(F.broadcast(hubs.select("u")), "u", "left_anti").join(least.where(F.col("n") <= HUB).drop("n"), "u")
    return others.unionByName(edges.join(F.broadcast(hubs), "u")), least


def connected_components(edges: DataFrame, left: str, right: str, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an edge; component is the smallest node that it reaches.

    Every round is joins and grouped minima, and a hub's edges are not gathered in one task; the rounds grow with
    the logarithm of the longest chain. Edges with a null end and loops are left out.
    """
    ends = edges.select(F.col(left).alias("a"), F.col(right).alias("b")).where("a <> b")
    current = stage(ends.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = _fingerprint(current)
    for _ in range(max_rounds):
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        met, told = _with_least(both)
        large = stage(met.where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct(), "large-star")
        unstage(told)
        met, told = _with_least(large)
        hooked = met.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = stage(hooked.unionByName(told.select("u", F.col("m").alias("v"))).distinct(), "small-star")
        unstage(told)
        after = _fingerprint(small)
        unstage(current)
        unstage(large)
        current = small
        if after == before:
            roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
        before = after
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
