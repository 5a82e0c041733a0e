"""Connected components of a distributed list of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import SHARES, forget, saved


def _star(links: DataFrame, large: bool, total: int) -> DataFrame:
    """Large: a node's greater neighbours link to the least of its neighbourhood. Small: the smaller ones do, and the node. Hubs with a share of `total` links, a bounded number, are broadcast."""
    u, v = F.col("u"), F.col("v")
    near = links.select(u, v).union(links.select(v.alias("u"), u.alias("v"))) if large else links
    least = near.groupBy("u").agg(F.least(F.min("v"), u).alias("m"), F.count("*").alias("n"))
    hub = F.col("n") * SHARES >= F.lit(total)
    hubs = least.where(hub).select("u", "m")
    joined = near.join(F.broadcast(hubs), "u").unionByName(near.join(F.broadcast(hubs.select("u")), "u", "left_anti").join(least.where(~hub).select("u", "m"), "u"))
    if large:
        out = joined.where(v > u).select(v.alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(v.alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where(F.col("u") != F.col("v")).distinct()


def components(links: DataFrame, u: str = "u", v: str = "v", most_rounds: int = 100) -> DataFrame:
    """(node, root) for each node that a link touches; root is the smallest node reachable.

    Nodes are longs. Links count both ways; loops and repeats don't matter; links with a null end are ignored. Each round
    is two aggregations and two joins; rounds grow with the logarithm of a chain's length. Only a count and
    a sum of each round come to the driver.
    """
    a, b = F.col(u).cast("long"), F.col(v).cast("long")
    now = saved(links.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links")
    before, total = None, now.count()
    for _ in range(most_rounds):
        large = saved(_star(now, True, total), "links")
        new = saved(_star(large, False, total), "links")
        forget(large)
        forget(now)
        now = new
        sign = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("u", "v").cast("long"))).first())
        total = sign[0]
        if sign == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = sign
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
