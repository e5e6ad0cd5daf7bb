"""Connected components by alternating stars, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.shared import dropped, saved

#: Rounds after which something must be wrong: they grow with the logarithm of the largest component.
MAX_ROUNDS = 64


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b): component is the smallest node that links lead to.

    Each round joins every node to the smallest of its neighbours, first from its larger neighbours and then from its
    smaller ones, until each component is a star around its smallest node. Self-links and null ends are left out;
    without edges there are no rows. Minima are combined before each shuffle, and a round ends as a written table.
    """
    ends = edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    stars = saved(ends, "edges")
    before = _fingerprint(stars)
    for _ in range(MAX_ROUNDS):
        both = stars.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(stars.select("lo", "hi"))
        smallest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(smallest, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        old, stars = stars, saved(small.union(least.select("hi", "m")).distinct(), "stars")
        dropped(old)
        now = _fingerprint(stars)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    nodes = stars.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    return nodes.union(stars.select("lo", "lo").distinct())
