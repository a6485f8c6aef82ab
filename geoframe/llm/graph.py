"""Connected components of a graph of links, by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop


def _lowest(edges: DataFrame) -> DataFrame:
    """node, low: the smallest of a node and its neighbours; partial sums make hubs cheap."""
    return edges.groupBy("node").agg(F.least("node", F.min("other")).alias("low"))


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node, root: the smallest node reachable from each node that has a link.

    edges: columns a and b of one orderable type, any order, repeats and self-links allowed, nulls ignored.
    Alternates the large-star and small-star steps: every node links its larger neighbours to its smallest
    one, then its smaller neighbours.  Edges never grow in number, hubs are joined to their minimum only, and
    the rounds grow with the logarithm of the longest path.  Each round is written to the shared folder.
    """
    e = cut(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(),
        "edges",
    )
    before = None
    while not e.isEmpty():
        both = e.select(F.col("u").alias("node"), F.col("v").alias("other")).union(e.select(F.col("v").alias("node"), F.col("u").alias("other")))
        large = both.where("other > node").join(_lowest(both), "node").select(F.col("other").alias("u"), F.col("low").alias("v")).where("u <> v").distinct()
        large, last = cut(large, "edges"), e
        down = large.select(F.col("u").alias("node"), F.col("v").alias("other"))
        low = _lowest(down)
        small = down.join(low, "node").select(F.col("other").alias("u"), F.col("low").alias("v")).union(low.select(F.col("node").alias("u"), F.col("low").alias("v")))
        e = cut(small.where("u <> v").distinct(), "edges")
        drop(last, large)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now

    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
