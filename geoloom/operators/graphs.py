"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch

#: So many edges are followed in one task.
ONE_TASK = 100_000


def _followed(edges: pd.DataFrame) -> pd.DataFrame:
    root: dict = {}

    def top(node):
        while root.setdefault(node, node) != node:
            root[node] = root[root[node]]
            node = root[node]
        return node

    for u, v in zip(edges["u"], edges["v"], strict=True):
        a, b = top(u), top(v)
        root[max(a, b)] = min(a, b)
    return pd.DataFrame({"node": list(root), "root": [top(n) for n in list(root)]})


def connected(edges: DataFrame, scratch: Scratch, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges (a, b): root is the smallest node that can be reached.

    Rounds of large and small stars (Kiveris et al. 2014): first every larger neighbour of a node points to the
    node's smallest neighbour, then the node and its smaller neighbours do, until nothing but stars is left;
    long chains halve with each round. A round is written, and the one before it removed. Up to ONE_TASK edges are
    followed without rounds."""
    now = scratch.written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "stars-0")
    if now.count() <= ONE_TASK:
        kind = now.schema["u"].dataType.simpleString()
        return now.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(_followed, f"node {kind}, root {kind}")
    before = None
    for k in range(most_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        now = scratch.written(small.where("u <> v").distinct(), f"stars-{k + 1}")
        scratch.remove(f"stars-{k}")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = state
    raise RuntimeError(f"the components were not found in {most_rounds} rounds")
