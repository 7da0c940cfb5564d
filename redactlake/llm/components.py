"""Connected components of a graph of links, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redactlake.llm.store import Scratch


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """id, component (the smallest id reachable) of all ids in `links` (a, b), component itself left out.

    Alternates two steps until nothing changes: every vertex links its larger neighbours to its smallest neighbour, then its
    smaller ones. Rounds follow the logarithm of a component's width. Minima are written before they are joined, so
    that Spark can split the rows of a vertex with very many links.
    """
    greater, smaller = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    edges = scratch.keep(links.where("a != b").select(greater, smaller).distinct(), f"{name}-0")
    state, step = None, 0
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state or not now[0]:
            return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
        state, step = now, step + 1
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = scratch.keep(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), f"{name}-{step}-large")
        up = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = scratch.keep(up.where("a != b").distinct(), f"{name}-{step}-up")
        least = scratch.keep(large.groupBy("a").agg(F.min("b").alias("m")), f"{name}-{step}-small")
        joined = large.join(least, "a")
        down = joined.select("a", F.col("m").alias("b")).unionByName(joined.select(F.col("b").alias("a"), F.col("m").alias("b")))
        edges = scratch.keep(down.where("a != b").distinct(), f"{name}-{step}")
