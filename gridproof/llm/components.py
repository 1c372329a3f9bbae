"""Connected components of links, by alternating large and small stars.

Each round links every node to the least node known near it; rounds go on until no link changes.
Tables of a round are written to the shared folder and deleted when the next ones are there, so a
lost executor costs one round and plans stay short, and both sides of a join are plain shuffles, which the adaptive plan splits where a
node has very many links. Links stay on the executors; the driver sees two numbers a round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """node, root: each linked node and the least node reachable from it. ``links``: columns a, b, not null."""
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = written(large, "large")
        discard(edges, least)
        least = written(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        moved = large.join(least, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = written(moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "links")
        discard(large, least)
        before, state = state, _state(edges)
        if state == before:
            break
    # the end is a star about each root
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
