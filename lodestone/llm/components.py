"""Connected components by alternating large-star and small-star steps, every step a join and an aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import materialize, release


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(links: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(node, component) for every node of links (a, b); component is the smallest node that links reach."""
    edges = links.select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")).where("a != b").distinct()
    edges = materialize(edges.select("a", "b"), "links")
    before = _state(edges)
    if not before[0]:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    for _ in range(most_rounds):
        old = edges
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Every edge now points down: a > b.
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        edges = large.join(small, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = materialize(edges.unionByName(small.select("a", F.col("m").alias("b"))).where("a != b").distinct(), "links")
        after = _state(edges)
        release(old)
        if after == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        before = after
    raise RuntimeError("components did not settle")
