"""Connected components of an edge table by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm import common


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40)))).first())


def components(edges: DataFrame, rounds: int = 200) -> DataFrame:
    """key, comp of every end of edges(a, b): comp is the least key of its component. Every round maps neighbours to the least one, first from
    above and then from below, until nothing changes; rounds grow with the logarithm of the longest path. Each is written to the shared folder; only a count and a checksum reach the driver. Raises where rounds don't do."""
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = common.materialise(edges, "edges")
    mark = _mark(edges)
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lower, "a")
        star = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(lower.select("a", F.col("m").alias("b")))
        old, edges = edges, common.materialise(star.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
        common.discard(old)
        before, mark = mark, _mark(edges)
        if mark == before:
            break
    else:
        raise RuntimeError(f"components have not settled after {rounds} rounds")
    return edges.select(F.col("a").alias("key"), F.col("b").alias("comp")).unionByName(edges.select(F.col("b").alias("key"), F.col("b").alias("comp")).distinct())
