"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import common


def components(links: DataFrame, a: str = "a", b: str = "b", name: str = "links") -> DataFrame:
    """``member, component`` (the smallest member) of everything that has a link to something else.

    Each round joins nodes with the smallest of their neighbours, a combined aggregate; a node with very many
    neighbours is a skewed join key, which adaptive execution splits.  The rounds grow with the logarithm of
    the longest path.
    """
    both = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    edges = common.settle(both.distinct(), name)
    before = _print(edges)
    while True:
        two_ways = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = two_ways.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = two_ways.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = common.settle(small.unionByName(low.withColumnRenamed("m", "v")).distinct(), name)
        now = _print(edges)
        if now == before:
            return edges.select(F.col("u").alias("member"), F.col("v").alias("component"))
        before = now


def _print(edges: DataFrame) -> tuple:
    mixed = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count("*"), F.sum(F.shiftright(mixed, 20)), F.bit_xor(mixed)).first())
