"""Connected components of an edge table, in Spark joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import copied, dealt, heavy_keys, materialise, release


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` of every node of ``edges(a, b)``; the component is its smallest node.

    Alternates large-star and small-star steps, each a partial aggregate and an equi-join, until
    every node hangs on its component's smallest node. Edges stay at most as many as they were; those
    of a node with very many are dealt to many tasks.
    """
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    pairs, before = materialise(pairs), None
    while True:
        both = pairs.select("u", "v").union(pairs.select(F.col("v"), F.col("u")))
        heavy = heavy_keys(both, "u")

        def met(edges: DataFrame, least: DataFrame) -> DataFrame:
            return dealt(edges, "u", heavy).join(copied(least, "u", heavy), ["u", "_part"])

        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = met(both.where("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = met(large, least).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        seen = Observation()
        state = F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")
        last, pairs = pairs, materialise(small.union(least.select("u", F.col("m").alias("v"))).distinct().observe(seen, *state))
        release(last)
        if seen.get == before:
            break
        before = seen.get
    stars = pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
