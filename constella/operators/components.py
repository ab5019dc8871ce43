"""Connected components: every vertex gets the smallest id of its component."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from constella.iterate import cut, drop


def connected_components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, component`` for every vertex, isolated ones included.

    Alternating large and small stars: the rounds grow with the logarithm of a component's size, not with its diameter. A
    round is compared with the one before by one aggregate over both.
    """
    stars = cut(edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).where("u <> v").distinct(), "stars")
    mark = None
    while True:
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        small = small.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        following = cut(small.where("u <> v").distinct(), "stars")
        now = tuple(following.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        drop(stars)
        stars = following
        if now == mark:
            break
        mark = now
    return vertices.select("id").distinct().join(stars.select(F.col("u").alias("id"), "v"), "id", "left").select("id", F.coalesce("v", "id").alias("component"))

