"""Degree-1 pruning: leaves move into a list at their hub. A single pass; both ends of a lone edge stay."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from constella.iterate import cut
from constella.operators.graph import degrees


@dataclass
class Pruned:
    """Vertices and edges that stay, and (hub, leaf) pairs; ``hubs`` has the sorted list of each hub's leaves."""

    vertices: DataFrame
    edges: DataFrame
    leaves: DataFrame

    @property
    def hubs(self) -> DataFrame:
        return self.leaves.groupBy(F.col("hub").alias("id")).agg(F.sort_array(F.collect_list("leaf")).alias("one_edges"))


def leaves_of(edges: DataFrame) -> DataFrame:
    """(hub, leaf): a vertex of degree 1 and its neighbour of degree 2 or more."""
    degree = degrees(edges)
    ones = edges.join(degree.where("degree = 1").select(F.col("id").alias("src")), "src", "left_semi")
    return ones.join(degree.where("degree >= 2").select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("dst").alias("hub"), F.col("src").alias("leaf"))


def prune_leaves(vertices: DataFrame, edges: DataFrame) -> Pruned:
    # Used by vertices, edges and hubs: written once, and known to be few where they are.
    leaves = cut(leaves_of(edges), "leaves")
    gone = leaves.select(F.col("leaf").alias("id"))
    kept = edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return Pruned(vertices.join(gone, "id", "left_anti"), kept.select(*edges.columns), leaves)


def with_leaves(vertices: DataFrame, pruned: Pruned) -> DataFrame:
    """Vertices with their list of leaves (empty for most)."""
    return vertices.join(pruned.hubs, "id", "left").withColumn("one_edges", F.coalesce("one_edges", F.array().cast("array<bigint>")))
