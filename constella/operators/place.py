"""Placement of a finer layer from the coordinates of the layer above."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from constella.functions.portable import uniform
from constella.operators.coarsen import Layer
from constella.operators.graph import random_places

_TURN = 2 * math.pi


def coarsest_places(layer: Layer, box_x: float = 1200.0, box_y: float | None = None, seed: int = 42) -> DataFrame:
    return random_places(layer.vertices, box_x, box_y, seed, salt=101)


def place_bodies(layer: Layer, upper: DataFrame, upper_edges: DataFrame, ideal: float, seed: int = 42) -> DataFrame:
    """``layer``'s vertices with x and y. ``upper`` has the places (id, x, y) of the layer above, ``upper_edges``
    its edges, whose weights are the lengths of the ways between suns.

    Suns take their place above. A body on paths to other suns lies between, at the mean over its paths and a small shift; a
    planet without paths lies around its sun, a moon without paths around its first proxy.
    """
    suns = upper.select(F.col("id").alias("sun"), F.col("x").alias("sx"), F.col("y").alias("sy"))
    others = upper.select(F.col("id").alias("nbr_sun"), F.col("x").alias("ox"), F.col("y").alias("oy"))
    lengths = upper_edges.select(F.col("src").alias("sun"), F.col("dst").alias("nbr_sun"), F.col("weight").alias("length"))
    paths = layer.paths.join(lengths, ["sun", "nbr_sun"]).join(suns, "sun").join(others, "nbr_sun")
    share = F.col("position") / F.col("length")
    along = paths.groupBy(F.col("body").alias("id")).agg(F.avg((F.col("ox") - F.col("sx")) * share).alias("ax"), F.avg((F.col("oy") - F.col("sy")) * share).alias("ay"))
    bodies = layer.bodies.join(suns, "sun").join(along, "id", "left")
    shift = uniform(F.col("id"), 201 + layer.number, seed) * 2 - 1
    angle = uniform(F.col("id"), 301 + layer.number, seed) * _TURN
    reach = F.col("w_from_sun") * F.lit(float(ideal))
    x = F.when(F.col("hops") == 0, F.col("sx")).when(F.col("ax").isNotNull(), F.col("sx") + F.col("ax") + shift).when(F.col("hops") == 1, F.col("sx") + F.cos(angle) * reach)
    y = F.when(F.col("hops") == 0, F.col("sy")).when(F.col("ay").isNotNull(), F.col("sy") + F.col("ay") + shift).when(F.col("hops") == 1, F.col("sy") + F.sin(angle) * reach)
    placed = bodies.select("id", "proxy", "w_from_sun", angle.alias("angle"), x.alias("x"), y.alias("y"))
    around = placed.where("x is not null").select(F.col("id").alias("proxy"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("w_from_sun").alias("pw"))
    lone = placed.where("x is null").drop("x", "y").join(around, "proxy")
    step = (F.col("w_from_sun") - F.col("pw")) * F.lit(float(ideal))
    lone = lone.select("id", (F.col("px") + F.cos("angle") * step).alias("x"), (F.col("py") + F.sin("angle") * step).alias("y"))
    return layer.vertices.join(placed.where("x is not null").select("id", "x", "y").unionByName(lone), "id")
