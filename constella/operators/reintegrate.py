"""Reintegration: leaves that pruning took away are placed around their hubs.

Leaves are numbered by id. Gaps are the angles between consecutive neighbours of a hub; every strategy gives each leaf an
angle, and the radius is a share of the hub's shortest edge (or of the ideal edge where it has none).
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from constella.functions import geometry as G
from constella.iterate import cut_buckets
from constella.operators.graph import bucket_count


@dataclass
class ReintegrationOptions:
    radius: float = 0.2
    dynamic_radius: bool = True
    cone_width: float = 90.0
    padding: float = 2.0
    low_threshold: float = 2.0
    ideal: float = G.ideal_edge()


def hub_rays(vertices: DataFrame, edges: DataFrame, hubs: DataFrame) -> DataFrame:
    """(id, nbr, angle, dist, px, py): directions from each hub to the neighbours that stayed.

    Places of neighbours travel along the (symmetric) edges, which are dealt by the hub once. Edges from vertices that aren't in ``vertices`` count for nothing.
    """
    mine = vertices.join(hubs.select("id"), "id", "left_semi").select("id", "x", "y")
    theirs = vertices.select(F.col("id").alias("src"), F.col("x").alias("nx"), F.col("y").alias("ny"))
    sent = edges.select("src", "dst").join(theirs, "src").select(F.col("dst").alias("id"), F.col("src").alias("nbr"), "nx", "ny")
    rays = sent.repartition(bucket_count(edges), "id").join(mine, "id")
    dx, dy = F.col("nx") - F.col("x"), F.col("ny") - F.col("y")
    back = F.lit(1.0) / (G.norm(dx, dy) * G.norm(dx, dy))
    return rays.select("id", "nbr", G.polar(dx, dy).alias("angle"), G.norm(dx, dy).alias("dist"), (-dx * back).alias("px"), (-dy * back).alias("py"))


def gaps(rays: DataFrame) -> DataFrame:
    """(id, start, gap): angle from each neighbour to the next one, around the hub; a lone neighbour has a gap of a whole turn."""
    w = Window.partitionBy("id").orderBy("angle", "nbr")
    whole = Window.partitionBy("id")
    following = F.coalesce(F.lead("angle").over(w), F.min("angle").over(whole) + F.lit(G.TWO_PI))
    return rays.select("id", F.col("angle").alias("start"), (following - F.col("angle")).alias("gap"))


def radius_of(rays: DataFrame, hubs: DataFrame, options: ReintegrationOptions) -> DataFrame:
    """(id, r) for each hub."""
    shortest = rays.groupBy("id").agg(F.min("dist").alias("shortest"))
    base = F.coalesce("shortest", F.lit(options.ideal)) if options.dynamic_radius else F.lit(options.ideal)
    return hubs.select("id").join(shortest, "id", "left").select("id", (base * options.radius).alias("r"))


def on_sector(start: Column, sector: Column, quantity: Column, nth: Column) -> Column:
    """Angle of the nth of ``quantity`` points spread over a sector."""
    step = sector / quantity
    return start + step / 2 + nth * step


def sectors(rays: DataFrame, hubs: DataFrame, strategy: str | Callable, options: ReintegrationOptions) -> DataFrame:
    """(id, sectors): for each hub an array of (start, sector, quantity), in order; quantities add up to its leaves.

    ``strategy`` is a name or a function of (rays, hubs, options); an unknown name stands for the default, ``fair_share``.
    """
    if callable(strategy):
        return strategy(rays, hubs, options)
    padding = math.radians(options.padding)
    one = lambda start, sector: F.array(F.struct(start.cast("double").alias("start"), sector.cast("double").alias("sector"), F.size("one_edges").alias("quantity")))
    around = one(F.lit(0.0), F.lit(G.TWO_PI))
    if strategy == "radial":
        return hubs.select("id", around.alias("sectors"))
    if strategy == "cone":
        width = math.radians(options.cone_width)
        push = rays.groupBy("id").agg(F.atan2(F.sum("py"), F.sum("px")).alias("theta"))
        return hubs.join(push, "id", "left").select("id", one(F.coalesce("theta", F.lit(0.0)) - width / 2, F.lit(width)).alias("sectors"))
    found = gaps(rays)
    if strategy == "max_slope":
        widest = found.groupBy("id").agg(F.count("*").alias("degree"), F.min("start").alias("first"), F.max(F.struct("gap", (-F.col("start")).alias("minus"))).alias("m"))
        start, sector = -F.col("m.minus") + padding, F.col("m.gap") - 2 * padding
        chosen = F.when(F.col("degree").isNull(), around).when(F.col("degree") == 1, one(F.col("first"), F.lit(G.TWO_PI))).when(sector > 0, one(start, sector)).otherwise(around)
        return hubs.join(widest, "id", "left").select("id", chosen.alias("sectors"))
    least = math.radians(options.low_threshold) + 2 * padding
    wide = found.where(F.col("gap") >= least).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("start", "gap"))).alias("gaps"))
    row = "struct<start:double,sector:double,quantity:int>"
    begin = F.struct(F.size("one_edges").alias("left"), F.array().cast(f"array<{row}>").alias("out"))

    def share(acc: Column, g: Column) -> Column:
        last = F.size(acc["out"]) + 1 == F.size("gaps")
        count = F.when(last, acc["left"]).otherwise(F.round(acc["left"] * g["gap"] / G.TWO_PI).cast("int"))
        made = F.struct((g["start"] + padding).alias("start"), (g["gap"] - 2 * padding).alias("sector"), count.alias("quantity"))
        return F.struct((acc["left"] - count).alias("left"), F.concat(acc["out"], F.array(made.cast(row))).alias("out"))

    shared = F.aggregate("gaps", begin, share, lambda acc: acc["out"])
    return hubs.join(wide, "id", "left").select("id", F.when(F.col("gaps").isNull(), around.cast(f"array<{row}>")).otherwise(shared).alias("sectors"))


def place_leaves(vertices: DataFrame, edges: DataFrame, hubs: DataFrame, strategy: str = "fair_share", options: ReintegrationOptions | None = None) -> DataFrame:
    """(id, hub, x, y) of every leaf. ``hubs`` has (id, one_edges); ``vertices`` the places and component of the hubs."""
    options = options or ReintegrationOptions()
    # Both are used several times: written once in buckets of the hub, they needn't be joined anew, nor dealt, for gaps, radius and leaves.
    n = bucket_count(edges)
    hubs = cut_buckets(hubs.repartition(n, "id"), "hubs", "id", n)
    rays = cut_buckets(hub_rays(vertices, edges, hubs), "rays", "id", n)
    cut_up = sectors(rays, hubs, strategy, options).select("id", F.explode("sectors").alias("s"), F.lit(0).alias("z"))
    before = F.coalesce(F.sum("s.quantity").over(Window.partitionBy("id").orderBy("s.start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = cut_up.withColumn("before", before).where("s.quantity > 0")
    spots = parts.select("id", "s", "before", F.explode(F.sequence(F.lit(0), F.col("s.quantity") - 1)).alias("nth"))
    spots = spots.select("id", (F.col("before") + F.col("nth")).cast("int").alias("pos"), on_sector(F.col("s.start"), F.col("s.sector"), F.col("s.quantity"), F.col("nth")).alias("angle"))
    leaves = hubs.select("id", F.posexplode(F.array_sort("one_edges")).alias("pos", "leaf"))
    centre = vertices.select("id", "component", F.col("x").alias("cx"), F.col("y").alias("cy"))
    out = leaves.join(spots, ["id", "pos"]).join(radius_of(rays, hubs, options), "id").join(centre, "id")
    return out.select(
        F.col("leaf").alias("id"), F.col("id").alias("hub"), "component", (F.col("cx") + F.cos("angle") * F.col("r")).alias("x"), (F.col("cy") + F.sin("angle") * F.col("r")).alias("y")
    )


def reintegrate(vertices: DataFrame, edges: DataFrame, hubs: DataFrame, strategy: str = "fair_share", options: ReintegrationOptions | None = None) -> tuple[DataFrame, DataFrame]:
    """Vertices with the leaves added (component of the hub), and edges with both directions to them."""
    leaves = place_leaves(vertices, edges, hubs, strategy, options)
    spokes = leaves.select(F.col("id").alias("src"), F.col("hub").alias("dst"), F.lit(1).alias("weight"))
    all_edges = edges.select("src", "dst", "weight").unionByName(spokes).unionByName(spokes.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    return vertices.select("id", "component", "x", "y").unionByName(leaves.select("id", "component", "x", "y")), all_edges


STRATEGIES = ("radial", "cone", "max_slope", "fair_share")
