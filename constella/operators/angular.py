"""Angular resolution: neighbours of a vertex are turned so that consecutive ones are a fair angle apart."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from constella.functions import geometry as G
from constella.iterate import cut


#: Neighbours that one task walks at about; a vertex with more is walked by ranges of the angle.
RANGE = 4096


def _sign(number: Column) -> Column:
    return F.when(number % 2 == 0, F.lit(1.0)).otherwise(F.lit(-1.0))


def _walked(rays: DataFrame, range_rows: int = RANGE) -> DataFrame:
    """Rays with n (neighbours of src), nth (by angle), first (angle) and carried: the running sum of the walk's terms up to each.

    The terms are the first angle and then, with changing signs, twice the angle minus a fair one. Ranges of the angle are numbered and summed by themselves; what
    stands before a range, a number and a sum whose sign the number turns, is added afterwards.
    """
    sizes = rays.groupBy("src").agg(F.count("*").alias("n"), F.min("angle").alias("first"))
    rays = rays.join(sizes.where("n > 2"), "src")
    rays = rays.withColumn("range", F.floor(F.col("angle") / G.TWO_PI * F.ceil(F.col("n") / range_rows)))
    inside = Window.partitionBy("src", "range").orderBy("angle", "dst")
    rays = rays.withColumn("own", F.row_number().over(inside) - 1)
    term = _sign(F.col("own")) * (2 * F.col("angle") - F.lit(G.TWO_PI) / F.col("n"))
    rays = rays.withColumn("term", term).withColumn("sum", F.sum("term").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    ranges = rays.groupBy("src", "range").agg(F.count("*").alias("held"), F.sum("term").alias("held_sum"))
    earlier = Window.partitionBy("src").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("before", F.coalesce(F.sum("held").over(earlier), F.lit(0)))
    ranges = ranges.withColumn("before_sum", F.coalesce(F.sum(_sign(F.col("before")) * F.col("held_sum")).over(earlier), F.lit(0.0)))
    rays = rays.join(ranges.select("src", "range", "before", "before_sum"), ["src", "range"])
    # The first term is the first angle instead of twice it minus a fair one.
    start = F.lit(G.TWO_PI) / F.col("n") - F.col("first")
    carried = F.col("before_sum") + _sign(F.col("before")) * F.col("sum") + start
    return rays.withColumns({"nth": F.col("before") + F.col("own"), "carried": carried})


def angular_suggestions(vertices: DataFrame, edges: DataFrame, ideal: float, angle_moderator: float = 1.0, move_moderator: float = 1.0, clockwise: bool = True, range_rows: int = RANGE) -> DataFrame:
    """(src, dst, nth, dx, dy): moves that each vertex of three neighbours or more suggests to them.

    Neighbours are walked by angle from the first one; the walk starts by comparing the first with the second and ends with the first
    again. Clockwise, turning each to a fair angle from the one before, whose angle was just changed, adds up to the first angle plus whole steps. The other
    way a step's gap is doubled instead of closed, angle' = 2 angle - previous' - fair: with changing signs this is a running sum. So no
    row holds a list of neighbours, and the neighbours of a hub (more than ``range_rows``) are walked by many tasks.
    """
    me = vertices.select(F.col("id").alias("src"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    you = vertices.select(F.col("id").alias("dst"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    aim = lambda r: r.withColumn("angle", G.polar(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")))
    fair = F.lit(2 * math.pi) / F.col("n")
    whole = Window.partitionBy("src")
    links = edges.select("src", "dst", "weight")
    hubs = cut(links.groupBy("src").agg(F.count("*").alias("n")).where(F.col("n") > range_rows).select("src"), "hubs")
    split = not hubs.isEmpty()
    # Around most vertices the walk stays in one task. Edges whose source has too few neighbours don't travel; the others do so twice, to the place of
    # their end and back.
    few = links.join(hubs, "src", "left_anti") if split else links
    few = few.withColumn("n", F.count("*").over(whole)).where("n > 2").select("src", "dst", "weight")
    few = aim(few.join(you, "dst").repartition("src").join(me, "src"))
    around = whole.orderBy("angle", "dst")
    few = few.withColumns({"n": F.count("*").over(whole), "first": F.min("angle").over(whole), "nth": F.row_number().over(around) - 1})
    if not clockwise:
        few = few.withColumn("carried", F.sum(_sign(F.col("nth")) * (2 * F.col("angle") - fair)).over(around.rowsBetween(Window.unboundedPreceding, 0)) + (fair - F.col("first")))
        few = few.withColumn("last", F.max(F.when(F.col("nth") == F.col("n") - 1, _sign(F.col("nth")) * F.col("carried"))).over(whole))
    rays = few
    if split:
        many = _walked(aim(links.join(hubs, "src", "left_semi").join(me, "src").join(you, "dst")), range_rows)
        if not clockwise:
            many = many.join(many.where("nth = n - 1").select("src", (_sign(F.col("nth")) * F.col("carried")).alias("last")), "src")
        rays = few.unionByName(many.select(*few.columns))
    if clockwise:
        target = F.when(F.col("nth") == 0, F.col("first") + fair * F.col("n")).otherwise(F.col("first") + fair * F.col("nth"))
    else:
        target = F.when(F.col("nth") == 0, 2 * F.col("first") - F.col("last") - fair).otherwise(_sign(F.col("nth")) * F.col("carried"))
    reach = F.col("weight") * F.lit(float(ideal))
    dx = move_moderator * (F.col("x1") + reach * F.cos(angle_moderator * target) - F.col("x2"))
    dy = move_moderator * (F.col("y1") + reach * F.sin(angle_moderator * target) - F.col("y2"))
    return rays.select("src", "dst", "nth", dx.alias("dx"), dy.alias("dy"))


def average_update(vertices: DataFrame, suggestions: DataFrame) -> DataFrame:
    """Every vertex moves by the mean of the moves suggested to it."""
    # Dealt as they are: sums and counts of parts would be wider than the few moves that they stand for.
    mean = suggestions.select(F.col("dst").alias("id"), "dx", "dy").repartition("id").groupBy("id").agg(F.avg("dx").alias("mx"), F.avg("dy").alias("my"))
    moved = vertices.join(mean, "id", "left")
    return moved.withColumns({"x": F.col("x") + F.coalesce("mx", F.lit(0.0)), "y": F.col("y") + F.coalesce("my", F.lit(0.0))}).select(*vertices.columns)


def maximise_angles(vertices: DataFrame, edges: DataFrame, ideal: float, **options) -> DataFrame:
    return average_update(vertices, angular_suggestions(vertices, edges, ideal, **options))
