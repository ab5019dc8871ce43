"""k-hop balls: for every vertex all others within k edges, at their least distance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from constella.iterate import cut, cut_buckets, drop
from constella.operators.graph import bucket_count


#: Links of one vertex that one task extends a frontier by; a vertex with more is split.
BLOCK_LINKS = 2048


def k_hop_ball(edges: DataFrame, k: int, cut_steps: bool = True, block_links: int = BLOCK_LINKS, sources: DataFrame | None = None) -> DataFrame:
    """``dst, src, hop`` with hop from 1 to k, for any degrees; a vertex isn't in its own ball. ``sources`` (id) asks for the balls of these only.

    Each step extends the frontier of the last hop only, keyed by the vertex that it is at and a block of that vertex's links,
    so that the pairs through a hub are made by as many tasks as it has blocks.
    """
    links = edges.select("src", "dst").distinct()
    blocks = links.groupBy(F.col("dst").alias("at")).agg(F.ceil(F.count("*") / F.lit(block_links)).cast("int").alias("n"))
    outward = links.select(F.col("dst").alias("at"), F.col("src").alias("new")).join(blocks, "at")
    outward = outward.select("at", "new", F.pmod(F.xxhash64("new"), F.col("n")).cast("int").alias("block"))
    hubs = blocks.where("n > 1")
    ball = links.select("dst", "src", F.lit(1).alias("hop"))
    if sources is not None:
        ball = ball.join(sources.select(F.col("id").alias("dst")), "dst", "left_semi")
    frontier, written = ball, []
    for hop in range(2, k + 1):
        step = frontier.select("dst", F.col("src").alias("at")).join(hubs, "at", "left")
        step = step.select("dst", "at", F.explode(F.sequence(F.lit(0), F.coalesce("n", F.lit(1)) - 1)).alias("block")).join(outward, ["at", "block"])
        step = step.where("new <> dst").select("dst", F.col("new").alias("src")).distinct()
        frontier = step.join(ball.select("dst", "src"), ["dst", "src"], "left_anti").withColumn("hop", F.lit(hop))
        if cut_steps:
            frontier = cut(frontier, "ball")
            written.append(frontier)
        ball = ball.unionByName(frontier)
    # What a caller that copies the ball can delete then.
    ball._constella_parts = written
    return ball


def two_hop_sizes(edges: DataFrame, triangles: bool = True) -> DataFrame:
    """(id, reached): how many vertices lie within two links of each, without a row for each of them; exact, for any symmetric edges.

    Walks of two links that leave a vertex number the sum of its neighbours' degrees, the way back to it standing for the links themselves. What several
    walks or a link and a walk reach counts once: such vertices share two neighbours (opposite corners of a 4-cycle) or are linked and share one (a triangle).
    Of each cycle only the two links at a corner below its highest vertex, by degree and id, are made: one row for a link and each link of its lesser
    end at most. Corners that share c neighbours are opposite in c * (c - 1) / 2 cycles. Where cycles outnumber walks, the ball is listed instead.

    ``triangles=False`` leaves out the search for triangles, for graphs with links between two sides only.
    """
    # Counted over all links of a source where they lie, sent to the other end.
    links = edges.select("src", "dst").repartition(n := bucket_count(edges), "src").distinct()
    sent = links.select(F.col("dst").alias("at"), F.col("src").alias("nbr"), F.count("*").over(Window.partitionBy("src")).alias("degree"))
    dealt = sent.repartition(n, "at").withColumn("own", F.count("*").over(Window.partitionBy("at")))
    ranked = cut_buckets(dealt, "ranked", "at", n)
    walks = ranked.groupBy(F.col("at").alias("id")).agg(F.sum("degree").alias("walks"))

    up = ranked.where("degree > own or (degree = own and nbr > at)").select("at", F.col("nbr").alias("high"), F.col("degree").alias("most"))
    corners = up.join(ranked.select("at", F.col("nbr").alias("low"), "degree"), "at").where("degree < most or (degree = most and low < high)").select("high", "low", "at")
    if triangles:
        corners = corners.unionByName(up.select("high", F.col("at").alias("low"), F.lit(None).cast("bigint").alias("at")))
    same = Window.partitionBy("high", "low")
    met = corners.select("*", F.count("at").over(same).alias("n"), F.max(F.col("at").isNull()).over(same).alias("linked"))
    met = cut(met.where("at is not null and (n > 1 or linked)"), "corners")

    cycles = met.agg(F.sum(F.col("n") - 1)).first()[0] or 0
    if cycles > 2 * (walks.agg(F.sum("walks")).first()[0] or 0):
        drop(met, ranked)
        return k_hop_ball(edges, 2).groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("reached"))
    several = met.where("n > 1")
    tops = several.select(F.col("high").alias("a"), F.col("low").alias("b"), "n").distinct().select("a", "b", F.expr("n * (n - 1) div 2").alias("cycles"))
    other = several.select("high", "low", F.col("at").alias("b"))
    sides = several.select("high", "low", F.col("at").alias("a")).join(other, ["high", "low"]).where("a < b").select("a", "b", F.lit(1).cast("bigint").alias("cycles"))
    pairs = tops.unionByName(sides).groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("cycles").alias("cycles"))
    again = pairs.select("a", "b", F.round((F.sqrt(F.col("cycles") * 8 + 1) - 1) / 2).cast("bigint").alias("again"))
    if triangles:
        three = F.explode(F.array(*[F.struct(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")) for x, y in (("high", "low"), ("high", "at"), ("low", "at"))])).alias("e")
        again = again.unionByName(met.where("linked").select(three).select("e.a", "e.b").distinct().withColumn("again", F.lit(1).cast("bigint")))
    ends = again.select(F.explode(F.array("a", "b")).alias("id"), "again").groupBy("id").agg(F.sum("again").alias("again"))
    return walks.join(ends, "id", "left").select("id", (F.col("walks") - F.coalesce("again", F.lit(0))).alias("reached"))
