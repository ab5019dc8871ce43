"""Balls of graphs with hubs, factored: the pairs that a hub brings together are never rows.

Two vertices are within k edges if a path that avoids all hubs says so, or if their distances from some hub add up to k at most. So a ball is kept as
the pairs of the graph without its hubs, listed, and as one star for each hub: what lies within k of it, with the
distance. That is linear in the edges around a hub, where the pairs are quadratic. They are made block by block while forces are
summed, and each belongs to the smallest hub that brings it together, so that it counts once.

Defined results: any degrees; a graph without hubs has no stars, and its pairs are the whole ball; k of 1 has no stars either, as links say it all.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from constella.iterate import cut, drop
from constella.operators.ball import k_hop_ball

#: A vertex of more links is a hub. The pairs of fewer are fewer than a task of an epoch takes (``epochs.TASK_ROWS``, the square).
HUB_LINKS = 2000
#: Members of a star in a block: a task holds some matrices of this size squared.
STAR_BLOCK = 1024
#: Members of a block that meet another one at once: their matrices stay in the processor's cache.
STRIP = 32


@dataclass
class FactoredBall:
    """``pairs`` (dst, src) that no hub brings together, and ``stars``: hub, id, hop, block (by distance), last (the last block that meets it),
    near_hubs and near_hops (smaller hubs within k of the vertex, which own what they bring together)."""

    pairs: DataFrame
    stars: DataFrame
    written: list[DataFrame] = field(default_factory=list)

    def drop(self) -> None:
        drop(*self.written)


def factored_ball(edges: DataFrame, hubs: DataFrame, k: int, block: int = STAR_BLOCK) -> FactoredBall:
    """The ball of all vertices within ``k`` edges around ``hubs`` (id), any set of vertices."""
    links, hubs = edges.select("src", "dst").distinct(), hubs.select("id")
    if k < 2:
        hubs = hubs.where(F.lit(False))
    around = k_hop_ball(links, k, sources=hubs)
    members = around.select(F.col("dst").alias("hub"), F.col("src").alias("id"), "hop").unionByName(hubs.select(F.col("id").alias("hub"), "id", F.lit(0).alias("hop")))
    members = cut(members, "members")
    drop(*around._constella_parts)
    # Blocks of one distance each, numbered from the hub outwards: those that a block meets are the first ones.
    sizes = members.groupBy("hub").agg(*[F.ceil(F.count_if(F.col("hop") == h) / F.lit(block)).cast("int").alias(f"b{h}") for h in range(k + 1)])
    upto = lambda holds: reduce(Column.__add__, [F.when(holds(h), F.col(f"b{h}")).otherwise(0) for h in range(k + 1)])
    own = reduce(lambda rest, h: F.when(F.col("hop") == h, F.col(f"b{h}")).otherwise(rest), range(k + 1), F.lit(1))
    # As many as there are hubs within k of a vertex: 2 edges / HUB_LINKS in the whole graph at most.
    near = cut(members.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("hub", "hop"))).alias("near")), "near")
    smaller = F.filter("near", lambda x: x["hub"] < F.col("hub"))
    stars = members.join(sizes, "hub").join(near, "id").select(
        "hub", "id", "hop",
        (upto(lambda h: F.lit(h) < F.col("hop")) + F.pmod(F.xxhash64("id"), own).cast("int")).alias("block"),
        (upto(lambda h: F.lit(h) + F.col("hop") <= k) - 1).alias("last"),
        smaller["hub"].alias("near_hubs"), smaller["hop"].alias("near_hops"),
    )
    stars = cut(stars, "stars")
    rest = links.join(hubs.select(F.col("id").alias("src")), "src", "left_anti").join(hubs.select(F.col("id").alias("dst")), "dst", "left_anti")
    listed = k_hop_ball(rest, k)
    mine, theirs = near.toDF("dst", "near"), near.toDF("src", "other")
    both = listed.select("dst", "src").join(mine, "dst", "left").join(theirs, "src", "left")
    meet = F.exists("near", lambda a: F.exists("other", lambda b: (a["hub"] == b["hub"]) & (a["hop"] + b["hop"] <= k)))
    pairs = cut(both.where(~F.coalesce(meet, F.lit(False))).select("dst", "src"), "ball")
    drop(members, near, *listed._constella_parts)
    return FactoredBall(pairs, stars, [pairs, stars])


class _Side:
    """Arrays of one block's rows."""

    def __init__(self, table: pa.Table):
        self.n = table.num_rows
        self.id, self.x, self.y, self.degree = (table[c].to_numpy() for c in ("id", "x", "y", "deg"))
        self.table = table
        lists = table["near_hubs"].combine_chunks()
        row = np.repeat(np.arange(self.n), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        hubs, hops = lists.flatten().to_numpy(zero_copy_only=False), table["near_hops"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        order = np.argsort(hubs, kind="stable")
        self.hubs, self.hops, self.row = hubs[order], hops[order], row[order]
        self.distinct = np.unique(self.hubs)

    def from_hub(self, hub: int, far: int) -> np.ndarray:
        """Distance of each row from a hub, ``far`` where it isn't near."""
        a, b = np.searchsorted(self.hubs, [hub, hub + 1])
        out = np.full(self.n, far, np.int64)
        out[self.row[a:b]] = self.hops[a:b]
        return out


def _pushes(model, strength: float, k: int) -> Callable[[pa.Table], pa.Table]:
    def push(table: pa.Table) -> pa.Table:
        table = table.sort_by([("block", "ascending"), ("id", "ascending")])
        first, last = table["i"][0].as_py(), table["j"][0].as_py()
        block = table["block"].to_numpy()
        a = _Side(table.slice(0, int((block == first).sum())))
        b = a if first == last else _Side(table.slice(a.n))
        # Most blocks belong to their hub alone: then all of their pairs count, and no table of them is made.
        shared = np.intersect1d(a.distinct, b.distinct, assume_unique=True).tolist()
        owned = np.ones((a.n, b.n), bool) if shared else None
        for hub in shared:
            owned &= a.from_hub(hub, k + 1)[:, None] + b.from_hub(hub, k + 1)[None, :] > k
        sides = [(a, b, owned)] if a is b else [(a, b, owned), (b, a, None if owned is None else owned.T)]
        out = []
        for me, other, mask in sides:
            fx, fy, partners = np.empty(me.n), np.empty(me.n), np.full(me.n, other.n, np.int64)
            for low in range(0, me.n, STRIP):
                rows = slice(low, low + STRIP)
                dx, dy = other.x[None, :] - me.x[rows, None], other.y[None, :] - me.y[rows, None]
                found = model.repulsion(dx, dy, me.degree[rows, None], other.degree[None, :])
                counted = mask[rows] if mask is not None else np.ones(dx.shape, bool) if a is b else None
                if a is b:
                    # None of a star meets itself.
                    np.fill_diagonal(counted[:, low:], False)
                if counted is not None:
                    found = [np.where(counted, r, 0.0) for r in found]
                    partners[rows] = counted.sum(axis=1)
                fx[rows], fy[rows] = (-strength * np.broadcast_to(r, dx.shape).sum(axis=1) for r in found)
            out.append(pa.table({"slot": me.table["slot"], "id": me.table["id"], "fx": fx, "fy": fy, "partners": partners}))
        return pa.concat_tables(out)

    return push


def star_forces(members: DataFrame, model, strength: float, k: int) -> DataFrame:
    """slot, id, fx, fy, partners: what pairs of each two blocks of a star add to repulsion; several rows a vertex.

    ``members`` are rows of stars with slot, x, y and deg. Two blocks meet in a task once, for both directions.
    """
    met = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("last")))).where("last >= 0")
    rows = met.select("hub", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "slot", "id", "x", "y", F.col("deg").cast("double").alias("deg"), "near_hubs", "near_hops")
    return rows.groupBy("hub", "i", "j").applyInArrow(_pushes(model, strength, k), "slot int, id bigint, fx double, fy double, partners bigint")
