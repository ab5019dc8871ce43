"""Many moves of a layout in one Spark job: whole components meet in a task, which moves them on arrays.

A component's moves depend on the component only, so no row has to travel between two moves. Components are dealt into bins by a hash, about
``BIN_ROWS`` pairs each; a bin is packed once into a row of arrays, and an epoch maps packed rows to packed rows with new places and the
number of converged vertices after each move. The driver adds these numbers up, finds the move that ends the layout and
repeats the last epoch up to it. Every epoch is written, so a lost executor costs one task's part of it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from constella.functions import geometry as G
from constella.iterate import cut, drop

#: Pairs and vertices of a bin, at about, and those of one component that a task takes at most: some 100 bytes each while forces are summed.
BIN_ROWS, TASK_ROWS = 500_000, 4_000_000
#: Moves of an epoch: as many as make about this many pairs of a bin, within the bounds.
EPOCH_PAIRS, EPOCH_MOVES = 100_000_000, (50, 1000)

_SCHEMA = "bin bigint, ids binary, degree binary, temp_x binary, temp_y binary, far binary, near binary, weight binary, x binary, y binary, counts array<bigint>"


def _pack(key: tuple, v: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
    v = v.sort_values("id")
    ids = v["id"].to_numpy(np.int64)
    pairs = pairs.sort_values(["dst", "src"])
    ends = np.stack([np.searchsorted(ids, pairs[c].to_numpy(np.int64)) for c in ("dst", "src")]).astype(np.int32)
    far = pairs["weight"].isna().to_numpy()
    blob = lambda x, kind: np.ascontiguousarray(x, kind).tobytes()
    doubles = {c: blob(v[c], np.float64) for c in ("degree", "temp_x", "temp_y", "x", "y")}
    return pd.DataFrame([{
        "bin": key[0], "ids": ids.tobytes(), **doubles, "far": ends[:, far].tobytes(), "near": ends[:, ~far].tobytes(),
        "weight": blob(pairs["weight"].to_numpy()[~far], np.float64), "counts": [],
    }])


def packed(vertices: DataFrame, state: DataFrame, ball: DataFrame, links: DataFrame, degree: DataFrame, rows: int) -> DataFrame:
    """One row for each bin of components. ``ball`` and ``links`` carry the component of their ends; ``rows``: pairs and vertices in all."""
    bins = max(1, -(-rows // BIN_ROWS))
    bin_ = F.pmod(F.xxhash64("component"), F.lit(bins)).alias("bin")
    v = vertices.join(state.select("component", "temp_x", "temp_y"), "component").join(degree, "id", "left")
    v = v.select(bin_, "id", "x", "y", F.coalesce("degree", F.lit(0)).cast("double").alias("degree"), "temp_x", "temp_y")
    far = ball.select(bin_, "dst", "src", F.lit(None).cast("double").alias("weight"))
    near = links.select(bin_, F.col("src").alias("dst"), F.col("dst").alias("src"), F.col("weight").cast("double").alias("weight"))
    return v.groupBy("bin").cogroup(far.unionByName(near).groupBy("bin")).applyInPandas(_pack, _SCHEMA)


def moved(pack: dict, model, ideal: float, strength: float, temperatures: list[float], accuracy: float) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Places after one move for each temperature, and the converged vertices after each."""
    array = lambda name, kind=np.float64: np.frombuffer(pack[name], kind)
    x, y, degree, tx, ty = (array(c) for c in ("x", "y", "degree", "temp_x", "temp_y"))
    (far_dst, far_src), (dst, src) = (array(c, np.int32).reshape(2, -1) for c in ("far", "near"))
    length, n, counts = array("weight") * ideal, len(x), []
    for t in temperatures:
        ax, ay = model.attraction(x[src] - x[dst], y[src] - y[dst], length, degree[dst], degree[src])
        rx, ry = model.repulsion(x[far_src] - x[far_dst], y[far_src] - y[far_dst], degree[far_dst], degree[far_src])
        fx = np.bincount(dst, ax, n) - np.bincount(far_dst, rx, n) * strength
        fy = np.bincount(dst, ay, n) - np.bincount(far_dst, ry, n) * strength
        size = G.norm(fx, fy)
        mx, my = fx / size * np.minimum(size, tx * t), fy / size * np.minimum(size, ty * t)
        x, y = x + mx, y + my
        counts.append(int((G.norm(mx, my) < accuracy).sum()))
    if np.isnan(x).any() or np.isnan(y).any():
        raise ValueError("a coordinate is not a number")
    return x, y, counts


@dataclass
class Epochs:
    """Components in bins, between epochs."""

    table: DataFrame
    model: object
    ideal: float
    strength: float
    accuracy: float
    length: int

    def run(self, temperatures: list[float]) -> tuple[DataFrame, list[int]]:
        """The bins after a move for each temperature (written), and the converged vertices after each move."""
        model, ideal, strength, accuracy = self.model, self.ideal, self.strength, self.accuracy
        names = [f.name for f in self.table.schema]

        def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for pack in batch.to_pylist():
                    x, y, counts = moved(pack, model, ideal, strength, temperatures, accuracy)
                    new = {**pack, "x": x.tobytes(), "y": y.tobytes(), "counts": counts}
                    yield pa.RecordBatch.from_arrays([pa.array([new[c]], f.type) for c, f in zip(names, batch.schema, strict=True)], names=names)

        out = cut(self.table.mapInArrow(go, _SCHEMA), "epoch")
        sums = out.select(F.posexplode("counts").alias("move", "n")).groupBy("move").agg(F.sum("n").alias("n"))
        got = dict(map(tuple, sums.collect()))
        return out, [got.get(i, 0) for i in range(len(temperatures))]

    def take(self, after: DataFrame) -> None:
        drop(self.table)
        self.table = after

    def places(self) -> DataFrame:
        """id, x, y of all vertices."""

        def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for pack in batch.to_pylist():
                    columns = [pa.array(np.frombuffer(pack[c], k)) for c, k in (("ids", np.int64), ("x", np.float64), ("y", np.float64))]
                    yield pa.RecordBatch.from_arrays(columns, names=["id", "x", "y"])

        return self.table.select("ids", "x", "y").mapInArrow(go, "id bigint, x double, y double")


def epoch_length(rows: int) -> int:
    """Moves of an epoch for ``rows`` pairs and vertices in all."""
    return min(max(EPOCH_PAIRS // max(min(rows, BIN_ROWS), 1), EPOCH_MOVES[0]), EPOCH_MOVES[1])
