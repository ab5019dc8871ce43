"""Aggregates by component: sums, maxima, bounding boxes, sizes, set unions, and merges that users write."""

from __future__ import annotations

import pickle
from abc import ABC, abstractmethod
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def by_component(df: DataFrame, **aggregates: Column) -> DataFrame:
    """Any aggregates for each component; partial sums are formed before rows are dealt out."""
    return df.groupBy("component").agg(*[c.alias(name) for name, c in aggregates.items()])


def overwrite(old: DataFrame, new: DataFrame) -> DataFrame:
    """Per-component state in which rows of ``new`` replace those of ``old``."""
    return old.join(new.select("component"), "component", "left_anti").unionByName(new)


def bounding_boxes(vertices: DataFrame) -> DataFrame:
    return by_component(vertices, min_x=F.min("x"), min_y=F.min("y"), max_x=F.max("x"), max_y=F.max("y"))


def boxes_and_sizes(vertices: DataFrame) -> DataFrame:
    """Bounding box and number of vertices with the leaves that they stand for."""
    leaves = F.size("one_edges") if "one_edges" in vertices.columns else F.lit(0)
    return by_component(vertices, min_x=F.min("x"), min_y=F.min("y"), max_x=F.max("x"), max_y=F.max("y"), n=F.sum(F.lit(1) + leaves))


def id_union(df: DataFrame, column: str = "ids") -> DataFrame:
    """Set union of arrays of ids for each component, as a sorted array."""
    return df.select("component", F.explode(column).alias("i")).groupBy("component").agg(F.sort_array(F.collect_set("i")).alias(column))


class Merge(ABC):
    """An aggregate that a user writes: states of parts of a component are merged in any order, so ``merge`` has to be associative and commutative.

    ``schema`` names the result's columns besides ``component``.
    """

    schema: str

    @abstractmethod
    def state(self, rows: pd.DataFrame):
        """The state of some rows of one component."""

    @abstractmethod
    def merge(self, a, b):
        """One state for what both stand for."""

    @abstractmethod
    def result(self, state) -> tuple:
        """The result's values, in the order of ``schema``."""


#: Components whose states a task holds before it hands them on.
HELD_STATES = 50_000


def merged(df: DataFrame, merge: Merge, *columns: str) -> DataFrame:
    """``component`` and the result of a user's merge. Each task merges its own rows first; what travels is a state for each component and task."""
    rows = df.select("component", *columns)
    kind = rows.schema["component"].dataType.simpleString()

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for batch in batches:
            for component, some in batch.groupby("component", dropna=False):
                new = merge.state(some)
                held[component] = merge.merge(held[component], new) if component in held else new
            if len(held) >= HELD_STATES:
                yield _states(held)
                held = {}
        yield _states(held)

    def final(key: tuple, states: pd.DataFrame) -> pd.DataFrame:
        out = None
        for blob in states["state"]:
            one = pickle.loads(blob)
            out = one if out is None else merge.merge(out, one)
        return pd.DataFrame([(key[0], *merge.result(out))])

    parts = rows.mapInPandas(partial, f"component {kind}, state binary")
    return parts.groupBy("component").applyInPandas(final, f"component {kind}, {merge.schema}")


def _states(held: dict) -> pd.DataFrame:
    return pd.DataFrame({"component": list(held), "state": [pickle.dumps(s) for s in held.values()]})


class Hull(Merge):
    """Convex hull of a component's places: its corners (those on an edge left out), perimeter and area."""

    schema = "corners int, perimeter double, area double"

    def state(self, rows: pd.DataFrame) -> np.ndarray:
        return self._hull(rows[["x", "y"]].to_numpy(float))

    def merge(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self._hull(np.concatenate([a, b]))

    def result(self, state: np.ndarray) -> tuple:
        following = np.roll(state, -1, axis=0)
        cross = state[:, 0] * following[:, 1] - state[:, 1] * following[:, 0]
        return len(state), float(np.hypot(*(following - state).T).sum()), float(abs(cross.sum()) / 2)

    @staticmethod
    def _hull(points: np.ndarray) -> np.ndarray:
        points = np.unique(points, axis=0)
        if len(points) < 3:
            return points

        def chain(ordered) -> list:
            out: list = []
            for p in ordered:
                while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                    out.pop()
                out.append(p)
            return out[:-1]

        return np.array(chain(points.tolist()) + chain(points[::-1].tolist()))
