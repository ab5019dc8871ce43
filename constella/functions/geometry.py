"""Plane geometry as column expressions, with zero lengths replaced by a small number.

Lengths are made of numpy arrays as well, by the same arithmetic.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: what a length of zero counts as.
TINY = 1e-5
TWO_PI = 2 * math.pi


def fuzzy(value):
    if isinstance(value, Column):
        return F.when(value == 0, F.lit(TINY)).otherwise(value)
    return np.where(value == 0, TINY, value)


def _root(value):
    return F.sqrt(value) if isinstance(value, Column) else np.sqrt(value)


def square_distance(dx, dy):
    return fuzzy(dx * dx + dy * dy)


def norm(dx, dy):
    return fuzzy(_root(dx * dx + dy * dy))


def distance(dx, dy):
    return _root(square_distance(dx, dy))


def polar(dx: Column, dy: Column) -> Column:
    """Angle of a direction in [0, 2 pi)."""
    angle = F.atan2(dy, dx)
    return F.when(angle < 0, angle + F.lit(TWO_PI)).otherwise(angle)


def angle_between(dx1: Column, dy1: Column, dx2: Column, dy2: Column) -> Column:
    """Directed angle from the first direction to the second, in [0, 2 pi)."""
    turn = F.atan2(dy2, dx2) - F.atan2(dy1, dx1)
    return F.when(turn < 0, turn + F.lit(TWO_PI)).otherwise(turn)


def ideal_edge(length: float = 20.0, width: float = 20.0, separation: float = 20.0) -> float:
    """The edge length that leaves ``separation`` between two nodes of the given size."""
    return separation + math.sqrt(length * length + width * width)


def vertex_text(part: Column, id_: Column, layer: Column | None = None) -> Column:
    """``part_id`` or ``part_id_layer``."""
    parts = [part, id_] if layer is None else [part, id_, layer]
    return F.concat_ws("_", *[p.cast("string") for p in parts])


def parse_vertex_text(text: Column) -> Column:
    pieces = F.split(text, "_")
    return F.struct(pieces[0].cast("int").alias("part"), pieces[1].cast("bigint").alias("id"), F.try_element_at(pieces, F.lit(3)).cast("int").alias("layer"))
