"""What a user's configuration names in tests."""

import pandas as pd
from pyspark.sql import functions as F

from constella.functions import forces
from constella.operators import aggregates, layout
from constella.operators.graph import symmetrise
from constella.plans import jobs

CALLED = []


class Stiff(forces.FruchtermanReingold):
    """Attraction by a factor from the options."""

    def __init__(self, factor="1"):
        self.factor = float(factor)
        CALLED.append(("force", factor))

    def attraction(self, dx, dy, ideal, deg, other_deg):
        x, y = super().attraction(dx, dy, ideal, deg, other_deg)
        return x * self.factor, y * self.factor


def read_pairs(lines):
    """Lines ``a b``."""
    CALLED.append("reader")
    ends = F.split("value", " ")
    edges = symmetrise(lines.select(ends[0].cast("bigint").alias("src"), ends[1].cast("bigint").alias("dst")))
    vertices = edges.select(F.col("src").alias("id")).distinct().withColumns({"component": F.lit(0).cast("bigint"), "one_edges": F.array().cast("array<bigint>")})
    return vertices, edges


def write_places(vertices, edges, config):
    CALLED.append("writer")
    return vertices.select(F.concat_ws(" ", "id", F.round("x", 3), F.round("y", 3)).alias("value"))


def seed(*a):
    CALLED.append("seeder")
    return layout.move(*a)


def start(graph, config):
    """A job of one's own: vertices at their id."""
    at = graph.vertices.withColumns({"x": F.col("id") * 1.0, "y": F.lit(config["seed"]) * 1.0})
    return jobs.Graph(at, graph.edges, [{"started": 1}])


class Longest(aggregates.Merge):
    """The two largest values of a component."""

    schema = "first double, second double"

    def state(self, rows: pd.DataFrame):
        return sorted(rows["x"], reverse=True)[:2]

    def merge(self, a, b):
        return sorted([*a, *b], reverse=True)[:2]

    def result(self, state):
        return (*state, *[None] * (2 - len(state)))
