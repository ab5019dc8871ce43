"""Cooling schedules and the parameters that adapt a layout to the size of a layer."""

from __future__ import annotations

import math
from dataclasses import dataclass


@dataclass(frozen=True)
class LinearCooling:
    speed: float

    def cool(self, temperature: float) -> float:
        return temperature * self.speed


@dataclass(frozen=True)
class NegativeExponentialCooling:
    speed: float

    def cool(self, temperature: float) -> float:
        return temperature * math.exp(-self.speed)


#: Upper bounds on the number of edges (exclusive) and the value below each; None: all others.
TEMPERATURE = [(250, 0.1), (500, 0.2), (10_000, 0.4), (None, 0.8)]
COOLING_SPEED = [(500, 0.98), (1_500, 0.96), (10_000, 0.94), (1_000_000, 0.92), (None, 0.9)]
ACCURACY = [(1_000, 1e-4), (10_000, 1e-3), (1_000_000, 1e-2), (None, 0.1)]
SIZE_K = [(1_000, 6), (5_000, 5), (10_000, 4), (100_001, 3), (1_000_001, 2), (None, 1)]


def _look_up(table: list, n_edges: int):
    return next(value for bound, value in table if bound is None or n_edges < bound)


class SizeDriven:
    """Hops of the ball from the number of edges."""

    def hops(self, layer: int, n_layers: int, n_vertices: int, n_edges: int) -> int:
        return _look_up(SIZE_K, n_edges)

    def temperature(self, layer: int, n_layers: int, n_vertices: int, n_edges: int) -> float:
        return _look_up(TEMPERATURE, n_edges)

    def cooling(self, layer: int, n_layers: int, n_vertices: int, n_edges: int) -> float:
        return _look_up(COOLING_SPEED, n_edges)

    def accuracy(self, layer: int, n_layers: int, n_vertices: int, n_edges: int) -> float:
        return _look_up(ACCURACY, n_edges)


class DensityDriven(SizeDriven):
    """Hops from edges per vertex. ``graded`` also uses the two middle steps, which the usual order of tests never reaches."""

    def __init__(self, graded: bool = False):
        self.graded = graded

    def hops(self, layer: int, n_layers: int, n_vertices: int, n_edges: int) -> int:
        density = n_edges / max(n_vertices, 1)
        if self.graded:
            return 3 if density > 4 else 4 if density > 2.5 else 5 if density > 1.5 else 6
        return 3 if density > 1.5 else 6


ADAPTATION = {"size": SizeDriven, "density": DensityDriven}


def hops_at(strategy: SizeDriven, layer: int, n_layers: int, n_vertices: int, n_edges: int) -> int:
    """Hops of a layer; the finest layer gets two at most."""
    k = strategy.hops(layer, n_layers, n_vertices, n_edges)
    return min(k, 2) if layer == 0 else k
