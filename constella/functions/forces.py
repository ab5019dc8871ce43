"""Force models: attraction along an edge and repulsion between two vertices, on columns or on numpy arrays alike.

``dx, dy`` point from the vertex to the other one. A model whose arithmetic holds for arrays too says so by ``on_arrays``.
"""

from __future__ import annotations

from constella.functions import geometry as G


class FruchtermanReingold:
    on_arrays = True

    def attraction(self, dx, dy, ideal, deg, other_deg) -> tuple:
        pull = G.distance(dx, dy) / ideal
        return dx * pull, dy * pull

    def repulsion(self, dx, dy, deg, other_deg) -> tuple:
        push = 1.0 / G.square_distance(dx, dy)
        return dx * push, dy * push


class LinLog:
    on_arrays = True

    def __init__(self, constant: float = 25.0):
        self.constant = constant

    def attraction(self, dx, dy, ideal, deg, other_deg) -> tuple:
        pull = self.constant / G.distance(dx, dy)
        return dx * pull, dy * pull

    def repulsion(self, dx, dy, deg, other_deg) -> tuple:
        push = deg * 1.0 * other_deg / G.square_distance(dx, dy)
        return dx * push, dy * push


FORCES = {"FR": FruchtermanReingold, "LinLog": LinLog}


def force_model(name: str, options: str = ""):
    """A registered model by name, or any object with ``attraction`` and ``repulsion``; unknown names give the default."""
    if not isinstance(name, str):
        return name
    kind = FORCES.get(name, FruchtermanReingold)
    return kind(float(options)) if options and kind is LinLog else kind()
