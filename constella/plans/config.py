"""Configuration keys of the three jobs and their defaults."""

from __future__ import annotations

from constella.functions import geometry as G
from constella.functions.forces import FORCES
from constella.functions.schedules import ADAPTATION, SizeDriven
from constella.operators.layout import LayoutOptions, Steps
from constella.operators.partition import PartitionOptions
from constella.operators.reintegrate import STRATEGIES, ReintegrationOptions
from constella.plans.named import named

#: Keys and their defaults.
DEFAULTS = {
    "spinner.numberOfPartitions": 32,
    "spinner.additionalCapacity": 0.1,
    "spinner.lambda": 1.0,
    "spinner.maxIterations": 250,
    "spinner.threshold": 0.001,
    "spinner.weight": 1,
    "spinner.repartition": 0,
    "spinner.windowSize": 5,
    "partitioning.input.doRandomizeCoordinates": True,
    "partitioning.input.bBox.X": 1200.0,
    "partitioning.input.bBox.Y": None,
    "partitioning.output.showComponent": True,
    "partitioning.pruneOneDegrees": True,
    "partitioning.computeComponents": True,
    "layout.limit": 10000,
    "layout.convergence-threshold": 0.85,
    "layout.node_length": 20.0,
    "layout.node_width": 20.0,
    "layout.node_separation": 20.0,
    "layout.walshawModifier": 1.0,
    "layout.enhanceRepulsiveForcesBy": 2.0,
    "layout.repulsiveForceModerationFactor": None,
    "layout.minRatioThreshold": 0.2,
    "layout.output.showPartitioning": False,
    "layout.output.showComponent": True,
    "layout.forceModel": "FR",
    "layout.forceModel.extraOptions": "",
    "layout.angularModeration": 1.0,
    "layout.translationModeration": 1.0,
    "reintegration.radius": 0.2,
    "reintegration.dynamicRadius": True,
    "reintegration.coneWidth": 90.0,
    "reintegration.anglePadding": 2.0,
    "reintegration.fairLowThreshold": 2.0,
    "reintegration.componentPadding": 20.0,
    "reintegration.reintegratingClass": "fair_share",
    "multi.layout.reintegrateOneDegrees": True,
    "multi.layout.adaptationStrategy": "size",
    "merger.SunChance": 0.1,
    "merger.convergenceThreshold": 7,
    "placer.destroyLevels": True,
    "seed": 42,
    # Dotted names of what replaces a part: readers and writers of lines, parts of a layout, packing.
    "input.reader": None,
    "output.writer": None,
    "layout.explorer": None,
    "layout.scaler": None,
    "layout.reach": None,
    "layout.propagator": None,
    "layout.seeder": None,
    "layout.packer": None,
    "job.resume": None,
}
#: Keys without a default whose values are text.
_TEXT = ("input.reader", "output.writer", "layout.explorer", "layout.scaler", "layout.reach", "layout.propagator", "layout.seeder", "layout.packer", "job.resume")


def _typed(value, default):
    """A value given as text in the type of its default."""
    if not isinstance(value, str) or isinstance(default, str):
        return value
    if isinstance(default, bool):
        return value.strip().lower() == "true"
    return type(default)(value) if default is not None else float(value)


class Config:
    """Values by key, given as they are or as text. Keys that nothing reads, such as those of logs, are kept and have no effect."""

    def __init__(self, values: dict | None = None):
        self.values = {**DEFAULTS, **{k: _typed(v, "" if k in _TEXT else DEFAULTS.get(k, "")) for k, v in (values or {}).items()}}

    def __getitem__(self, key: str):
        return self.values[key]

    @property
    def angular(self) -> dict:
        return {"ideal": self.ideal, "angle_moderator": self["layout.angularModeration"], "move_moderator": self["layout.translationModeration"]}

    @property
    def ideal(self) -> float:
        return G.ideal_edge(self["layout.node_length"], self["layout.node_width"], self["layout.node_separation"])

    @property
    def adaptation(self):
        given = self["multi.layout.adaptationStrategy"]
        found = ADAPTATION.get(given) if isinstance(given, str) else given
        found = named(given, SizeDriven) if found is None else found
        return found() if isinstance(found, type) else found

    @property
    def steps(self) -> Steps:
        """The parts of a layout, those that are named replaced."""
        base = Steps()
        return Steps(*[named(self[f"layout.{key}"], old) for key, old in (("explorer", base.explore), ("scaler", base.scale), ("reach", base.reach), ("propagator", base.propagate), ("seeder", base.seed))])

    @property
    def force(self):
        """A model's name, or a model made by the class that is named, from the options where there are any."""
        given, options = self["layout.forceModel"], self["layout.forceModel.extraOptions"]
        found = given if given in FORCES else named(given, "FR")
        return (found(options) if options else found()) if isinstance(found, type) else found

    @property
    def reintegrating(self):
        given = self["reintegration.reintegratingClass"]
        return given if given in STRATEGIES else named(given, "fair_share")

    def layout(self, **changed) -> LayoutOptions:
        base = {
            "limit": self["layout.limit"], "convergence": self["layout.convergence-threshold"], "enhancer": self["layout.enhanceRepulsiveForcesBy"],
            "walshaw_modifier": self["layout.walshawModifier"], "repulsion_factor": self["layout.repulsiveForceModerationFactor"],
            "force": self.force, "force_options": self["layout.forceModel.extraOptions"], "ideal": self.ideal,
        }
        return LayoutOptions(**{**base, **changed})

    def partition(self) -> PartitionOptions:
        return PartitionOptions(
            self["spinner.numberOfPartitions"], self["spinner.additionalCapacity"], self["spinner.lambda"], self["spinner.maxIterations"], self["spinner.threshold"],
            self["spinner.windowSize"], self["spinner.repartition"], self["seed"],
        )

    def reintegration(self) -> ReintegrationOptions:
        return ReintegrationOptions(
            self["reintegration.radius"], self["reintegration.dynamicRadius"], self["reintegration.coneWidth"], self["reintegration.anglePadding"],
            self["reintegration.fairLowThreshold"], self.ideal,
        )
