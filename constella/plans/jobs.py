"""The three jobs: preprocessing, single-layer layout, multilevel layout."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from constella.functions.schedules import hops_at
from constella.iterate import cut, drop
from constella.manifest import Manifest, plain_values, written
from constella.operators.aggregates import bounding_boxes
from constella.operators.coarsen import Layer, coarsen
from constella.operators.components import connected_components
from constella.operators.graph import random_places, symmetrise
from constella.operators.layout import Steps, layout_layer
from constella.operators.pack import apply_packing, pack_components
from constella.operators.partition import partition_graph
from constella.operators.place import coarsest_places, place_bodies
from constella.operators.prune import prune_leaves, with_leaves
from constella.operators.reintegrate import reintegrate
from constella.plans.config import Config


@dataclass
class Graph:
    vertices: DataFrame
    edges: DataFrame
    metrics: list[dict] = field(default_factory=list)


def metrics_table(spark: SparkSession, graph: Graph) -> DataFrame:
    """The counters of a job as rows (step, name, value)."""
    rows = [(step, name, float(value)) for step, m in enumerate(graph.metrics) for name, value in m.items() if value is not None]
    return spark.createDataFrame(rows, "step int, name string, value double")


def prepare(vertices: DataFrame, edges: DataFrame, config: Config) -> Graph:
    """Components and pruned leaves, listed at their hubs."""
    edges = cut(symmetrise(edges, config["spinner.weight"]), "edges")
    if config["partitioning.computeComponents"]:
        vertices = vertices.drop("component").join(connected_components(vertices, edges), "id")
    elif "component" not in vertices.columns:
        vertices = vertices.withColumn("component", F.lit(-1).cast("bigint"))
    if config["partitioning.pruneOneDegrees"]:
        pruned = prune_leaves(vertices, edges)
        vertices, edges = with_leaves(pruned.vertices, pruned), pruned.edges
    else:
        vertices = vertices.withColumn("one_edges", F.array().cast("array<bigint>"))
    return Graph(cut(vertices, "vertices"), cut(edges, "edges"))


def preprocess(vertices: DataFrame, edges: DataFrame, config: Config | None = None) -> Graph:
    """Components, pruned leaves and partitions: the input of both layout jobs. With ``job.resume`` a run that was lost is gone on with."""
    config = config or Config()
    kept = Manifest(vertices.sparkSession, config["job.resume"], "preprocess", {"partition": plain_values(config.partition())})
    before = kept.load()
    if before:
        vertices, edges = before[1]["vertices"], before[1]["edges"]
    else:
        prepared = prepare(vertices, edges, config)
        vertices, edges = prepared.vertices, prepared.edges
        kept.save({}, {"vertices": vertices, "edges": edges})
    done = partition_graph(vertices, edges, config.partition(), resume=kept.part("partition"))
    kept.end()
    return Graph(vertices.drop("part").join(done.labels, "id"), edges, done.metrics)


def _places(vertices: DataFrame, config: Config) -> DataFrame:
    if {"x", "y"} <= set(vertices.columns) and not config["partitioning.input.doRandomizeCoordinates"]:
        return vertices
    return random_places(vertices, config["partitioning.input.bBox.X"], config["partitioning.input.bBox.Y"], config["seed"])


def finish(vertices: DataFrame, edges: DataFrame, hubs: DataFrame, config: Config, pack: Callable = pack_components) -> Graph:
    """Leaves around their hubs, then all components in one grid."""
    if config["multi.layout.reintegrateOneDegrees"]:
        vertices, edges = reintegrate(vertices, edges, hubs, config.reintegrating, config.reintegration())
    vertices = cut(vertices.select("id", "component", "x", "y"), "drawn")
    sizes = vertices.groupBy("component").agg(F.count("*").alias("n"))
    packing = pack(bounding_boxes(vertices).join(sizes, "component"), config["reintegration.componentPadding"], config["layout.minRatioThreshold"])
    return Graph(apply_packing(vertices, packing), edges)


def _part(vertices: DataFrame) -> list[str]:
    """The partition, where it is known: layouts place their tables by it."""
    return [c for c in vertices.columns if c == "part"]


def _hubs(vertices: DataFrame) -> DataFrame:
    return vertices.where(F.size("one_edges") > 0).select("id", "one_edges")


def layout_single(graph: Graph, config: Config | None = None, steps: Steps | None = None, pack: Callable = pack_components, **options) -> Graph:
    """One layer with fixed parameters, then leaves and packing. ``steps`` and ``pack`` replace parts of the job."""
    config = config or Config()
    start = _places(graph.vertices, config)
    start = cut(start.select("id", "component", *_part(start), "x", "y", "one_edges"), "start")
    drawn = layout_layer(start, graph.edges, config.layout(**{"k": 3, **options}), steps=steps, resume=config["job.resume"])
    out = finish(drawn.vertices, graph.edges, _hubs(graph.vertices), config, pack)
    out.metrics = [{"layer": 0, "iterations": drawn.iterations, "hops": drawn.ball_rows_hops, "messages": drawn.pairs * drawn.iterations}]
    return out


#: Tables of a layer that a manifest names.
_LAYER_TABLES = ("vertices", "edges", "bodies", "proxies", "paths")


def _layer_tables(layers: list[Layer]) -> dict[str, DataFrame]:
    for layer in layers:
        for t in _LAYER_TABLES:
            if getattr(layer, t) is not None:
                setattr(layer, t, written(getattr(layer, t), f"layer-{t}"))
    return {f"{t}{layer.number}": getattr(layer, t) for layer in layers for t in _LAYER_TABLES}


def layout_multilevel(graph: Graph, config: Config | None = None, steps: Steps | None = None, pack: Callable = pack_components, **options) -> Graph:
    """Coarsen, draw the coarsest layer, then place and draw each finer one; leaves and packing last.

    With ``job.resume`` the layers, and the places after each, are named in a manifest, and so are the moves inside a layer: a run that was lost is
    gone on with after its last epoch.
    """
    config = config or Config()
    adapt, ideal, seed = config.adaptation, config.ideal, config["seed"]
    kept = Manifest(graph.vertices.sparkSession, config["job.resume"], "multilevel", {**plain_values(config.layout(**options)), "adaptation": type(adapt).__qualname__, "seed": seed})
    before = kept.load()
    if before:
        values, tables = before
        layers = [Layer(**facts, **{t: tables.get(f"{t}{facts['number']}") for t in _LAYER_TABLES}) for facts in values["layers"]]
        places, metrics = tables["places"], values["metrics"]
    else:
        layers, metrics = coarsen(graph.vertices, graph.edges, config["merger.convergenceThreshold"], config["merger.SunChance"], seed), []
        places = coarsest_places(layers[-1], config["partitioning.input.bBox.X"], config["partitioning.input.bBox.Y"], seed)

    def keep() -> None:
        nonlocal places
        places = written(places, "places")
        facts = [{"number": x.number, "n_vertices": x.n_vertices, "n_edges": x.n_edges, "max_weight": x.max_weight} for x in layers]
        kept.save({"layers": facts, "metrics": metrics}, {**_layer_tables(layers), "places": places})

    if kept.name and not before:
        keep()
    for layer in reversed(layers[: len(layers) - len(metrics)]):
        if layer.number < len(layers) - 1:
            above = layers[layer.number + 1]
            places = place_bodies(layer, places, above.edges, ideal, seed)
        facts = (layer.number, len(layers), layer.n_vertices, layer.n_edges)
        chosen = config.layout(**{"k": hops_at(adapt, *facts), "temp_factor": adapt.temperature(*facts), "cooling": adapt.cooling(*facts), "accuracy": adapt.accuracy(*facts), **options})
        start = cut(places.select("id", "component", *_part(places), "x", "y"), "start")
        drawn = layout_layer(start, layer.edges, chosen, layer.max_weight, rescale=layer.number == len(layers) - 1, steps=steps, resume=kept.part(f"layer{layer.number}"))
        places = drawn.vertices
        if config["placer.destroyLevels"] and not kept.name and layer.number < len(layers) - 1:
            above = layers[layer.number + 1]
            drop(above.vertices, above.edges, above.bodies, above.proxies, above.paths, start)
        metrics.append({
            "layer": layer.number, "n_layers": len(layers), "n_vertices": layer.n_vertices, "n_edges": layer.n_edges, "max_edge_weight": layer.max_weight, "iterations": drawn.iterations, "hops": drawn.ball_rows_hops,
            "temperature_factor": chosen.temp_factor, "cooling": chosen.cooling, "accuracy": chosen.accuracy, "messages": drawn.pairs * drawn.iterations,
        })
        if kept.name:
            keep()
    out = finish(places, graph.edges, _hubs(graph.vertices), config, pack)
    out.metrics = metrics
    if kept.name:
        kept.end()
        if config["placer.destroyLevels"]:
            drop(*_layer_tables(layers[1:]).values())
    return out
