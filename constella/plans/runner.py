"""Jobs from files to files: read lines, preprocess or lay out, write lines, configured by a map of keys.

From a shell: ``python -m constella.plans.runner JOB INPUT OUTPUT [key=value ...]`` with JOB preprocess, single, multilevel, or the dotted name of
a function of (graph, config) that returns a graph: the start of a computation of one's own. ``input.reader`` and ``output.writer`` name functions of (lines) that gives
vertices and edges, and of (vertices, edges, config) that gives lines.
"""

from __future__ import annotations

import sys
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from constella.plans import jobs
from constella.plans.config import Config
from constella.plans.named import named
from constella.sources import text


def _layout(graph: jobs.Graph, config: Config, multilevel: bool) -> jobs.Graph:
    draw = jobs.layout_multilevel if multilevel else jobs.layout_single
    return draw(graph, config, config.steps, named(config["layout.packer"], jobs.pack_components))


def _partition_lines(vertices: DataFrame, edges: DataFrame, config: Config) -> DataFrame:
    box = (config["partitioning.input.bBox.X"], config["partitioning.input.bBox.Y"], config["seed"])
    return text.partition_lines(vertices, edges, config["partitioning.output.showComponent"], config["partitioning.input.doRandomizeCoordinates"], *box)


def _layout_lines(vertices: DataFrame, edges: DataFrame, config: Config, bare_ids: bool = False) -> DataFrame:
    return text.layout_lines(vertices, edges, bare_ids=bare_ids, show_partition=config["layout.output.showPartitioning"], show_component=config["layout.output.showComponent"])


def run(spark: SparkSession, job: str, source: str, target: str, values: dict | None = None) -> jobs.Graph:
    """Run one job on the lines of ``source`` and write its lines to ``target``; the result is also returned."""
    config = Config(values)
    known = {
        "preprocess": (text.read_partition_input, lambda g: jobs.preprocess(g.vertices, g.edges, config), _partition_lines),
        "single": (text.read_layout_input, lambda g: _layout(g, config, False), _layout_lines),
        "multilevel": (text.read_layout_input, lambda g: _layout(g, config, True), partial(_layout_lines, bare_ids=True)),
    }
    if job in known:
        read, compute, write = known[job]
    else:
        start = named(job, None)
        if start is None:
            raise ValueError(f"unknown job {job}")
        read, compute, write = text.read_layout_input, lambda g: start(g, config), _layout_lines
    vertices, edges = named(config["input.reader"], read)(text.read_lines(spark, source))
    out = compute(jobs.Graph(vertices, edges))
    drawn = out.vertices
    if "part" in vertices.columns and "part" not in drawn.columns:
        # Leaves that come back have the partition of no one: 0.
        drawn = drawn.join(vertices.select("id", "part"), "id", "left").na.fill({"part": 0})
    text.write_lines(named(config["output.writer"], write)(drawn, out.edges, config), target)
    return out


def main(arguments: list[str]) -> None:
    job, source, target, *pairs = arguments
    spark = SparkSession.builder.appName(f"constella {job}").getOrCreate()
    out = run(spark, job, source, target, dict(p.split("=", 1) for p in pairs))
    jobs.metrics_table(spark, out).show(100, truncate=False)


if __name__ == "__main__":
    main(sys.argv[1:])
