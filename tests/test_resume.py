"""Loops that are lost halfway and gone on with, in a catalogue that knows nothing of their tables."""

import uuid

import pytest
from plain_graph import draw
from pyspark.sql import functions as F
from test_plain import _as_drawn, close, graph, places, tables

from constella.manifest import Manifest
from constella.operators import layout, partition
from constella.plans import jobs
from constella.plans.config import Config


class Lost(Exception):
    """The driver's end."""


def forget(spark):
    """What a new session's catalogue holds: nothing. Files stay."""
    for r in spark.sql("SHOW TABLES").collect():
        spark.sql(f"DROP TABLE IF EXISTS {r.tableName}")


def after(n, f):
    """``f``, that ends the driver at its call number ``n``."""
    calls = []

    def wrapped(*args, **kwargs):
        calls.append(1)
        if len(calls) == n:
            raise Lost
        return f(*args, **kwargs)

    wrapped.calls = calls
    return wrapped


def test_partitioner(spark):
    v, e, _, _ = tables(spark, graph(5, 30, 30, 1))
    options = partition.PartitionOptions(partitions=5, max_iterations=11, threshold=0.0)
    whole, seen, name = partition.partition_graph(v, e, options), [], uuid.uuid4().hex

    def watch(number, _):
        seen.append(number)
        if seen == [1, 2]:
            raise Lost

    with pytest.raises(Lost):
        partition.partition_graph(v, e, options, watch, resume=name)
    forget(spark)
    with pytest.raises(ValueError):
        partition.partition_graph(v, e, partition.PartitionOptions(partitions=4), resume=name)
    out = partition.partition_graph(v, e, options, watch, resume=name)
    assert seen == [1, 2, 3, 4] and out.iterations == whole.iterations and out.metrics == whole.metrics
    assert sorted(map(tuple, out.labels.collect())) == sorted(map(tuple, whole.labels.collect()))
    assert Manifest(spark, name, "partition").load() is None


@pytest.mark.parametrize(("task_rows", "lost_at"), [(0, 3), (10**6, 2)])
def test_layer(spark, monkeypatch, task_rows, lost_at):
    """Placed tables after a move, and bins after an epoch."""
    pairs = graph(7, 12, 3)
    v, e, component, _ = tables(spark, pairs)
    rows = [(i, c, 600 * draw(i, 1), 500 * draw(i, 2)) for i, c in component.items()]
    start = spark.createDataFrame(rows, "id bigint, component bigint, x double, y double")
    limit = 4 if task_rows == 0 else 120
    options = layout.LayoutOptions(k=2, temp_factor=0.4, cooling=0.9, accuracy=0.0, limit=limit)
    monkeypatch.setattr(layout.epochs, "EPOCH_MOVES", (50, 50))
    whole, name = layout.layout_layer(start, e, options, task_rows=task_rows), uuid.uuid4().hex
    owner, method = (layout.Placed, "move") if task_rows == 0 else (layout.epochs.Epochs, "run")
    plain_method = getattr(owner, method)
    failing = after(lost_at, plain_method)
    monkeypatch.setattr(owner, method, lambda self, *a: failing(self, *a))
    with pytest.raises(Lost):
        layout.layout_layer(start, e, options, task_rows=task_rows, resume=name)
    forget(spark)
    counted = after(0, plain_method)
    monkeypatch.setattr(owner, method, lambda self, *a: counted(self, *a))
    out = layout.layout_layer(start, e, options, task_rows=task_rows, resume=name)
    assert len(counted.calls) == 2
    assert (out.iterations, out.pairs) == (whole.iterations, whole.pairs) == (limit, whole.pairs)
    close(places(out.vertices), places(whole.vertices), 1e-9)
    assert Manifest(spark, name, "layout").load() is None


def test_multilevel_job(spark, monkeypatch):
    """Lost while its second layer is drawn: the first isn't drawn again, and nothing is coarsened again."""
    v, e, _, _ = tables(spark, graph(11, 14, 2, 1))
    values = {"multi.layout.reintegrateOneDegrees": False}
    g = jobs.Graph(v.withColumn("one_edges", F.array().cast("array<bigint>")), e)
    whole = jobs.layout_multilevel(g, Config(values), pack=_as_drawn, limit=6)
    config, drawn = Config({**values, "job.resume": uuid.uuid4().hex}), jobs.layout_layer
    monkeypatch.setattr(jobs, "layout_layer", after(2, drawn))
    with pytest.raises(Lost):
        jobs.layout_multilevel(g, config, pack=_as_drawn, limit=6)
    forget(spark)
    again = after(0, drawn)
    monkeypatch.setattr(jobs, "layout_layer", again)
    monkeypatch.setattr(jobs, "coarsen", after(1, jobs.coarsen))
    out = jobs.layout_multilevel(g, config, pack=_as_drawn, limit=6)
    assert len(again.calls) == len(whole.metrics) - 1 and out.metrics == whole.metrics
    close(places(out.vertices), places(whole.vertices), 1e-9)
    with pytest.raises(ValueError):
        Manifest(spark, uuid.uuid4().hex, "x").save({}, {"t": spark.range(3)})
