"""Loops of the graph engine against plain Python versions."""

import random

import plain_graph as plain
import pytest
from pyspark.sql import functions as F


from constella.functions import geometry as G
from constella.functions import schedules
from constella.iterate import settings
from constella.operators import hubs, layout, partition
from constella.operators.coarsen import coarsen
from constella.operators.components import connected_components
from constella.operators.graph import symmetrise, vertices_of
from constella.operators.place import coarsest_places, place_bodies
from constella.plans import jobs
from constella.plans.config import Config

IDEAL = G.ideal_edge()


def graph(seed, n, m, parts=2):
    """A few connected pieces with a hub, weights of 1."""
    r, pairs = random.Random(seed), set()
    for c in range(parts):
        base = 100 * c
        pairs |= {(base + i, base + r.randrange(i)) for i in range(1, n)}
        pairs |= {tuple(r.sample(range(base, base + n), 2)) for _ in range(m)}
        pairs |= {(base, base + i) for i in range(1, n, 3)}
    return sorted({(max(p), min(p)) for p in pairs})


def tables(spark, pairs):
    e = symmetrise(spark.createDataFrame(pairs, "src bigint, dst bigint")).cache()
    v = connected_components(vertices_of(e), e).cache()
    return v, e, dict(map(tuple, v.collect())), {(r.src, r.dst): r.weight for r in e.collect()}


def close(got, want, tolerance=1e-6):
    assert set(got) == set(want)
    assert max(abs(a - b) for v in want for a, b in zip(got[v], want[v], strict=True)) < tolerance


def places(df):
    return {r.id: (r.x, r.y) for r in df.collect()}


def test_partition_rounds(spark):
    """Kept counts give the labels of a full recomputation in each round, isolated vertices keep theirs."""
    v, e, component, edges = tables(spark, graph(5, 40, 40, 1))
    more = v.select("id").unionByName(spark.createDataFrame([(999,)], "id bigint"))
    options = partition.PartitionOptions(partitions=5, max_iterations=11, threshold=0.0)
    seen = {}
    out = partition.partition_graph(more, e, options, lambda n, labels: seen.update({n: dict(map(tuple, labels.collect()))}))
    want = plain.partition_rounds([*component, 999], edges, 5, out.iterations)
    assert out.iterations == 4 and all(seen[n] == want[n] for n in range(1, 5)) and dict(map(tuple, out.labels.collect())) == want[-1]
    moves = [sum(a[v] != b[v] for v in a) for a, b in zip(want, want[1:], strict=False)]
    assert [m["migrations"] for m in out.metrics[: len(moves)]] == moves and sum(moves) > 10


def test_state_chooses_as_the_edges_do(spark):
    """``choose`` from kept counts equals ``best_labels`` of ``scores``."""
    v, e, _, _ = tables(spark, graph(9, 30, 30, 1))
    options = partition.PartitionOptions(partitions=4)
    labels, degree = partition.initial_labels(v, options), e.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))
    load = partition.loads(labels, degree)
    want = partition.best_labels(partition.scores(labels, e, load, 40, options), 42, 600).select("id", "new_part", "h_now", "freq_now").collect()
    full = dict(map(tuple, load.collect()))
    state = partition.heard_labels(labels, e, degree)
    got = partition.choose(state, [full.get(p, 0) for p in range(4)], 40, options, 600).select("id", "new_part", "h_now", "freq_now").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


@pytest.mark.parametrize("wide", [64, 0])
def test_edges_stay_when_many_move(spark, monkeypatch, wide):
    """More moves than are broadcast are dealt to the edges, which stay; a round chooses once."""
    v, e, component, edges = tables(spark, graph(5, 40, 40, 1))
    plans, chosen, counted, choose = [], [], partition.moved_counts, partition.choose

    def seen(*args):
        out = counted(*args)
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(partition, "BROADCAST_MOVES", 0)
    monkeypatch.setattr(partition, "WIDE_LABELS", wide, raising=False)
    monkeypatch.setattr(partition, "moved_counts", seen)
    monkeypatch.setattr(partition, "choose", lambda *args: chosen.append(args[-1]) or choose(*args))
    with settings(spark, spark__sql__autoBroadcastJoinThreshold="-1"):
        out = partition.partition_graph(v.select("id"), e, partition.PartitionOptions(partitions=5, max_iterations=9, threshold=0.0))
        assert dict(map(tuple, out.labels.collect())) == plain.partition_rounds([*component], edges, 5, out.iterations)[-1]
    assert out.iterations == 3 and chosen == [600, 601, 602, 603]
    # The moves and the counts travel; counts of many labels twice.
    assert len(plans) == 4 and all(p.count("Exchange hashpartitioning") <= (2 if wide else 3) for p in plans)


def test_equal_labels_are_drawn_for(spark):
    v, e, _, _ = tables(spark, graph(9, 30, 30, 1))
    options = partition.PartitionOptions(partitions=4)
    labels, degree = partition.initial_labels(v, options), e.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))
    load = spark.createDataFrame([(p, 40) for p in range(4)], "part int, load bigint")
    scored = partition.scores(labels, e, load, 40, options).cache()
    assert scored.groupBy("id").agg(F.max("h").alias("top")).join(scored, "id").where("h = top").groupBy("id").count().where("count > 1").count() > 5
    want = partition.best_labels(scored, 42, 600).select("id", "new_part").collect()
    got = partition.choose(partition.heard_labels(labels, e, degree, 4), [40] * 4, 40, options, 600).select("id", "new_part").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_coarsening_and_placement(spark):
    v, e, component, edges = tables(spark, graph(3, 45, 12))
    layers, want = coarsen(v, e), plain.coarsen(component, edges)
    assert len(layers) == len(want) >= 3
    for layer, w in zip(layers, want, strict=True):
        rows = layer.vertices.collect()
        assert {r.id: r.component for r in rows} == w["component"] and {r.id: r.lower_weight for r in rows} == w["weight"]
        assert {(r.src, r.dst): r.weight for r in layer.edges.collect()} == w["edges"]
        assert (layer.n_vertices, layer.n_edges, layer.max_weight) == (len(rows), len(w["edges"]) // 2, max(w["edges"].values(), default=1))
        if "bodies" in w:
            assert {r.id: (r.sun, r.hops, r.w_from_sun, r.proxy) for r in layer.bodies.collect()} == w["bodies"]
            assert {tuple(r) for r in layer.paths.select("sun", "body", "nbr_sun", "position").collect()} == w["paths"]
    at = coarsest_places(layers[-1])
    expected = places(at)
    for n in range(len(layers) - 2, -1, -1):
        at = place_bodies(layers[n], at, layers[n + 1].edges, IDEAL)
        expected = plain.place(want[n], n, expected, want[n + 1]["edges"], IDEAL)
        close(places(at), expected)


@pytest.mark.parametrize("task_rows", [10**6, 0, 60])
def test_layout_of_a_layer(spark, task_rows):
    """Epochs, joins, and a mixture of both move as plain loops do, and stop at the same move."""
    pairs = graph(7, 12, 3) + [(300, 301), (401, 400), (402, 401)]
    v, e, component, edges = tables(spark, pairs)
    rows = [(i, c, 600 * plain.draw(i, 1), 500 * plain.draw(i, 2)) for i, c in [*component.items(), (500, 500)]]
    start = spark.createDataFrame(rows, "id bigint, component bigint, x double, y double")
    component[500] = 500
    limit = 400 if task_rows == 10**6 else 6
    options = layout.LayoutOptions(k=2, temp_factor=0.4, cooling=0.9, accuracy=1.0, limit=limit)
    want, moves = plain.layout({r[0]: r[2:] for r in rows}, component, edges, IDEAL, 2, 0.4, 0.9, 1.0, limit)
    got = layout.layout_layer(start, e, options, task_rows=task_rows)
    assert got.iterations == moves and (limit == 6 or 6 < moves < 400)
    close(places(got.vertices), want, 1e-6 if limit == 6 else 1e-3)


def _as_drawn(boxes, *_):
    zero = F.lit(0.0)
    return boxes.select("component", zero.alias("off_x"), zero.alias("off_y"), F.lit(1.0).alias("ratio"), zero.alias("cur_x"), zero.alias("cur_y"))


def test_multilevel_job(spark):
    """The whole job without leaves and packing: coarsening, first places, then each layer with its own parameters."""
    v, e, component, edges = tables(spark, graph(11, 30, 6))
    config = Config({"multi.layout.reintegrateOneDegrees": False})
    vertices = v.withColumn("one_edges", F.array().cast("array<bigint>"))
    got = jobs.layout_multilevel(jobs.Graph(vertices, e), config, pack=_as_drawn, limit=12)
    layers, adapt = plain.coarsen(component, edges), schedules.SizeDriven()
    at = {i: (plain.draw(i, 101) * 1200.0, plain.draw(i, 102) * 1200.0) for i in layers[-1]["component"]}
    for n in range(len(layers) - 1, -1, -1):
        layer = layers[n]
        if n < len(layers) - 1:
            at = plain.place(layer, n, at, layers[n + 1]["edges"], IDEAL)
        m = len(layer["edges"]) // 2
        facts = (n, len(layers), len(layer["component"]), m)
        top = max(layer["edges"].values(), default=1)
        at, _ = plain.layout(at, layer["component"], layer["edges"], IDEAL, schedules.hops_at(adapt, *facts), adapt.temperature(*facts), adapt.cooling(*facts), adapt.accuracy(*facts), 12, top, rescale=n == len(layers) - 1)
    close(places(got.vertices), at)
    assert [m["iterations"] for m in got.metrics] == [12] * len(layers)


@pytest.mark.parametrize("labelled", [True, False])
def test_a_move_sends_routes_only(spark, labelled):
    """Tables placed by partition: neither ball nor vertices are exchanged in a move, and routes follow the cut."""
    v, e, component, edges = tables(spark, graph(13, 30, 4))
    part = F.when(F.col("id") < 100, 0).otherwise(1) if labelled else F.pmod(F.hash("id"), F.lit(2))
    start = v.withColumns({"x": F.col("id") * 3.0, "y": F.pmod(F.col("id") * 7, F.lit(31)).cast("double"), "part": part})
    state = layout.frames(layout.boxes_and_sizes(start), IDEAL, 0.4)
    ball = layout.balls.k_hop_ball(e, 2)
    placed = layout.Placed(start, state, ball, e, layout.degrees(e), layout.LayoutOptions(), 1)
    with settings(spark, **layout.BY_SLOT):
        plan = placed.step(1.0)._jdf.queryExecution().executedPlan().toString()
    exchanges = [x for x in plan.split("\n") if "Exchange " in x and "Reused" not in x]
    assert len(exchanges) == 1 and "REPARTITION_BY_NUM" in exchanges[0] and "ENSURE_REQUIREMENTS" not in plan
    want = layout.move(start, layout.forces(start, e, ball, layout.LayoutOptions()), state, 1.0, 0.01)
    close(places(placed.step(1.0)), places(want))
    # Two pieces of their own partition: every vertex goes to one slot. Mixed labels send most of them twice.
    sent = placed.routes.count() / len(component)
    assert sent == 1.0 if labelled else sent > 1.3
    placed.drop()


@pytest.mark.parametrize(("hub_links", "k", "force"), [(0, 2, "LinLog"), (5, 3, "FR")])
def test_layout_around_hubs(spark, hub_links, k, force):
    """Factored balls, of every vertex and of some, move a layer as plain loops do and count the same messages."""
    pairs = graph(17, 14, 4) + [(300, 301)]
    v, e, component, edges = tables(spark, pairs)
    rows = [(i, c, 600 * plain.draw(i, 1), 500 * plain.draw(i, 2)) for i, c in component.items()]
    start = spark.createDataFrame(rows, "id bigint, component bigint, x double, y double")
    options = layout.LayoutOptions(k=k, temp_factor=0.4, cooling=0.9, accuracy=1.0, limit=3, force=force)
    listed = layout.layout_layer(start, e, options)
    if force == "FR":
        close(places(listed.vertices), plain.layout({r[0]: r[2:] for r in rows}, component, edges, IDEAL, k, 0.4, 0.9, 1.0, 3)[0])
    got = layout.layout_layer(start, e, options, hub_links=hub_links)
    close(places(got.vertices), places(listed.vertices))
    assert got.pairs == listed.pairs and got.iterations == listed.iterations == 3


@pytest.mark.parametrize("k", [1, 2, 3])
def test_factored_balls_list_every_pair_once(spark, k):
    """Listed pairs and what blocks of stars bring together are the ball, each pair once, for any hubs and blocks of two rows."""
    v, e, component, edges = tables(spark, graph(19, 14, 5, 1))
    near = plain.neighbours(edges)
    hubs_ = [i for i in near if len(near[i]) > 4]
    assert len(hubs_) > 1
    for chosen in (hubs_, []) if k == 2 else (hubs_,):
        ball = hubs.factored_ball(e, spark.createDataFrame([(i,) for i in chosen], "id bigint"), k, block=2)
        members = ball.stars.join(v.select("id", F.lit(0).alias("slot"), F.col("id").cast("double").alias("x"), F.lit(0.0).alias("y"), F.lit(1).alias("deg")), "id")
        listed = [tuple(r) for r in ball.pairs.collect()]
        met = hubs.star_forces(members, Apart(), 1.0, k).groupBy("id").agg(F.sum("partners").alias("n"), F.sum("fx").alias("sum")).collect()
        found = {r.id: (r.n, r.sum) for r in met}
        want = {(r.dst, r.src) for r in layout.balls.k_hop_ball(e, k).collect()}
        assert len(set(listed)) == len(listed) and set(listed) <= want and (not chosen or k == 1 or set(listed) < want)
        for i in near:
            others = [b for a, b in want if a == i]
            mine = [b for a, b in listed if a == i]
            n, total = found.get(i, (0, 0.0))
            assert n + len(mine) == len(others) and total + n * i + sum(mine) == sum(others)
        ball.drop()


class Apart:
    """A repulsion whose sum tells whom a vertex meets."""

    def repulsion(self, dx, dy, deg, other_deg):
        return -dx, dy


def test_disk_of_a_hub_is_linear(spark):
    """A hub of 20,000 links: as many rows as links, where the ball has their square."""
    n = 20_000
    e = spark.range(1, n + 1).select(F.lit(0).cast("bigint").alias("src"), F.col("id").alias("dst"), F.lit(1).alias("weight"))
    e = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    ball = hubs.factored_ball(e, spark.createDataFrame([(0,)], "id bigint"), 2)
    assert ball.stars.count() == n + 1 and ball.pairs.count() == 0
    assert ball.stars.agg(F.max("last")).first()[0] >= n // hubs.STAR_BLOCK and ball.stars.groupBy("block").count().agg(F.max("count")).first()[0] < 1.3 * hubs.STAR_BLOCK
    ball.drop()
