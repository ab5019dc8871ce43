"""Operators on micro-graphs with expected values worked out by hand."""

import math
import random
import re

import pyarrow as pa
import pytest
import user_parts
from pyspark.sql import functions as F

from constella.functions import forces, schedules
from constella.functions import geometry as G
from constella.iterate import cut, cut_buckets, cut_observed
from constella.operators import aggregates, angular, coarsen, hubs, layout, pack, partition, reintegrate
from constella.operators.ball import k_hop_ball, two_hop_sizes
from constella.operators.components import connected_components
from constella.operators.graph import bucket_count, load_graph, random_places, sources_of, symmetrise, vertices_of, written
from constella.operators.prune import prune_leaves
from constella.plans import config, jobs, registry, runner
from constella.sources import text

K = G.ideal_edge()


def edges(spark, *pairs):
    return symmetrise(spark.createDataFrame(list(pairs) or [(0, 0)], "src bigint, dst bigint"))


def vertices(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "id bigint")


def test_components_and_prune_of_paths_and_isolated(spark):
    e = edges(spark, (1, 2), (2, 3), (3, 4), (4, 5), (7, 8))
    v = vertices(spark, [1, 2, 3, 4, 5, 7, 8, 9])
    labels = {r.id: r.component for r in connected_components(v, e).collect()}
    assert labels == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 7: 7, 8: 7, 9: 9}
    p = prune_leaves(v, e)
    assert {(r.hub, r.leaf) for r in p.leaves.collect()} == {(2, 1), (4, 5)}
    assert {r.id for r in p.vertices.collect()} == {2, 3, 4, 7, 8, 9}


def test_star_keeps_its_hub(spark):
    e = edges(spark, (10, 1), (10, 2), (10, 3))
    p = prune_leaves(vertices_of(e), e)
    assert [(r.id, r.one_edges) for r in p.hubs.collect()] == [(10, [1, 2, 3])]
    assert p.edges.count() == 0 and [r.id for r in p.vertices.collect()] == [10]


def test_ball_on_a_path(spark):
    e = edges(spark, *[(i, i + 1) for i in range(1, 7)])
    assert k_hop_ball(e, 2).count() == 22
    assert k_hop_ball(e, 6).count() == 42


def test_a_hub_keeps_the_hops_of_its_layer(spark, monkeypatch):
    # The sum of squared degrees, 14,200² and more, is above 200 million.
    asked = []

    def stop(edges, around, k, *_, **__):
        asked.append((around.count(), k))
        raise StopIteration

    monkeypatch.setattr("constella.operators.hubs.factored_ball", stop)
    e = symmetrise(spark.range(1, 14_201).select(F.lit(0).cast("bigint").alias("src"), F.col("id").alias("dst")))
    v = vertices_of(e).select("id", F.lit(0).cast("bigint").alias("component"), (F.col("id") % 97).cast("double").alias("x"), (F.col("id") % 89).cast("double").alias("y"))
    with pytest.raises(StopIteration):
        layout.layout_layer(v, e, layout.LayoutOptions(k=3))
    assert asked == [(1, 3)]


def test_ball_through_split_hubs(spark):
    # Two hubs with a common neighbour, each split into blocks of three links.
    pairs = [(0, i) for i in range(1, 12)] + [(100, i) for i in range(11, 30)] + [(29, 40), (40, 41)]
    near: dict = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = set()
    for v in near:
        reached, edge = {v}, {v}
        for hop in range(1, 5):
            edge = set().union(*[near[u] for u in edge]) - reached
            reached |= edge
            want |= {(v, u, hop) for u in edge}
    got = [tuple(r) for r in k_hop_ball(edges(spark, *pairs), 4, block_links=3).select("dst", "src", "hop").collect()]
    assert len(got) == len(set(got)) and set(got) == want


def _random_pairs(n, count, seed):
    r = random.Random(seed)
    return [(r.randrange(n), r.randrange(n)) for _ in range(count)]


@pytest.mark.parametrize(
    "pairs",
    [
        [],
        [(1, 2), (2, 3), (3, 1), (3, 4)],  # A triangle with a tail.
        [(1, 2), (2, 3), (3, 4), (4, 1), (1, 3)],  # A square with a chord.
        [(0, i) for i in range(2, 9)] + [(1, i) for i in range(2, 9)],  # Two hubs over the same links.
        _random_pairs(30, 60, 1),
        _random_pairs(40, 300, 2),
        [(a, b) for a in range(12) for b in range(20, 40)],  # More cycles than walks: listed.
    ],
)
def test_two_hop_sizes_count_each_vertex_once(spark, pairs):
    e = edges(spark, *pairs)
    near: dict = {}
    for a, b in pairs:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want = {v: len((near[v] | set().union(*[near[u] for u in near[v]])) - {v}) for v in near}
    assert {r.id: r.reached for r in two_hop_sizes(e).collect()} == want


def test_two_hop_sizes_list_no_pairs(spark, tmp_path, monkeypatch):
    # Before, the query listed the ball: every pair of two links.
    spark.range(600).selectExpr("id div 4 as l_orderkey", "(id * 7919) % 41 as l_partkey").write.parquet(str(tmp_path / "lineitem.parquet"))
    e = load_graph(spark, str(tmp_path), "order_part")
    want = sorted((r.dst, r["count"]) for r in k_hop_ball(e, 2).groupBy("dst").count().collect())

    def stop(*_, **__):
        raise AssertionError("pairs are listed")

    monkeypatch.setattr(registry, "k_hop_ball", stop)
    monkeypatch.setattr("constella.operators.ball.k_hop_ball", stop)
    assert sorted((r.id, r.reached) for r in registry.queries()["khop_ball_2"](spark, str(tmp_path)).collect()) == want


def test_frame_force_and_move(spark):
    v = spark.createDataFrame([(1, 0, 0.0, 0.0), (2, 0, 3.0, 4.0)], "id bigint, component bigint, x double, y double")
    e = edges(spark, (1, 2))
    state = layout.frames(aggregates.boxes_and_sizes(v), K, 0.1)
    s = state.first()
    assert (s.scale_x, s.scale_y) == pytest.approx((1.318691, 1.318691), rel=1e-6)
    assert (s.temp_x, s.temp_y) == pytest.approx((676.281089, 689.468), rel=1e-6)
    f = layout.forces(v, e, k_hop_ball(e, 1), layout.LayoutOptions())
    one = f.where("id = 1").first()
    assert (one.fx, one.fy) == pytest.approx((-559.218344, -745.624458), rel=1e-6)
    moved = layout.move(v, f, state, 1.0, 1e-4).where("id = 1").first()
    assert (moved.x, moved.y) == pytest.approx((-405.768654, -551.5744), rel=1e-6)


def test_coincident_points_do_not_make_nan(spark):
    v = spark.createDataFrame([(1, 0, 1.0, 1.0), (2, 0, 1.0, 1.0)], "id bigint, component bigint, x double, y double")
    e = edges(spark, (1, 2))
    assert [(r.fx, r.fy) for r in layout.forces(v, e, k_hop_ball(e, 1), layout.LayoutOptions()).collect()] == [(0.0, 0.0)] * 2


def test_packing_of_three_components(spark):
    boxes = spark.createDataFrame(
        [(1, 0.0, 0.0, 100.0, 50.0, 10), (2, 10.0, 10.0, 50.0, 50.0, 5), (3, 7.0, 3.0, 7.0, 3.0, 1)], "component bigint, min_x double, min_y double, max_x double, max_y double, n bigint"
    )
    got = {r.component: (r.off_x, r.off_y, r.ratio, r.cur_x, r.cur_y) for r in pack.pack_components(boxes).collect()}
    assert got == {1: (0.0, 0.0, 1.0, 0.0, 0.0), 2: (-10.0, -10.0, 0.5, 120.0, 0.0), 3: (-7.0, -3.0, 0.2, 160.0, 0.0)}


def test_leaves_share_gaps(spark):
    v = spark.createDataFrame([(0, 0, 0.0, 0.0), (1, 0, 10.0, 0.0), (2, 0, 0.0, 10.0), (3, 0, -10.0, 0.0)], "id bigint, component bigint, x double, y double")
    e = edges(spark, (0, 1), (0, 2), (0, 3))
    hubs = spark.createDataFrame([(0, [11, 12, 13, 14, 15, 16])], "id bigint, one_edges array<bigint>")
    rays = reintegrate.hub_rays(v, e, hubs)
    assert sorted(round(r.gap, 6) for r in reintegrate.gaps(rays).collect()) == [round(math.pi / 2, 6)] * 2 + [round(math.pi, 6)]
    shares = reintegrate.sectors(rays, hubs, "fair_share", reintegrate.ReintegrationOptions()).first().sectors
    assert [s.quantity for s in shares] == [2, 1, 3]
    widest = reintegrate.sectors(rays, hubs, "max_slope", reintegrate.ReintegrationOptions()).first().sectors[0]
    assert (widest.start, widest.sector) == pytest.approx((math.pi + math.radians(2), math.pi - math.radians(4)))
    for strategy in reintegrate.STRATEGIES:
        placed = reintegrate.place_leaves(v, e, hubs, strategy).collect()
        assert {r.id for r in placed} == {11, 12, 13, 14, 15, 16}
        assert all(math.hypot(r.x, r.y) == pytest.approx(2.0) for r in placed)


def test_lone_hub_places_leaves_around_itself(spark):
    v = spark.createDataFrame([(0, 0, 0.0, 0.0)], "id bigint, component bigint, x double, y double")
    hubs = spark.createDataFrame([(0, [1, 2, 3, 4])], "id bigint, one_edges array<bigint>")
    for strategy in ("radial", "max_slope", "fair_share"):
        got = sorted((round(r.x, 6), round(r.y, 6)) for r in reintegrate.place_leaves(v, edges(spark), hubs, strategy).collect())
        assert got == [(-6.828427, -6.828427), (-6.828427, 6.828427), (6.828427, -6.828427), (6.828427, 6.828427)]


def test_systems_on_a_path(spark):
    e = edges(spark, *[(i, i + 1) for i in range(1, 7)])
    bodies, proxies = coarsen.gather(vertices(spark, [2, 6]), vertices(spark, range(1, 8)), e)
    got = {r.id: (r.sun, r.hops, r.proxy) for r in bodies.collect()}
    assert got == {2: (2, 0, 2), 6: (6, 0, 6), 1: (2, 1, 2), 3: (2, 1, 2), 5: (6, 1, 6), 7: (6, 1, 6), 4: (2, 2, 3)}
    ways = coarsen.routes(e, bodies, proxies)
    assert {(r.src, r.dst, r.weight) for r in coarsen.system_edges(ways).collect()} == {(2, 6, 4), (6, 2, 4)}
    assert {(r.sun, r.body, r.position) for r in coarsen.system_paths(ways, bodies).collect()} == {(2, 3, 1), (2, 4, 2), (6, 5, 1)}
    base = vertices(spark, range(1, 8)).withColumns({"component": F.lit(1).cast("bigint"), "lower_weight": F.lit(1)})
    assert {(r.id, r.lower_weight) for r in coarsen.next_layer(base, bodies).collect()} == {(2, 8), (6, 6)}


def test_of_equal_candidates_the_largest_id_stays(spark):
    e = edges(spark, (1, 2), (2, 3), (1, 3))
    c = vertices(spark, [1, 2, 3]).withColumn("mass", F.lit(2))
    assert [r.id for r in coarsen.sweep(c, c, e).collect()] == [3]


def test_coarsening_properties(spark):
    e = edges(spark, *[(i, i + 1) for i in range(40)])
    layers = coarsen.coarsen(vertices_of(e).withColumn("component", F.lit(0).cast("bigint")), e)
    sizes = [layer.n_vertices for layer in layers]
    assert len(sizes) >= 2 and sizes == sorted(sizes, reverse=True) and sizes[-1] <= 7
    assert layers[0].bodies.count() == sizes[0] == layers[0].bodies.select("id").distinct().count()
    assert layers[0].bodies.where("hops > 2").count() == 0


def test_schedules():
    t, got = 100.0, []
    for _ in range(4):
        got.append(round(t, 4))
        t = schedules.LinearCooling(0.93).cool(t)
    assert got == [100, 93, 86.49, 80.4357]
    s = schedules.SizeDriven()
    assert [s.hops(1, 2, 9, n) for n in (999, 1000, 4999, 5000, 9999, 10000, 100000, 100001, 1000000, 1000001)] == [6, 5, 5, 4, 4, 3, 3, 2, 2, 1]
    assert [s.temperature(1, 2, 9, n) for n in (249, 250, 500, 10000)] == [0.1, 0.2, 0.4, 0.8]
    assert isinstance(forces.force_model("nonsense"), forces.FruchtermanReingold)


def test_finest_layers_of_more_than_a_million_edges(spark, monkeypatch):
    many = spark.range(2_000_002).select((F.col("id") % 10).alias("src"), F.col("id").alias("dst"))
    monkeypatch.setattr(registry, "load_graph", lambda *_: many)
    monkeypatch.setattr(registry, "ADAPTED", ("many",))
    row = registry.adaptation_params(spark, "").first()
    assert (row["n_edges"], row["k_size"], row["k_density"], row["k_finest"]) == (1_000_001, 1, 3, 2)


def test_text_round_trip_and_malformed_lines(spark):
    lines = spark.createDataFrame([("[1,0.5,0,[2,3]]",), ("[2,1,1,[1]]",), ("[3,2,2,[1]]",)], "value string")
    v, e = text.read_partition_input(lines)
    assert {(r.src, r.dst) for r in e.collect()} == {(1, 2), (1, 3), (2, 1), (3, 1)}
    v = v.withColumns({"component": F.lit(1).cast("bigint"), "part": F.lit(0)})
    out = sorted(r.value for r in text.layout_lines(v, e, bare_ids=True).collect())
    assert out[0] == "[1,0.5,0.0,1,[2,3]]"
    again = sorted(r.value for r in text.partition_lines(v, e, randomise=False).collect())
    assert again[0] == "[1,1,0,0.5,0.0,[],[[2,0],[3,0]]]"
    bad = spark.createDataFrame([("[1,0,0,[2]]",), ("nonsense",), ("[1,2]",), ('["x",0,0,[]]',)], "value string")
    assert text.read_partition_input(bad, text.DROP)[0].count() == 1
    with pytest.raises(Exception, match="malformed line"):
        text.read_partition_input(bad)[0].collect()


def test_partitioner_balances_and_repeats(spark):
    pairs = [(a * 10 + i, a * 10 + j) for a in range(4) for i in range(8) for j in range(i)] + [(0, 10), (10, 20), (20, 30)]
    e = edges(spark, *pairs)
    o = partition.PartitionOptions(partitions=2, max_iterations=6)
    one, two = (partition.partition_graph(vertices_of(e), e, o) for _ in range(2))
    assert sorted(map(tuple, one.labels.collect())) == sorted(map(tuple, two.labels.collect()))
    assert {r.part for r in one.labels.collect()} <= {0, 1}
    with pytest.raises(ValueError):
        partition.changed_k(one.labels, o)


def test_registered_jobs_have_the_default_limits(spark, monkeypatch):
    from constella.plans import config, jobs, registry

    asked = []

    def stop(vertices, edges, given):
        asked.append(given)
        raise StopIteration

    monkeypatch.setattr(partition, "partition_graph", stop)
    monkeypatch.setattr(jobs, "preprocess", stop)
    for name in ("partition_run", "preprocess_job", "layout_single", "layout_multilevel"):
        with pytest.raises(StopIteration):
            registry.queries()[name](spark, "/root/testdata/sf0.001")
    assert asked[0].max_iterations == config.DEFAULTS["spinner.maxIterations"]
    for given in asked[1:]:
        assert all(given[key] == config.DEFAULTS[key] for key in ("spinner.maxIterations", "layout.limit"))


def test_scores_are_tested_after_the_window():
    settled = partition.Convergence(5, 0.001)
    scores = [100.0, 100.0, 100.0, 100.0, 120.0, 120.0, 120.0, 120.0, 120.0]
    assert [settled(4 + 2 * i, x) for i, x in enumerate(scores)] == [False, False, False, True, False, True, True, True, True]


def test_hooks_and_unknown_strategies(spark):
    v = spark.createDataFrame([(0, 0, 0.0, 0.0), (1, 0, 10.0, 0.0), (2, 0, 0.0, 10.0)], "id bigint, component bigint, x double, y double")
    e = edges(spark, (0, 1), (0, 2))
    hubs = spark.createDataFrame([(0, [11, 12])], "id bigint, one_edges array<bigint>")
    around = lambda rays, hubs, options: reintegrate.sectors(rays, hubs, "radial", options)
    places = lambda strategy: sorted((r.id, round(r.x, 6), round(r.y, 6)) for r in reintegrate.place_leaves(v, e, hubs, strategy).collect())
    assert places(around) == places("radial") and places("no.such.Class") == places("fair_share")
    asked = []
    steps = layout.Steps(seed=lambda *a: asked.append("seed") or layout.move(*a), propagate=lambda *a: asked.append("propagate") or layout.forces(*a), explore=lambda d: asked.append("explore") or aggregates.boxes_and_sizes(d))
    layout.layout_layer(v, e, layout.LayoutOptions(k=1, limit=2), steps=steps)
    assert asked == ["explore", "propagate", "seed", "propagate", "seed"]
    given = config.Config({"spinner.maxIterations": "8", "layout.output.showComponent": "false", "some.log.key": "x"})
    assert given["spinner.maxIterations"] == 8 and given["layout.output.showComponent"] is False and given["some.log.key"] == "x"


def test_runner_from_lines_to_lines(spark, tmp_path):
    """A path with a leaf at either end and a lone pair, through all three jobs at their default limits but a shorter one."""
    near = {1: [2], 2: [1, 3], 3: [2, 4], 4: [3, 5], 5: [4], 8: [9], 9: [8]}
    (tmp_path / "in.txt").write_text("\n".join(f"[{i},0,0,{n}]" for i, n in near.items()))
    values = {"spinner.numberOfPartitions": "2", "spinner.maxIterations": "6", "layout.limit": "7"}
    out = runner.run(spark, "preprocess", str(tmp_path / "in.txt"), str(tmp_path / "pre"), values)
    table = jobs.metrics_table(spark, out)
    assert table.where("name = 'score'").count() == 2 and table.where("name = 'local_ratio'").count() == 2
    lines = [r.value for r in text.read_lines(spark, str(tmp_path / "pre")).collect()]
    assert len(lines) == 5 and sum(line.startswith("[2,1,") and ",[1],[[3," in line for line in lines) == 1
    for job in ("single", "multilevel"):
        runner.run(spark, job, str(tmp_path / "pre"), str(tmp_path / job), {**values, "layout.output.showPartitioning": "true" if job == "single" else "false"})
        got = sorted(r.value for r in text.read_lines(spark, str(tmp_path / job)).collect())
        assert [int(g[1:].split(",")[0]) for g in got] == sorted(near)
        assert all(g.count("[") == (2 + len(n) if job == "single" else 2) for g, n in zip(got, near.values(), strict=True))
        assert not any("NaN" in g or "Infinity" in g for g in got)
    with pytest.raises(ValueError, match="unknown job"):
        runner.run(spark, "nothing", "", "")


def test_rows_of_a_partition_share_a_task(spark):
    labels = spark.range(100).select("id", (F.col("id") % 7).cast("int").alias("part"))
    owner = partition.by_partition(labels, 3).withColumn("task", F.spark_partition_id())
    assert owner.groupBy("part").agg(F.countDistinct("task").alias("n")).where("n > 1").count() == 0


def test_fewer_partitions(spark):
    labels = spark.range(300).select("id", (F.col("id") % 8).cast("int").alias("part"))
    got = partition.changed_k(labels, partition.PartitionOptions(partitions=8, repartition=-3)).collect()
    assert {r.part for r in got} == set(range(5))
    assert all(r.part == r.id % 8 for r in got if r.id % 8 < 5)


def test_loops_on_an_empty_graph(spark):
    vertices = spark.createDataFrame([], "id bigint, component bigint, x double, y double")
    edges = spark.createDataFrame([], "src bigint, dst bigint, weight int")
    drawn = layout.layout_layer(vertices, edges, layout.LayoutOptions(limit=2))
    assert drawn.vertices.count() == 0
    done = partition.partition_graph(vertices, edges, partition.PartitionOptions(max_iterations=10))
    assert (done.labels.count(), done.iterations) == (0, 0)


def test_totals_taken_while_writing(spark):
    rows = spark.range(1000).select("id", (F.col("id") % 7).alias("r")).repartition(5, "r")
    written, seen = cut_observed(rows, "observed", n=F.count("*"), total=F.sum("r"))
    assert seen == {"n": written.count(), "total": written.agg(F.sum("r")).first()[0]}


def test_parts_by_name(spark, tmp_path):
    """A user's reader, writer, force, seeder and start, named on the command line; unknown names give the defaults."""
    (tmp_path / "in").write_text("1 2\n2 3\n3 1\n")
    user_parts.CALLED.clear()
    names = {"input.reader": "user_parts.read_pairs", "output.writer": "user_parts.write_places", "layout.limit": "2"}
    more = {"layout.forceModel": "user_parts.Stiff", "layout.forceModel.extraOptions": "3", "layout.seeder": "user_parts.seed"}
    runner.main(["single", str(tmp_path / "in"), str(tmp_path / "out"), *[f"{k}={v}" for k, v in {**names, **more}.items()]])
    assert user_parts.CALLED == ["reader", ("force", "3"), "seeder", "seeder", "writer"]
    assert sorted(r.value.split()[0] for r in spark.read.text(str(tmp_path / "out")).collect()) == ["1", "2", "3"]
    out = runner.run(spark, "user_parts.start", str(tmp_path / "in"), str(tmp_path / "own"), names)
    assert out.metrics == [{"started": 1}] and sorted(r.value for r in spark.read.text(str(tmp_path / "own")).collect()) == ["1 1.0 42.0", "2 2.0 42.0", "3 3.0 42.0"]
    odd = config.Config({"layout.forceModel": "no.such.Force", "multi.layout.adaptationStrategy": "user_parts.Nothing", "reintegration.reintegratingClass": "radial", "layout.seeder": "no.such.seed"})
    assert odd.force == "FR" and type(odd.adaptation) is schedules.SizeDriven and odd.reintegrating == "radial" and odd.steps.seed is layout.move
    assert type(config.Config({"multi.layout.adaptationStrategy": "constella.functions.schedules.DensityDriven"}).adaptation) is schedules.DensityDriven
    with pytest.raises(ValueError, match="unknown job"):
        runner.run(spark, "no.such.job", str(tmp_path / "in"), str(tmp_path / "no"))


def test_merges_that_users_write(spark, monkeypatch):
    rows = spark.range(200).select((F.col("id") % 7).alias("component"), (F.col("id") * 37 % 101).cast("double").alias("x"), (F.col("id") * 53 % 97).cast("double").alias("y")).repartition(5)
    monkeypatch.setattr(aggregates, "HELD_STATES", 3)
    got = {r.component: (r.first, r.second) for r in aggregates.merged(rows, user_parts.Longest(), "x").collect()}
    plain = {}
    for r in rows.collect():
        plain.setdefault(r.component, []).append(r.x)
    assert got == {c: tuple(sorted(xs, reverse=True)[:2]) for c, xs in plain.items()}
    square = spark.createDataFrame([(1, 0.0, 0.0), (1, 2.0, 0.0), (1, 2.0, 2.0), (1, 0.0, 2.0), (1, 1.0, 1.0), (1, 1.0, 0.0), (2, 5.0, 5.0), (2, 5.0, 5.0), (3, 0.0, 0.0), (3, 3.0, 4.0), (None, 1.0, 1.0)], "component int, x double, y double")
    hulls = {r.component: (r.corners, r.perimeter, r.area) for r in aggregates.merged(square.repartition(3), aggregates.Hull(), "x", "y").collect()}
    assert hulls == {1: (4, 8.0, 4.0), 2: (1, 0.0, 0.0), 3: (2, 10.0, 0.0), None: (1, 0.0, 0.0)}
    assert aggregates.merged(square.limit(0), aggregates.Hull(), "x", "y").count() == 0


@pytest.mark.parametrize("clockwise", [True, False])
def test_angles_around_a_split_hub(spark, clockwise):
    """The walk as a plain loop that changes each angle before it takes the next, for a hub in ranges and a small vertex."""
    n = 40
    places = {0: (0.0, 0.0), **{i: (math.cos(i * i) * (i + 3), math.sin(i * i) * (i + 3)) for i in range(1, n)}}
    v = spark.createDataFrame([(i, *p) for i, p in places.items()], "id bigint, x double, y double")
    e = edges(spark, *[(0, i) for i in range(1, n)], (1, 2), (1, 3))
    got = {(r.src, r.dst): (r.dx, r.dy) for r in angular.angular_suggestions(v, e, 10.0, clockwise=clockwise, range_rows=5).collect()}
    near = {0: list(range(1, n)), 1: [0, 2, 3]}
    assert set(got) == {(s, d) for s, ds in near.items() for d in ds}
    for s, ds in near.items():
        at = lambda d: math.atan2(places[d][1] - places[s][1], places[d][0] - places[s][0]) % (2 * math.pi)  # noqa: B023, E731
        order = sorted(ds, key=lambda d: (at(d), d))
        slope, fair, here = {d: at(d) for d in ds}, 2 * math.pi / len(ds), order[0]
        for d in [*order[1:], order[0]]:
            turn = fair - (slope[d] - slope[here])
            slope[d] += turn if clockwise else -turn
            here = d
            want = (places[s][0] + 10 * math.cos(slope[d]) - places[d][0], places[s][1] + 10 * math.sin(slope[d]) - places[d][1])
            assert got[s, d] == pytest.approx(want, abs=1e-7)


def test_rejected_lines_name_their_file(spark, tmp_path):
    (tmp_path / "a").write_text("[1,0,0,[2]]\n\n[2,0,0\n[3,\"x\",0,[1]]\n")
    (tmp_path / "b").write_text("[4,0,0]\n[5,0,0,7]\n[2,1,1,[1]]")
    good, bad = text.split_lines(text.read_lines(spark, str(tmp_path), named=True), "partition")
    vertices, links = text.read_partition_input(good)
    assert {r.id for r in vertices.collect()} == {1, 2} and links.count() == 2
    got = {(r.file.rsplit("/", 1)[1], r.value, r.reason) for r in bad.collect()}
    assert got == {("a", "[2,0,0", "not an array"), ("a", "[3,\"x\",0,[1]]", "field 1 is not a number"), ("b", "[4,0,0]", "fewer than 4 fields"), ("b", "[5,0,0,7]", "field 3 is not an array")}


def test_graph_from_tables(spark, tmp_path):
    spark.createDataFrame([(1,), (2,), (7,)], "id bigint").write.parquet(str(tmp_path / "v"))
    spark.createDataFrame([(1, 2, 5), (2, 2, 1)], "src bigint, dst bigint, weight int").write.parquet(str(tmp_path / "e"))
    v, e = text.read_tables(spark, str(tmp_path / "v"), str(tmp_path / "e"))
    assert v.count() == 3 and sorted(map(tuple, e.collect())) == [(1, 2, 5), (2, 1, 5)]


def test_graph_of_a_table_is_dealt_once(spark, tmp_path):
    rows = [(1, 2, 3), (1, 2, 4), (1, 3, 3), (None, 2, 1)]
    spark.createDataFrame(rows, "l_orderkey bigint, l_partkey bigint, l_suppkey bigint").write.parquet(str(tmp_path / "lineitem.parquet"))
    e = load_graph(spark, str(tmp_path), "order_part")
    assert sorted(map(tuple, e.collect())) == [(2, 5, 1), (2, 7, 1), (5, 2, 1), (7, 2, 1)]
    assert e._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    again = written(e)
    assert sorted(map(tuple, again.select(e.columns).collect())) == sorted(map(tuple, e.collect()))
    # Neither vertices nor what is grouped by the source moves again.
    assert "Exchange" not in sources_of(again)._jdf.queryExecution().executedPlan().toString()
    assert {r.id for r in sources_of(again).collect()} == {r.id for r in vertices_of(e).collect()}


def _dealt(df):
    """Exchanges of a plan, each once."""
    return len(set(re.findall(r"Exchange hashpartitioning[^\n]*plan_id=(\d+)", df._jdf.queryExecution().executedPlan().toString())))


@pytest.mark.parametrize("clockwise", [True, False])
def test_rays_around_ordinary_vertices_are_dealt_twice(spark, clockwise):
    """To the place of their end and back; vertices go along. Ranges of the angle are for hubs only."""
    e = written(edges(spark, *[(a, b) for a in range(6) for b in range(a)]))
    v = random_places(cut(sources_of(e), "vertices"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert _dealt(angular.angular_suggestions(v, e, 10.0, clockwise=clockwise)) <= 4
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_edges_between_systems_are_dealt_once(spark):
    """Edges in buckets of their source are sent to their other end, where the ways are made; bodies and proxies are read, not made anew."""
    e = written(edges(spark, *[(i, i + 1) for i in range(1, 30)], *[(i, i + 7) for i in range(1, 20)]))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        bodies, proxies = coarsen.gather(vertices(spark, [2, 12, 25]), vertices(spark, range(1, 31)), e)
        assert _dealt(bodies) == _dealt(proxies) == 0
        plan = coarsen.routes(e, bodies, proxies)._jdf.queryExecution().executedPlan().toString()
        assert len(re.findall(r"Scan parquet [^ ]*edges_", plan)) == 1 and _dealt(coarsen.routes(e, bodies, proxies)) <= 4
        asked = coarsen.sweep(vertices(spark, [2, 12, 25]).withColumn("mass", F.lit(2)), vertices(spark, range(1, 31)), e)
        assert {r.id for r in asked.collect()} == {2, 12, 25}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_labels_are_dealt_once(spark):
    """Offers to a vertex come along edges that stay in place."""
    e = written(edges(spark, *[(i, i + 1) for i in range(1, 30)]))
    o = partition.PartitionOptions(partitions=3)
    labels = cut(partition.initial_labels(sources_of(e), o), "labels")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        scored = partition.scores(labels, e, spark.createDataFrame([(0, 20), (1, 20), (2, 18)], "part int, load bigint"), 22.0, o)
        plan = scored._jdf.queryExecution().executedPlan().toString()
        # The offers by vertex, and the labels beside the edges' sources and beside the offers.
        assert plan.count("Exchange hashpartitioning") <= 3
        part = {r.id: r.part for r in labels.collect()}
        got = {(r.id, r.label): (r.freq, r.total) for r in scored.collect()}
        for i in range(1, 31):
            near = [j for j in (i - 1, i + 1) if 1 <= j <= 30]
            for label in {part[i], 2, *(part[j] for j in near)}:
                assert got.pop((i, label)) == (sum(part[j] == label for j in near), len(near))
        assert not got
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_larger_tables_are_dealt_into_more_buckets(spark, tmp_path, monkeypatch):
    rows = [(i, i % 7, i % 3) for i in range(50)]
    spark.createDataFrame(rows, "l_orderkey bigint, l_partkey bigint, l_suppkey bigint").write.parquet(str(tmp_path / "lineitem.parquet"))
    e = load_graph(spark, str(tmp_path), "order_part")
    assert written(e)._constella_buckets == ("src", 2)
    monkeypatch.setattr("constella.operators.graph.BUCKET_EDGES", 10)
    again = written(e)
    assert again._constella_buckets == ("src", 10) and sorted(map(tuple, again.collect())) == sorted(map(tuple, e.collect()))
    assert "Exchange" not in sources_of(again)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("strategy", reintegrate.STRATEGIES)
def test_rays_of_hubs_are_dealt_once(spark, strategy):
    """Rays and hubs lie in buckets of the hub: only leaves and their spots are dealt afterwards, by hub and number, and back to the hub."""
    e = written(edges(spark, *[(a, b) for a in range(6) for b in range(a)]))
    v = random_places(sources_of(e)).withColumn("component", F.lit(0).cast("bigint"))
    v = cut_buckets(v, "places", "id", bucket_count(e))
    hubs = spark.createDataFrame([(0, [11, 12, 13]), (4, [14])], "id bigint, one_edges array<bigint>")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert _dealt(reintegrate.place_leaves(v, e, hubs, strategy)) <= 3
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("n, same", [(70, True), (70, False)])
def test_blocks_of_a_star_meet_in_strips(n, same):
    """Matrices of a block's pairs are made for a few members at once; sums are those of all pairs."""
    tallest = []

    class Seen(forces.FruchtermanReingold):
        def repulsion(self, dx, dy, *degrees):
            tallest.append(dx.shape[0])
            return super().repulsion(dx, dy, *degrees)

    r = random.Random(5)
    x, y = [r.random() * 100 for _ in range(n)], [r.random() * 100 for _ in range(n)]
    block = [0] * n if same else [i % 2 for i in range(n)]
    lists = pa.array([[]] * n, pa.list_(pa.int64()))
    table = pa.table({"i": [0] * n, "j": [0 if same else 1] * n, "block": block, "slot": pa.array([0] * n, pa.int32()), "id": list(range(n)), "x": x, "y": y, "deg": [1.0] * n, "near_hubs": lists, "near_hops": lists})
    got = {row["id"]: row for row in hubs._pushes(Seen(), 2.0, 2)(table).to_pylist()}
    for i in range(n):
        met = [j for j in range(n) if j != i and (same or block[j] != block[i])]
        want = sum(-2.0 * (x[j] - x[i]) / ((x[j] - x[i]) ** 2 + (y[j] - y[i]) ** 2) for j in met)
        assert got[i]["partners"] == len(met) and got[i]["fx"] == pytest.approx(want)
    assert max(tallest) <= 32
