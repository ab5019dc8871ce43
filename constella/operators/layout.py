"""Force-directed layout of one layer: frames, forces within balls, tempered moves, convergence."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from constella.functions import geometry as G
from constella.functions.forces import force_model
from constella.functions.schedules import LinearCooling
from constella.iterate import cut, cut_buckets, cut_observed, drop, settings
from constella.manifest import Manifest, plain_values
from constella.operators import ball as balls
from constella.operators import epochs, hubs
from constella.operators.aggregates import boxes_and_sizes
from constella.operators.graph import degrees


@dataclass
class LayoutOptions:
    """Parameters of one layer's layout; ``strict`` waits until every vertex has converged."""

    k: int = 3
    temp_factor: float = 2.0
    cooling: float = 0.93
    accuracy: float = 0.01
    convergence: float = 0.85
    limit: int = 10000
    enhancer: float = 2.0
    walshaw_modifier: float = 1.0
    repulsion_factor: float | None = None
    force: object = "FR"
    force_options: str = ""
    ideal: float = field(default_factory=G.ideal_edge)
    strict: bool = False


def frames(boxes: DataFrame, ideal: float, temp_factor: float, max_weight: int = 1) -> DataFrame:
    """Target frame, scale and temperatures of each component from its bounding box and size."""
    edge = F.lit(float(max_weight * ideal))
    one = F.col("n") == 1
    w = G.fuzzy(F.col("max_x") - F.col("min_x")) + edge
    h = G.fuzzy(F.col("max_y") - F.col("min_y")) + edge
    wide = boxes.withColumns({"w": w, "h": h})
    width = F.sqrt(F.col("n") / (F.col("h") / F.col("w"))) * edge
    out = wide.withColumn("frame_w", F.when(one, F.lit(1.0)).otherwise(width))
    out = out.withColumn("frame_h", F.when(one, F.lit(1.0)).otherwise(F.col("h") / F.col("w") * F.col("frame_w")))
    return out.withColumns(
        {
            "scale_x": F.when(one, F.lit(1.0)).otherwise(F.col("frame_w") / F.col("w")),
            "scale_y": F.when(one, F.lit(1.0)).otherwise(F.col("frame_h") / F.col("h")),
            "temp_x": F.when(one, F.lit(0.0)).otherwise(F.col("frame_w") / temp_factor),
            "temp_y": F.when(one, F.lit(0.0)).otherwise(F.col("frame_h") / temp_factor),
        }
    ).drop("w", "h")


def scale_drawing(vertices: DataFrame, state: DataFrame) -> DataFrame:
    """Every component moved to the origin and scaled to its frame."""
    s = state.select("component", "min_x", "min_y", "scale_x", "scale_y")
    moved = vertices.join(s, "component").withColumns({"x": (F.col("x") - F.col("min_x")) * F.col("scale_x"), "y": (F.col("y") - F.col("min_y")) * F.col("scale_y")})
    return moved.select(*vertices.columns)


def _strength(options: LayoutOptions, max_weight: int) -> float:
    """What repulsion is multiplied by."""
    far = options.repulsion_factor if options.repulsion_factor is not None else (max_weight * options.ideal) ** 2
    return float(options.enhancer * far * options.walshaw_modifier)


def _summed(pairs: DataFrame, options: LayoutOptions, max_weight: int, *keys: Column) -> DataFrame:
    """fx and fy by key. Pairs have both places (x1, y1, x2, y2) and degrees (d1, d2); w is the weight of a link and null in the ball."""
    model = force_model(options.force, options.force_options)
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    ax, ay = model.attraction(dx, dy, F.col("w") * F.lit(float(options.ideal)), F.col("d1"), F.col("d2"))
    rx, ry = model.repulsion(dx, dy, F.col("d1"), F.col("d2"))
    strength = F.lit(_strength(options, max_weight))
    fx = F.when(F.col("w").isNull(), -rx * strength).otherwise(ax)
    fy = F.when(F.col("w").isNull(), -ry * strength).otherwise(ay)
    return pairs.groupBy(*keys).agg(F.sum(fx).alias("fx"), F.sum(fy).alias("fy"))


def both_kinds(ball: DataFrame, links: DataFrame, *more: str) -> DataFrame:
    """Links and ball as one table of (dst, src, w), w null in the ball, so that places are joined once to each end and forces summed once."""
    near = links.select(F.col("src").alias("dst"), F.col("dst").alias("src"), F.col("weight").alias("w"), *more)
    return ball.select("dst", "src", F.lit(None).cast("int").alias("w"), *more).unionByName(near)


def forces(vertices: DataFrame, edges: DataFrame, ball: DataFrame, options: LayoutOptions, max_weight: int = 1, degree: DataFrame | None = None) -> DataFrame:
    """``id, fx, fy``: attraction along edges minus repulsion within the ball; vertices without either have no row."""
    degree = degrees(edges) if degree is None else degree
    place = vertices.select("id", "x", "y").join(degree, "id", "left").select("id", "x", "y", F.coalesce("degree", F.lit(0)).alias("deg"))
    mine = place.select(F.col("id").alias("dst"), F.col("x").alias("x1"), F.col("y").alias("y1"), F.col("deg").alias("d1"))
    theirs = place.select(F.col("id").alias("src"), F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("deg").alias("d2"))
    return _summed(both_kinds(ball, edges).join(theirs, "src").join(mine, "dst"), options, max_weight, F.col("dst").alias("id"))


def _moved(f: DataFrame, cooled: float, accuracy: float, columns: list[str]) -> DataFrame:
    """Vertices with forces (null: none) and temperatures after one move."""
    fx, fy = F.coalesce("fx", F.lit(0.0)), F.coalesce("fy", F.lit(0.0))
    size = G.norm(fx, fy)
    mx = fx / size * F.least(size, F.col("temp_x") * F.lit(cooled))
    my = fy / size * F.least(size, F.col("temp_y") * F.lit(cooled))
    checked = lambda c: F.when(F.isnan(c), F.raise_error(F.lit("a coordinate is not a number")).cast("double")).otherwise(c)
    moved = f.withColumns({"mx": mx, "my": my}).withColumn("converged", (G.norm(F.col("mx"), F.col("my")) < accuracy).cast("int"))
    return moved.withColumns({"x": checked(F.col("x") + F.col("mx")), "y": checked(F.col("y") + F.col("my"))}).select(*columns, "converged")


def move(vertices: DataFrame, force: DataFrame, state: DataFrame, cooled: float, accuracy: float) -> DataFrame:
    """Vertices after one tempered move, with ``converged``. A place that isn't a number is an error."""
    f = vertices.join(force, "id", "left").join(state.select("component", "temp_x", "temp_y"), "component")
    return _moved(f, cooled, accuracy, vertices.columns)


#: Rows dealt by slot meet by slot and id where they are.
BY_SLOT = {"spark__sql__requireAllClusterKeysForCoPartition": "false"}


class Placed:
    """Vertices, pairs and routes of a layer placed by partition: a move sends each vertex once to every slot that needs its place.

    A slot is a part of a partition (``part`` of the vertices; without it, a hash), as many as there are buckets or more. Pairs lie in the slot of the vertex that they move, so
    the ball, which never changes, never travels: places are joined to both of its ends, and forces summed, inside slots. What a move shuffles
    is the list of routes: a row for each vertex and slot where it is wanted, few where neighbours share a partition.

    With ``stars`` (see ``hubs``) the ball lists only the pairs that no hub brings together; those that a hub does are made by blocks of
    its star, whose rows lie with their vertices. ``partners`` counts them, each in both directions, after the first move.
    """

    def __init__(self, vertices: DataFrame, state: DataFrame, ball: DataFrame, links: DataFrame, degree: DataFrame, options: LayoutOptions, max_weight: int, stars: DataFrame | None = None):
        self.options, self.max_weight, self.partners = options, max_weight, 0
        #: Places that a manifest names: kept until the next one does.
        self.named: DataFrame | None = None
        self.buckets = n = int(vertices.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        if "part" in vertices.columns:
            parts = vertices.agg(F.max("part")).first()[0] or 0
            fine = max(1, -(-n // (parts + 1)))
            slot = F.coalesce("part", F.lit(0)) * fine + F.pmod(F.xxhash64("id"), F.lit(fine)).cast("int")
        else:
            slot = F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
        full = vertices.join(state.select("component", "temp_x", "temp_y"), "component").join(degree, "id", "left")
        full = full.select(slot.cast("int").alias("slot"), "id", "component", "x", "y", "temp_x", "temp_y", F.coalesce("degree", F.lit(0)).alias("deg"))
        self.columns = full.columns
        self.vertices = self._dealt(full, "places")
        home = self.vertices.select("id", "slot")
        self.pairs = self._dealt(both_kinds(ball, links).join(home.withColumnRenamed("id", "dst"), "dst").select("slot", "dst", "src", "w"), "pairs")
        wanted = self.pairs.select("slot", F.col("src").alias("id")).unionByName(home.select("slot", "id")).distinct()
        routes = wanted.select("id", F.col("slot").alias("to")).join(home, "id").select("slot", "id", "to")
        self.routes = self._dealt(routes, "routes")
        self.stars = None if stars is None else self._dealt(stars.join(home, "id"), "stars")

    @classmethod
    def resumed(cls, tables: dict[str, DataFrame], options: LayoutOptions, max_weight: int, partners: int) -> Placed:
        """The same from tables that a manifest named."""
        out = object.__new__(cls)
        out.options, out.max_weight, out.partners = options, max_weight, partners
        out.vertices, out.pairs, out.routes, out.stars = (tables.get(f"placed_{c}") for c in ("vertices", "pairs", "routes", "stars"))
        out.columns, out.buckets, out.named = out.vertices.columns, out.vertices._constella_buckets[1], out.vertices
        return out

    def tables(self) -> dict[str, DataFrame | None]:
        return {"placed_vertices": self.vertices, "placed_pairs": self.pairs, "placed_routes": self.routes, "placed_stars": self.stars}

    def _dealt(self, df: DataFrame, name: str) -> DataFrame:
        return cut_buckets(df.repartition(self.buckets, "slot"), name, "slot", self.buckets)

    def step(self, cooled: float) -> DataFrame:
        """Vertices after one move, with ``converged``; dealt by slot as before."""
        sent = self.routes.join(self.vertices.select("slot", "id", "x", "y", "deg").hint("shuffle_hash"), ["slot", "id"])
        sent = sent.select(F.col("to").alias("slot"), "id", "x", "y", "deg").repartition(self.buckets, "slot")
        mine = sent.select("slot", F.col("id").alias("dst"), F.col("x").alias("x1"), F.col("y").alias("y1"), F.col("deg").alias("d1"))
        theirs = sent.select("slot", F.col("id").alias("src"), F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("deg").alias("d2"))
        both = self.pairs.join(theirs.hint("shuffle_hash"), ["slot", "src"]).join(mine.hint("shuffle_hash"), ["slot", "dst"])
        pushed = _summed(both, self.options, self.max_weight, F.col("slot"), F.col("dst").alias("id"))
        after = self.vertices.join(pushed, ["slot", "id"], "left")
        columns = self.columns
        if self.stars is not None:
            model = force_model(self.options.force, self.options.force_options)
            members = self.stars.join(self.vertices.select("slot", "id", "x", "y", "deg").hint("shuffle_hash"), ["slot", "id"])
            apart = hubs.star_forces(members, model, _strength(self.options, self.max_weight), self.options.k).repartition(self.buckets, "slot")
            apart = apart.groupBy("slot", "id").agg(F.sum("fx").alias("sx"), F.sum("fy").alias("sy"), F.sum("partners").alias("partners"))
            after = after.join(apart, ["slot", "id"], "left").withColumns({"fx": F.coalesce("fx", F.lit(0.0)) + F.coalesce("sx", F.lit(0.0)), "fy": F.coalesce("fy", F.lit(0.0)) + F.coalesce("sy", F.lit(0.0))})
            columns = [*columns, "partners"]
        return _moved(after, cooled, self.options.accuracy, columns)

    def move(self, cooled: float) -> int:
        """Moves all vertices once; the number of converged ones."""
        seen = Observation()
        with settings(self.vertices.sparkSession, **BY_SLOT):
            stepped = self.step(cooled)
            partners = F.lit(0) if self.stars is None else F.col("partners")
            stepped = stepped.observe(seen, F.sum("converged").alias("n"), F.sum(partners).alias("partners"))
            after = cut_buckets(stepped.select(*self.columns), "places", "slot", self.buckets)
        if self.vertices is not self.named:
            drop(self.vertices)
        self.vertices = after
        self.partners = seen.get["partners"] or 0
        return seen.get["n"] or 0

    def drop(self) -> None:
        drop(self.vertices, self.pairs, self.routes, self.stars)


@dataclass
class Steps:
    """What a layer's layout is made of; each can be replaced by a function of the same arguments.

    ``explore`` gives boxes and sizes of components, ``scale`` fits a drawing to its frames, ``propagate`` gives the forces (the ball is made by ``reach``),
    ``seed`` moves the vertices by them.
    """

    explore: Callable = boxes_and_sizes
    scale: Callable = scale_drawing
    reach: Callable = balls.k_hop_ball
    propagate: Callable = forces
    seed: Callable = move


@dataclass
class LayoutResult:
    """Places, moves done, hops of the ball, and pairs (of ball and links) that exchange a message in each move."""

    vertices: DataFrame
    iterations: int
    ball_rows_hops: int
    pairs: int = 0


def layout_layer(vertices: DataFrame, edges: DataFrame, options: LayoutOptions, max_weight: int = 1, rescale: bool = True, steps: Steps | None = None, task_rows: int = epochs.TASK_ROWS, hub_links: int = hubs.HUB_LINKS, resume: str | None = None) -> LayoutResult:
    """Lay out one layer: frame, scale (on the first layer drawn), then moves until converged or ``limit``.

    Components of up to ``task_rows`` pairs and vertices are moved in epochs, many moves a job, without a shuffle between two moves. Larger
    ones, and all if the force model has no arithmetic for arrays, are placed by partition and moved by joins inside it. Components with a vertex of
    more than ``hub_links`` links are among the larger ones, and their balls are factored (``hubs``). If ``steps`` replaces how forces or moves are
    made, its functions are called for all vertices. All kinds take part in every test of convergence. ``resume`` names a manifest, kept after each epoch
    (after each move, where no component is moved in epochs): a layout of that name that a lost driver left is gone on with from there.
    """
    steps = steps or Steps(reach=balls.k_hop_ball)
    model = force_model(options.force, options.force_options)
    own = steps.propagate is forces and steps.seed is move
    on_arrays = own and getattr(model, "on_arrays", False)
    kept = Manifest(vertices.sparkSession, resume, "layout", {**plain_values(options), "max_weight": max_weight, "own": own})
    before = kept.load()
    bins = placed = hooked = None
    cooling, temperature, done, finished = LinearCooling(options.cooling), 1.0, 0, False

    def in_bins(table: DataFrame, rows: int) -> epochs.Epochs:
        return epochs.Epochs(table, model, options.ideal, _strength(options, max_weight), options.accuracy, epochs.epoch_length(rows))

    if before:
        values, tables = before
        state, current, ball, links, degree = (tables[n] for n in ("state", "current", "ball", "links", "degree"))
        total, messages, rows, temperature, done, finished = (values[n] for n in ("total", "messages", "rows", "temperature", "done", "finished"))
        bins = in_bins(tables["bins"], rows) if "bins" in tables else None
        placed = Placed.resumed(tables, options, max_weight, values["partners"]) if "placed_vertices" in tables else None
        hooked = tables.get("hooked")
    else:
        state = cut(frames(steps.explore(vertices), options.ideal, options.temp_factor, max_weight), "frames")
        current = cut(steps.scale(vertices, state) if rescale else vertices, "places")
        degree = cut(degrees(edges), "degree")
        great, factored = degree.where(F.col("degree") > hub_links).select("id"), None
        if on_arrays and steps.reach is balls.k_hop_ball and options.k > 1 and not great.isEmpty():
            factored = hubs.factored_ball(edges, great, options.k)
        reached = factored.pairs if factored else steps.reach(edges, options.k)
        home = current.select(F.col("id").alias("dst"), "component")
        ball = cut(reached.select("dst", "src").join(home, "dst").repartition("dst", "src"), "ball")
        drop(*getattr(reached, "_constella_parts", ()))
        links = cut(edges.select("src", "dst", "weight").join(home, "dst"), "links")
        total, messages, rows = current.count(), ball.count() + links.count(), None
        if on_arrays:
            counted = ball.select("component").unionByName(links.select("component")).unionByName(current.select("component"))
            sizes = counted.groupBy("component").agg(F.count("*").alias("n"))
            if factored:
                with_hub = current.join(great, "id", "left_semi").select("component", F.lit(True).alias("hub")).distinct()
                sizes = sizes.join(with_hub, "component", "left")
            sizes = cut(sizes.select("component", "n", ((F.col("n") > task_rows) | F.coalesce("hub" if factored else F.lit(False), F.lit(False))).alias("over")), "sizes")
            rows, over = sizes.agg(F.sum(F.when(~F.col("over"), F.col("n"))), F.count_if("over")).first()
            large = sizes.where("over").select("component")
            of = (lambda df, kind: df.join(large, "component", kind)) if over else lambda df, kind: df
            if rows:
                bins = in_bins(cut(epochs.packed(of(current, "left_anti"), state, of(ball, "left_anti"), of(links, "left_anti"), degree, rows), "epoch"), rows)
            if over:
                placed = Placed(of(current, "left_semi"), state, of(ball, "left_semi"), of(links, "left_semi"), degree, options, max_weight, factored and factored.stars)
            drop(sizes)
        elif own:
            placed = Placed(current, state, ball, links, degree, options, max_weight)
        else:
            hooked = current
        if factored:
            factored.drop()
    named = hooked

    def keep() -> None:
        """Name what the last move left, then delete what was named before."""
        nonlocal named
        values = {"total": total, "messages": messages, "rows": rows, "temperature": temperature, "done": done, "finished": finished, "partners": placed.partners if placed else 0}
        setup = {"state": state, "current": current, "ball": ball, "links": links, "degree": degree}
        kept.save(values, {**setup, "bins": bins and bins.table, "hooked": hooked, **(placed.tables() if placed else {})})
        if placed:
            if placed.named is not None and placed.named is not placed.vertices:
                drop(placed.named)
            placed.named = placed.vertices
        if named is not hooked and named is not current:
            drop(named)
        named = hooked

    def one_move(t: float) -> int:
        """Converged vertices of all that aren't in bins."""
        nonlocal hooked
        n = placed.move(t) if placed else 0
        if hooked is not None:
            pushed = steps.propagate(hooked, links, ball, options, max_weight, degree)
            stepped, seen = cut_observed(steps.seed(hooked, pushed, state, t, options.accuracy), "places", n=F.sum("converged"))
            if hooked is not current and not (resume and hooked is named):
                drop(hooked)
            hooked = stepped.select(*current.columns)
            hooked._constella_path = stepped._constella_path
            n += seen["n"] or 0
        return n

    while not finished and done < options.limit:
        temperatures = []
        for _ in range(min(bins.length if bins else 1, options.limit - done)):
            temperatures.append(temperature)
            temperature = cooling.cool(temperature)
        after, counts = bins.run(temperatures) if bins else (None, [0] * len(temperatures))
        for i, t in enumerate(temperatures):
            n = counts[i] + one_move(t)
            done += 1
            finished = done > 5 and (n == total if options.strict else n >= options.convergence * total)
            if finished:
                if bins and i + 1 < len(temperatures):
                    drop(after)
                    after, _ = bins.run(temperatures[: i + 1])
                break
        earlier = None
        if bins:
            earlier, bins.table = bins.table, after
        if resume:
            keep()
        drop(earlier)
    if hooked is None:
        found = [x for x in (bins and bins.places(), placed and placed.vertices.select("id", "x", "y")) if x is not None]
        rest = [c for c in current.columns if c not in ("x", "y")]
        hooked = cut(reduce(DataFrame.unionByName, found).join(current.select(*rest), "id").select(*current.columns), "drawn") if found else current
    kept.end()
    if placed:
        messages += placed.partners
        placed.drop()
    drop(bins.table if bins else None, *[x for x in (state, current, ball, links, degree) if x is not hooked])
    return LayoutResult(hooked, done, options.k, messages)
