"""Balanced k-way partitioning by label propagation with a load penalty and probabilistic migration.

The loop keeps, with each vertex, how often each label occurs around it (a map of k entries at most) and the label that it would choose next, in
files bucketed by vertex; edges lie in as many buckets of their source. A round reads the choices, without any join or new choice; moves go to the
edges, which stay where they are, and what they change is added to the counts of their neighbours, which choose again as they are written: rows that
travel follow the moves, not the graph. ``scores``, ``best_labels`` and ``migrate`` are one round from the edges alone.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from constella.functions.portable import uniform
from constella.iterate import cut, cut_buckets, cut_observed, drop, settings
from constella.manifest import Manifest, plain_values
from constella.operators.graph import bucket_count, degrees


@dataclass
class PartitionOptions:
    """Partitions, tolerated overload, weight of the penalty, and when to stop."""

    partitions: int = 32
    capacity: float = 0.1
    penalty: float = 1.0
    max_iterations: int = 250
    threshold: float = 0.001
    window: int = 5
    repartition: int = 0
    seed: int = 42

    @property
    def total(self) -> int:
        return self.partitions + self.repartition


@dataclass
class Partitioned:
    labels: DataFrame
    iterations: int
    metrics: list[dict] = field(default_factory=list)


def initial_labels(vertices: DataFrame, options: PartitionOptions, salt: int = 501) -> DataFrame:
    """(id, part): a given label, else a hashed one in [0, partitions)."""
    drawn = F.floor(uniform(F.col("id"), salt, options.seed) * options.partitions).cast("int")
    given = F.col("part") if "part" in vertices.columns else F.lit(-1)
    return vertices.select("id", F.when(given >= 0, given).otherwise(drawn).cast("int").alias("part"))


def changed_k(labels: DataFrame, options: PartitionOptions, salt: int = 502) -> DataFrame:
    """Labels after the number of partitions changed by ``options.repartition``."""
    k, r = options.partitions, options.repartition
    if r == 0:
        raise ValueError("the number of partitions does not change")
    draw = uniform(F.col("id"), salt, options.seed)
    if r < 0:
        part = F.when(F.col("part") >= k + r, F.floor(draw * (k + r)).cast("int")).otherwise(F.col("part"))
    else:
        fresh = (F.lit(k) + F.floor(uniform(F.col("id"), salt + 1, options.seed) * r)).cast("int")
        part = F.when(draw < r / (r + k), fresh).otherwise(F.col("part"))
    return labels.select("id", part.alias("part"))


def loads(labels: DataFrame, degree: DataFrame) -> DataFrame:
    """(part, load): sum of degrees of each label in use."""
    return labels.join(degree, "id").groupBy("part").agg(F.sum("degree").alias("load"))


def _ceil3(value: Column) -> Column:
    return F.ceil(F.round(value * 1000, 6)) / 1000.0


def scores(labels: DataFrame, edges: DataFrame, load: DataFrame, capacity: float, options: PartitionOptions) -> DataFrame:
    """(id, part, label, h, local, total) for every vertex and label that a neighbour, itself or the least loaded label offers.

    Labels that no neighbour has score by their load alone, so the best of them is the least loaded one (ties: the smallest);
    listing it stands for all of them.
    """
    rows = {r["part"]: r["load"] for r in load.collect()}
    full = [(p, int(rows.get(p, 0))) for p in range(options.total)]
    spark = labels.sparkSession
    table = F.broadcast(spark.createDataFrame(full, "label int, load bigint"))
    least = min(full, key=lambda t: (t[1], t[0]))[0]
    # Edges have both directions with the same weight: each vertex sends its label along its edges, which are in place by their source, and all offers are dealt once.
    heard = edges.join(labels.select(F.col("id").alias("src"), "part"), "src").select(F.col("dst").alias("id"), F.col("part").alias("label"), F.col("weight").cast("bigint").alias("freq"))
    total = edges.groupBy(F.col("src").alias("id")).agg(F.sum("weight").alias("total"))
    own = labels.select("id", F.col("part").alias("label"), F.lit(0).cast("bigint").alias("freq"))
    spare = labels.select("id", F.lit(least).alias("label"), F.lit(0).cast("bigint").alias("freq"))
    offers = heard.unionByName(own).unionByName(spare).repartition("id").groupBy("id", "label").agg(F.sum("freq").alias("freq"))
    h = F.lit(options.penalty) + F.col("freq") / F.col("total") - F.lit(options.penalty) * _ceil3(F.col("load") / F.lit(float(capacity)))
    return offers.join(total, "id").join(table, "label").join(labels, "id").select("id", "part", "label", h.alias("h"), "freq", "total")


def best_labels(scored: DataFrame, seed: int, salt: int) -> DataFrame:
    """(id, part, new_part, h_now, freq_now): the best label of each vertex; of equal ones the current, then a hashed one."""
    rank = F.struct(F.round("h", 9).alias("h"), (F.col("label") == F.col("part")).cast("int").alias("own"), uniform(F.concat_ws("-", F.col("id").cast("string"), F.col("label").cast("string")), salt, seed).alias("u"), "label")
    own = F.col("label") == F.col("part")
    out = scored.groupBy("id").agg(F.max(rank).alias("best"), F.max(F.when(own, F.col("h"))).alias("h_now"), F.max(F.when(own, F.col("freq"))).alias("freq_now"), F.first("part").alias("part"), F.first("total").alias("total"))
    return out.select("id", "part", F.col("best.label").alias("new_part"), "h_now", "freq_now", "total")


def migrate(chosen: DataFrame, degree: DataFrame, load: DataFrame, capacity: float, seed: int, salt: int) -> DataFrame:
    """(id, part) after migration: each wish is granted with the share of the target's room in the demand for it."""
    wishes = chosen.where("new_part <> part").join(degree, "id")
    demand = wishes.groupBy(F.col("new_part").alias("label")).agg(F.sum("degree").alias("demand"))
    room = demand.join(load.withColumnRenamed("part", "label"), "label", "left").select(
        F.col("label").alias("new_part"), F.greatest(F.lit(0.0), (F.lit(float(capacity)) - F.coalesce("load", F.lit(0))) / F.col("demand")).alias("chance")
    )
    out = chosen.join(F.broadcast(room), "new_part", "left")
    go = (F.col("new_part") != F.col("part")) & (uniform(F.col("id"), salt, seed) < F.col("chance"))
    return out.select("id", F.when(go, F.col("new_part")).otherwise(F.col("part")).alias("part"))


def quality(labels: DataFrame, edges: DataFrame, options: PartitionOptions) -> DataFrame:
    """One row: local-edge ratio, largest and smallest load, largest load over the mean."""
    degree = degrees(edges)
    ends = edges.join(labels.select(F.col("id").alias("src"), F.col("part").alias("p")), "src").join(labels.select(F.col("id").alias("dst"), F.col("part").alias("q")), "dst")
    local = ends.agg((F.sum((F.col("p") == F.col("q")).cast("int")) / F.count("*")).alias("local_ratio"), F.count("*").alias("ends"))
    load = loads(labels, degree).agg(F.max("load").alias("max_load"), F.when(F.count("*") < options.total, F.lit(0)).otherwise(F.min("load")).alias("min_load"))
    joined = local.crossJoin(load)
    unbalance = F.when(F.col("min_load") > 0, F.col("max_load") / F.col("min_load")).alias("max_min_unbalance")
    return joined.select("local_ratio", "max_load", "min_load", (F.col("max_load") * options.total / F.col("ends")).alias("max_normalised_load"), unbalance)


class Convergence:
    """Whether a score hardly changed against the best of the scores before it.

    Steps count half-rounds as the options do: scores come at steps 4, 6, 8 and so on. The first that is tested comes after step ``3 + window``;
    from then on each new score replaces the oldest one.
    """

    def __init__(self, window: int, threshold: float):
        self.window, self.threshold, self.states = window, threshold, []

    def __call__(self, step: int, score: float) -> bool:
        settled = False
        if step > 3 + self.window and self.states:
            settled = abs(1 - score / max(self.states)) < self.threshold
            self.states.pop(0)
        self.states.append(score)
        return settled


#: Moves that are broadcast at most, 20 bytes each; more are dealt to the buckets of the edges.
BROADCAST_MOVES = 500_000
#: Labels that are counted in a column each; more are counted in a row each.
WIDE_LABELS = 64


def heard_labels(labels: DataFrame, edges: DataFrame, degree: DataFrame, k: int | None = None) -> DataFrame:
    """id, part, degree, total (weight of its edges) and heard: the weight of its neighbours by label."""
    counts = moved_counts(edges, labels.select("id", F.lit(-1).alias("old"), F.col("part").alias("new")).hint("shuffle_hash"), k)
    state = labels.join(degree, "id", "left").join(counts.hint("shuffle_hash"), "id", "left")
    heard = F.coalesce("change", F.create_map().cast("map<int,bigint>"))
    total = F.aggregate(F.map_values(heard), F.lit(0).cast("bigint"), lambda a, b: a + b)
    return state.select("id", "part", F.coalesce("degree", F.lit(0)).alias("degree"), total.alias("total"), heard.alias("heard"))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is named."""
    return F.element_at(F.transform(F.array(value), use), 1)


def choose(state: DataFrame, load: list[int], capacity: float, options: PartitionOptions, salt: int) -> DataFrame:
    """``state`` with new_part, h_now and freq_now: what ``scores`` and ``best_labels`` give, from the kept counts. Vertices without edges keep their label."""
    least = min(range(len(load)), key=lambda p: (load[p], p))
    # Constant, so computed once: what the loads take off.
    off = F.array(*[F.lit(options.penalty) * _ceil3(F.lit(x).cast("bigint") / F.lit(float(capacity))) for x in load])
    freq = lambda label: F.coalesce(F.try_element_at("heard", label), F.lit(0).cast("bigint"))
    h = lambda label: F.lit(options.penalty) + freq(label) / F.col("total") - F.element_at(off, label + 1)
    draw = lambda label: uniform(F.concat_ws("-", F.col("id").cast("string"), label.cast("string")), salt, options.seed)
    offers = F.array_union(F.map_keys("heard"), F.array("part", F.lit(least)))
    rank = lambda label: F.struct(F.round(h(label), 9).alias("h"), (label == F.col("part")).cast("int").alias("own"), draw(label).alias("u"), label.alias("label"))
    # Only labels that rounding may make equal to the best are rounded and drawn for; mostly there is one.
    near = lambda all_: _let(F.array_max(F.transform(all_, h)), lambda top: F.filter(all_, lambda label: h(label) >= top - 2e-9))
    best = _let(offers, lambda all_: _let(near(all_), lambda some: F.when(F.size(some) == 1, F.element_at(some, 1)).otherwise(F.array_max(F.transform(some, rank))["label"])))
    some = F.col("total") > 0
    return state.withColumns({"new_part": F.when(some, best).otherwise(F.col("part")), "h_now": F.when(some, h(F.col("part"))), "freq_now": F.when(some, freq(F.col("part")))})


def _granted(chosen: DataFrame, chance: list[float], seed: int, salt: int) -> DataFrame:
    go = (F.col("new_part") != F.col("part")) & (uniform(F.col("id"), salt, seed) < F.element_at(F.array(*[F.lit(float(c)) for c in chance]), F.col("new_part") + 1))
    return chosen.withColumn("after", F.when(go, F.col("new_part")).otherwise(F.col("part")))


def moved_counts(edges: DataFrame, moves: DataFrame, k: int | None = None) -> DataFrame:
    """id, change: by label, what the moves (id, old, new) of some of ``k`` labels change in the counts of their neighbours. ``old`` is -1 for a first label."""
    at = edges.join(moves.withColumnRenamed("id", "src"), "src").select(F.col("dst").alias("id"), "old", "new", F.col("weight").cast("bigint").alias("by"))
    if k is not None and k <= WIDE_LABELS:
        # Added up before they travel, and dealt once.
        by = lambda p: F.when(F.col("new") == p, F.col("by")).when(F.col("old") == p, -F.col("by")).otherwise(F.lit(0))
        sums = at.groupBy("id").agg(*[F.sum(by(p)).alias(f"by{p}") for p in range(k)])
        change = F.map_from_arrays(F.array(*[F.lit(p) for p in range(k)]), F.array(*[F.col(f"by{p}") for p in range(k)]))
        return sums.select("id", F.map_filter(change, lambda _, n: n != 0).alias("change"))
    both = F.array(F.struct(F.col("old").alias("label"), (-F.col("by")).alias("by")), F.struct(F.col("new").alias("label"), F.col("by").alias("by")))
    sums = at.select("id", F.explode(both).alias("c")).where("c.label >= 0").groupBy("id", "c.label").agg(F.sum("c.by").alias("by"))
    return sums.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("label", "by"))).alias("change"))


def partition_graph(vertices: DataFrame, edges: DataFrame, options: PartitionOptions | None = None, watch: Callable | None = None, resume: str | None = None) -> Partitioned:
    """Label propagation until the total score settles, or ``max_iterations`` steps are done; the wishes of the last step aren't granted.

    An empty graph, or one without edges, keeps its first labels. ``watch`` gets the number of a round and the labels after it. ``resume`` names a
    manifest: a loop of that name that a lost driver left is gone on with after its last round, on the edges that it began with.
    Edges that ``written`` made are used where they lie, and left there.
    """
    options = options or PartitionOptions()
    # As many partitions as buckets: what is dealt by a vertex meets its state and its edges without being dealt again.
    with settings(vertices.sparkSession, spark__sql__shuffle__partitions=str(bucket_count(edges))):
        return _partition(vertices, edges, options, watch, resume)


def _partition(vertices: DataFrame, given: DataFrame, options: PartitionOptions, watch: Callable | None, resume: str | None) -> Partitioned:
    spark, buckets = vertices.sparkSession, bucket_count(given)
    kept = Manifest(spark, resume, "partition", plain_values(options))
    before = kept.load()
    settled, out = Convergence(options.window, options.threshold), Partitioned(vertices, 0)
    if before:
        values, tables = before
        edges, state = tables["edges"], tables["state"]
        load, total, out.metrics, settled.states = values["load"], values["total"], values["metrics"], values["scores"]
        out.iterations = number = values["round"]
    else:
        dealt = getattr(given, "_constella_buckets", ("", 0))[0] == "src"
        edges = given if dealt else cut_buckets(given.select("src", "dst", "weight").repartition(buckets, "src"), "edges", "src", buckets)
        labels = initial_labels(vertices, options)
        if options.repartition:
            labels = changed_k(labels, options)
        first = labels.join(degrees(edges), "id", "left").select("id", "part", F.coalesce("degree", F.lit(0)).alias("degree"))
        first = cut_buckets(first.repartition(buckets, "id"), "labels", "id", buckets)
        total, number = edges.count(), 0
        load = [0] * options.total
        for part, n in first.groupBy("part").agg(F.sum("degree")).collect():
            load[part] = n
    capacity = round(total * (1 + options.capacity) / options.total)
    if not before:
        state = heard_labels(first.select("id", "part"), edges, first.select("id", "degree"), options.total)
        state = cut_buckets(choose(state, load, capacity, options, 600), "labels", "id", buckets)
        drop(first)
    buckets = state._constella_buckets[1]
    while 2 * number + 3 < options.max_iterations:
        wish = F.col("new_part") != F.col("part")
        # A row for each label in use: k at most, as in all that is collected here.
        sums = state.groupBy("new_part").agg(F.sum("h_now").alias("score"), F.sum("freq_now").alias("local"), F.sum("total").alias("total"), F.count_if(wish).alias("wishes"), F.sum(F.when(wish, F.col("degree"))).alias("demand")).collect()
        score = sum(r["score"] for r in sums if r["score"] is not None) if any(r["score"] is not None for r in sums) else None
        used = [x for x in load if x]
        out.metrics.append({
            "iteration": number, "score": score, "local_ratio": sum(r["local"] or 0 for r in sums) / max(sum(r["total"] or 0 for r in sums), 1), "wishes": sum(r["wishes"] for r in sums),
            "max_normalised_load": max(load, default=0) * options.total / max(total, 1), "max_min_unbalance": max(load) / min(load) if len(used) == len(load) and used else None, "migrations": 0,
        })
        if score is None or settled(2 * number + 4, score) or 2 * number + 4 >= options.max_iterations:
            break
        chance = [0.0] * options.total
        for r in sums:
            if r["demand"]:
                chance[r["new_part"]] = max(0.0, (float(capacity) - load[r["new_part"]]) / r["demand"])
        granted = _granted(state, chance, options.seed, 900 + number)
        moves = granted.where("after <> part").select("id", F.col("part").alias("old"), F.col("after").alias("new"), "degree")
        moves, seen = cut_observed(moves, "moves", n=F.count(F.lit(1)))
        out.metrics[-1]["migrations"] = seen["n"]
        if seen["n"]:
            for old, new, n in moves.groupBy("old", "new").agg(F.sum("degree")).collect():
                load[old] -= n
                load[new] += n
            moved = moves.select("id", "old", "new")
            changes = moved_counts(edges, F.broadcast(moved) if seen["n"] <= BROADCAST_MOVES else moved.hint("shuffle_hash"), options.total)
            both = F.map_zip_with(F.col("heard"), F.col("change"), lambda _, a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))
            heard = F.when(F.col("change").isNull(), F.col("heard")).otherwise(F.map_filter(both, lambda _, n: n != 0))
            following = granted.join(changes.hint("shuffle_hash"), "id", "left").select("id", F.col("after").alias("part"), "degree", "total", heard.alias("heard"))
        else:
            following = state.select("id", "part", "degree", "total", "heard")
        following = cut_buckets(choose(following, load, capacity, options, 600 + number + 1), "labels", "id", buckets)
        out.iterations = number = number + 1
        kept.save({"load": load, "total": total, "metrics": out.metrics, "scores": settled.states, "round": number}, {"edges": edges, "state": following})
        drop(state, moves)
        state = following
        if watch:
            watch(number, state.select("id", "part"))
    out.labels = cut(state.select("id", "part"), "labels")
    kept.end()
    drop(state)
    if edges is not given:
        drop(edges)
    return out


def by_partition(df: DataFrame, n: int, column: str = "part") -> DataFrame:
    """Rows of one label in one task: the label chooses the owner."""
    return df.repartition(n, column)
