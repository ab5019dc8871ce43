"""JSON-array text lines: readers of the four line formats and writers of the four output formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from constella.functions.portable import uniform
from constella.iterate import cut
from constella.operators.graph import symmetrise

FAILFAST, DROP = "FAILFAST", "DROPMALFORMED"


def read_lines(spark: SparkSession, path: str, named: bool = False) -> DataFrame:
    """value, and with ``named`` the file of each line."""
    lines = spark.read.text(path)
    return lines.select("value", F.col("_metadata.file_path").alias("file")) if named else lines


def _checked(lines: DataFrame, count: int, numeric: tuple[int, ...], lists: tuple[int, ...]) -> DataFrame:
    """value, ``a`` (the line's fields as text) and reason: what is wrong with the line, null for a good one. Blank lines are left out."""
    parsed = lines.where(F.length(F.trim("value")) > 0).withColumn("a", F.from_json("value", "array<string>"))
    reason = F.when(F.col("a").isNull(), F.lit("not an array")).when(F.size("a") < count, F.lit(f"fewer than {count} fields"))
    for i in numeric:
        reason = reason.when(F.expr(f"try_cast(a[{i}] AS DOUBLE)").isNull(), F.lit(f"field {i} is not a number"))
    for i in lists:
        reason = reason.when(F.from_json(F.expr(f"a[{i}]"), "array<string>").isNull(), F.lit(f"field {i} is not an array"))
    return parsed.withColumn("reason", reason)


def _fields(lines: DataFrame, count: int, numeric: tuple[int, ...], lists: tuple[int, ...], mode: str) -> DataFrame:
    """``a``: the line's fields as text. A line that isn't an array of enough well-formed fields is an error, or dropped."""
    checked = _checked(lines, count, numeric, lists)
    if mode == DROP:
        return checked.where("reason is null").select("a")
    bad = F.raise_error(F.concat(F.lit("malformed line: "), F.col("value"))).cast("array<string>")
    return checked.select(F.when(F.col("reason").isNull(), F.col("a")).otherwise(bad).alias("a"))


#: Least number of fields, and which of them are numbers and arrays, of the line formats.
FORMATS = {"partition": (4, (0, 1, 2), (3,)), "layout": (7, (0, 1, 2, 3, 4), (5, 6))}


def split_lines(lines: DataFrame, form: str) -> tuple[DataFrame, DataFrame]:
    """Good lines (value), and rejected ones as (file, value, reason), from one read: what was checked is written once, both parts read it.

    ``file`` is null where the lines don't say theirs.
    """
    named = lines.select("value", F.col("file") if "file" in lines.columns else F.lit(None).cast("string").alias("file"))
    checked = cut(_checked(named, *FORMATS[form]).select("file", "value", "reason"), "lines")
    return checked.where("reason is null").select("value"), checked.where("reason is not null").select("file", "value", "reason")


def read_partition_input(lines: DataFrame, mode: str = FAILFAST, constants: bool = False) -> tuple[DataFrame, DataFrame]:
    """``[id, x, y, [nbr, ...]]``: vertices and symmetric edges of weight 1. ``constants`` adds part 0 and component 0."""
    a = _fields(lines, *FORMATS["partition"], mode)
    vertices = a.select(F.expr("CAST(a[0] AS BIGINT)").alias("id"), F.expr("CAST(a[1] AS DOUBLE)").alias("x"), F.expr("CAST(a[2] AS DOUBLE)").alias("y"))
    if constants:
        vertices = vertices.withColumns({"part": F.lit(0), "component": F.lit(0).cast("bigint")})
    edges = a.select(F.expr("CAST(a[0] AS BIGINT)").alias("src"), F.explode(F.from_json(F.expr("a[3]"), "array<bigint>")).alias("dst"))
    return vertices, symmetrise(edges)


def read_layout_input(lines: DataFrame, mode: str = FAILFAST, layered: bool = False) -> tuple[DataFrame, DataFrame]:
    """``[id, component, partition, x, y, [leaves], [[nbr, nbrPart], ...]]``; ``layered`` adds layer 0."""
    a = _fields(lines, *FORMATS["layout"], mode)
    vertices = a.select(
        F.expr("CAST(a[0] AS BIGINT)").alias("id"), F.expr("CAST(a[1] AS BIGINT)").alias("component"), F.expr("CAST(a[2] AS INT)").alias("part"),
        F.expr("CAST(a[3] AS DOUBLE)").alias("x"), F.expr("CAST(a[4] AS DOUBLE)").alias("y"), F.from_json(F.expr("a[5]"), "array<bigint>").alias("one_edges"),
    )
    edges = a.select(F.expr("CAST(a[0] AS BIGINT)").alias("src"), F.explode(F.from_json(F.expr("a[6]"), "array<array<bigint>>")).alias("e"))
    edges = symmetrise(edges.select("src", F.expr("e[0]").alias("dst")))
    if layered:
        vertices, edges = vertices.withColumn("layer", F.lit(0)), edges.withColumn("layer", F.lit(0))
    return vertices, edges


def read_tables(spark: SparkSession, vertices_path: str, edges_path: str) -> tuple[DataFrame, DataFrame]:
    """The same graph from Parquet tables (id, ...) and (src, dst[, weight])."""
    return spark.read.parquet(vertices_path), symmetrise(spark.read.parquet(edges_path))


# --- writers -----------------------------------------------------------------------------------


def _list(column: str | Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.coalesce(column if isinstance(column, Column) else F.col(column), F.array().cast("array<string>")), ","), F.lit("]"))


def _neighbours(edges: DataFrame, parts: DataFrame | None) -> DataFrame:
    """(id, nbrs): sorted texts ``nbr`` or ``[nbr,part]`` of each vertex."""
    if parts is None:
        listed = edges.groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_list("dst")).cast("array<string>").alias("nbrs"))
    else:
        known = edges.join(parts.select(F.col("id").alias("dst"), "part"), "dst", "left")
        pairs = known.groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_list(F.struct("dst", F.coalesce("part", F.lit(0)).alias("part")))).alias("p"))
        listed = pairs.select("id", F.transform("p", lambda e: F.concat(F.lit("["), e["dst"].cast("string"), F.lit(","), e["part"].cast("string"), F.lit("]"))).alias("nbrs"))
    return listed


def _line(*fields: Column) -> Column:
    return F.concat(F.lit("["), F.concat_ws(",", *fields), F.lit("]")).alias("value")


def partition_lines(vertices: DataFrame, edges: DataFrame, show_component: bool = True, randomise: bool = True, box_x: float = 1200.0, box_y: float | None = None, seed: int = 42) -> DataFrame:
    """``[id,(component,)part,x,y,[leaves],[[nbr,nbrPart],...]]``; coordinates are drawn from a box by default."""
    v = vertices.join(_neighbours(edges, vertices), "id", "left")
    x = uniform(F.col("id"), 701, seed) * F.lit(float(box_x)) if randomise else F.col("x")
    y = uniform(F.col("id"), 702, seed) * F.lit(float(box_x if box_y is None else box_y)) if randomise else F.col("y")
    leaves = F.col("one_edges").cast("array<string>") if "one_edges" in vertices.columns else F.array().cast("array<string>")
    middle = [F.col("component").cast("string")] if show_component else []
    return v.select(_line(F.col("id").cast("string"), *middle, F.col("part").cast("string"), x.cast("string"), y.cast("string"), _list(leaves), _list("nbrs")))


def layout_lines(vertices: DataFrame, edges: DataFrame, show_partition: bool = False, show_component: bool = True, bare_ids: bool = False) -> DataFrame:
    """``[id,(part,)x,y(,component),[edges]]``; edges are pairs with the partition, or bare ids."""
    if "part" not in vertices.columns:
        vertices = vertices.withColumn("part", F.lit(0))
    if "layer" in vertices.columns:
        vertices = vertices.where("layer = 0")
    v = vertices.join(_neighbours(edges, None if bare_ids and not show_partition else vertices), "id", "left")
    first = [F.col("part").cast("string")] if show_partition else []
    last = [F.col("component").cast("string")] if show_component else []
    return v.select(_line(F.col("id").cast("string"), *first, F.col("x").cast("string"), F.col("y").cast("string"), *last, _list("nbrs")))


def body_lines(bodies: DataFrame, vertices: DataFrame, edges: DataFrame, layer: int) -> DataFrame:
    """``[id,layer,x,y,SUN|PLANET|MOON|ASTEROID,sun,[[nbr,nbrLayer,weight],...]]`` of every vertex of a layer."""
    cell = F.concat(F.lit("["), F.col("dst").cast("string"), F.lit(f",{layer},"), F.col("weight").cast("string"), F.lit("]"))
    nbrs = edges.groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_list(F.struct("dst", cell.alias("c")))).alias("p")).select("id", F.transform("p", lambda e: e["c"]).alias("nbrs"))
    v = vertices.select("id", "x", "y").join(bodies.select("id", "sun", "hops"), "id", "left").join(nbrs, "id", "left")
    return v.select(_line(F.col("id").cast("string"), F.lit(str(layer)), F.col("x").cast("string"), F.col("y").cast("string"), body_name(F.col("hops")), F.coalesce("sun", F.lit(-1)).cast("string"), _list("nbrs")))


def body_name(hops: Column) -> Column:
    return F.when(hops == 0, "SUN").when(hops == 1, "PLANET").when(hops > 1, "MOON").otherwise("ASTEROID")


def write_lines(lines: DataFrame, path: str) -> None:
    lines.write.text(path)
