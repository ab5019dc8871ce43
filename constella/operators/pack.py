"""Packing: components in a grid, the largest at the origin and the others in rows to its right."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from constella.iterate import cut


def numbered(df: DataFrame, *order) -> DataFrame:
    """``df`` with ``rank`` from 0 in the given order, without bringing all rows to one task.

    Rows are dealt by ranges of the order, written, and numbered inside their range; the sizes of the ranges give each its start.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(df.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()), "ranges")
    within = dealt.withColumn("__at", F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1)
    sizes = dealt.groupBy("__part").agg(F.count("*").alias("__n"))
    starts = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__start"))
    return within.join(F.broadcast(starts), "__part").withColumn("rank", (F.col("__at") + F.col("__start")).cast("bigint")).drop("__part", "__at", "__start")


def pack_components(boxes: DataFrame, padding: float = 20.0, least_ratio: float = 0.2) -> DataFrame:
    """(component, off_x, off_y, ratio, cur_x, cur_y) from bounding boxes and sizes ``n``.

    Components come by size and id, descending. Row and column follow from the rank; places are sums of the
    widths before in the row and of the tallest of the rows before.
    """
    ranked = cut(numbered(boxes, F.desc("n"), F.desc("component")), "ranked")
    total = ranked.count()
    columns = max(1, math.ceil(math.sqrt(total - 1))) if total > 1 else 1
    top = ranked.where("rank = 0").select(F.col("n").alias("top_n"), (F.col("max_x") - F.col("min_x")).alias("top_w"))
    sized = ranked.crossJoin(F.broadcast(top)).withColumn("ratio", F.greatest(F.col("n") / F.col("top_n"), F.lit(least_ratio)))
    sized = sized.withColumns(
        {
            "row": F.when(F.col("rank") > 0, F.floor((F.col("rank") - 1) / columns)),
            "w": (F.col("max_x") - F.col("min_x")) * F.col("ratio"),
            "h": (F.col("max_y") - F.col("min_y")) * F.col("ratio"),
        }
    )
    # The number of rows is about the square root of the number of components.
    rows = sized.where("rank > 0").groupBy("row").agg(F.max("h").alias("tall"))
    above = rows.select("row", F.coalesce(F.sum(F.col("tall") + padding).over(Window.orderBy("row").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("cur_y"))
    left = F.coalesce(F.sum(F.col("w") + padding).over(Window.partitionBy("row").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    grid = sized.where("rank > 0").withColumn("cur_x", F.col("top_w") + padding + left).join(above, "row")
    first = sized.where("rank = 0").withColumns({"cur_x": F.lit(0.0), "cur_y": F.lit(0.0), "ratio": F.lit(1.0)})
    columns_out = ["component", (-F.col("min_x")).alias("off_x"), (-F.col("min_y")).alias("off_y"), "ratio", "cur_x", "cur_y"]
    return first.select(*columns_out).unionByName(grid.select(*columns_out))


def apply_packing(vertices: DataFrame, packing: DataFrame) -> DataFrame:
    moved = vertices.join(packing, "component")
    x = (F.col("x") + F.col("off_x")) * F.col("ratio") + F.col("cur_x")
    y = (F.col("y") + F.col("off_y")) * F.col("ratio") + F.col("cur_y")
    return moved.withColumns({"x": x, "y": y}).select(*vertices.columns)
