"""Lineage cuts for driver-side loops: written tables in the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import gc
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder only where it is unset and all tasks run in this process."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="constella-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


@contextlib.contextmanager
def settings(spark: SparkSession, **values: str):
    """Session settings (dots written as double underscores) for the queries that run inside, put back afterwards."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` and read it again, so that a loop's plan stays flat and lost executors cost one step at most."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._constella_path = path
    return out


def cut_observed(df: DataFrame, name: str, **totals: Column) -> tuple[DataFrame, dict]:
    """``cut``, and aggregates of its rows taken while they are written, so that no second job reads them.

    They are taken in the writing stage, which counts each partition once whatever attempts it took.
    """
    seen = Observation()
    out = cut(df.observe(seen, *[c.alias(n) for n, c in totals.items()]), name)
    return out, seen.get


def cut_buckets(df: DataFrame, name: str, column: str, n: int) -> DataFrame:
    """``cut`` into ``n`` buckets by a column: a later join on it leaves these rows where they are. ``df`` should be dealt by it already."""
    spark = df.sparkSession
    path, table = new_path(spark, name), f"{name.replace('-', '_')}_{uuid.uuid4().hex}"
    try:
        df.write.option("compression", "zstd").option("path", path).bucketBy(n, column).sortBy(column).saveAsTable(table)
    except BaseException:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
        raise
    out = spark.table(table)
    out._constella_path, out._constella_table, out._constella_buckets = path, table, (column, n)
    return out


def drop(*tables: DataFrame | None) -> None:
    """Delete the files behind tables that ``cut`` and ``cut_buckets`` wrote; other tables are left alone."""
    for df in tables:
        path, table = getattr(df, "_constella_path", None), getattr(df, "_constella_table", None)
        if table:
            df.sparkSession.sql(f"DROP TABLE IF EXISTS {table}")
        if path:
            drop_path(df.sparkSession, path)


def drop_path(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of queries that are done; it acts when references are collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
