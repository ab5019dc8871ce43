"""Loops that a later session can go on with: a manifest names the tables that a loop has written, and holds its driver's variables.

A step writes its tables, then the next manifest, then deletes what only the one before named. A manifest is a numbered JSON file, written under
another name first, in ``<spark.checkpoint.dir>/<name>``; the highest number counts. A session that ends between two of these leaves files behind, never a wrong state.

Defined results: a name without a manifest starts anew; a manifest of other parameters, or of another kind of loop, is an error; an ended loop leaves none.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from constella.iterate import cut, drop_path, shared_dir


def plain_values(options: object) -> dict:
    """What identifies a loop's parameters: their plain values, and the types of objects such as force models."""
    return {k: v if isinstance(v, (int, float, str, bool, type(None))) else type(v).__qualname__ for k, v in sorted(vars(options).items())}


def _described(df: DataFrame) -> dict:
    if not hasattr(df, "_constella_path"):
        raise ValueError("only written tables can be named in a manifest")
    return {"path": df._constella_path, "schema": df.schema.jsonValue(), "buckets": getattr(df, "_constella_buckets", None)}


def _opened(spark: SparkSession, about: dict) -> DataFrame:
    """The table as it was, in its buckets, under a name of this session's catalogue."""
    schema, table = StructType.fromJson(about["schema"]), None
    if about["buckets"]:
        column, n = about["buckets"]
        table = f"resumed_{uuid.uuid4().hex}"
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY ({column}) SORTED BY ({column}) INTO {n} BUCKETS LOCATION '{about['path']}'")
        out = spark.table(table)
        out._constella_table, out._constella_buckets = table, (column, n)
    else:
        out = spark.read.schema(schema).parquet(about["path"])
    out._constella_path = about["path"]
    return out


class Manifest:
    """The manifest of one loop. ``about`` says which loop with which parameters it is; without a name nothing is kept."""

    def __init__(self, spark: SparkSession, name: str | None, kind: str, about: dict | None = None):
        self.spark, self.name, self.number = spark, name, 0
        self.about = {"kind": kind, **(about or {})}
        if name:
            jvm = spark.sparkContext._jvm
            self._path = lambda *parts: jvm.org.apache.hadoop.fs.Path("/".join([shared_dir(spark), name, *parts]))
            self._fs = self._path().getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        if not self._fs.exists(self._path()):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(self._path())]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def load(self) -> tuple[dict, dict[str, DataFrame]] | None:
        """Variables and tables of the last step that was kept."""
        numbers = self._numbers() if self.name else []
        if not numbers:
            return None
        self.number = numbers[-1]
        text = "\n".join(r.value for r in self.spark.read.text(self._path(f"{self.number}.json").toString()).collect())
        kept = json.loads(text)
        if kept["about"] != json.loads(json.dumps(self.about)):
            raise ValueError(f"{self.name} was begun with other parameters: {kept['about']}")
        return kept["values"], {k: _opened(self.spark, t) for k, t in kept["tables"].items()}

    def save(self, values: dict, tables: dict[str, DataFrame | None]) -> None:
        """Keep a step; tables that only earlier steps need may be deleted afterwards."""
        if not self.name:
            return
        kept = {"about": self.about, "values": values, "tables": {k: _described(t) for k, t in tables.items() if t is not None}}
        before, self.number = self._numbers(), self.number + 1
        draft = self._path(f"{self.number}.draft")
        stream = self._fs.create(draft, True)
        stream.write(bytearray(json.dumps(kept).encode()))
        stream.close()
        if not self._fs.rename(draft, self._path(f"{self.number}.json")):
            raise OSError(f"{draft.toString()} can't be renamed")
        for n in before:
            self._fs.delete(self._path(f"{n}.json"), False)

    def end(self) -> None:
        """The loop is done: nothing to go on with."""
        if self.name:
            drop_path(self.spark, self._path().toString())

    def part(self, name: str) -> str | None:
        """Name of a loop inside this one."""
        return f"{self.name}-{name}" if self.name else None


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table that a manifest can name."""
    return df if hasattr(df, "_constella_path") else cut(df, name)
