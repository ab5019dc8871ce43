"""Seeded uniform numbers that Spark and other SQL engines compute alike, in place of unseeded randomness."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(key: Column, salt: int | Column, seed: int = 42) -> Column:
    """A number in [0, 1) from the first 32 bits of md5("key:salt:seed")."""
    text = F.concat_ws(":", key.cast("string"), (salt if isinstance(salt, Column) else F.lit(salt)).cast("string"), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def uniform_sql(key: str, salt: int | str, seed: int = 42) -> str:
    """The same number as DuckDB SQL."""
    return f"(CAST('0x' || substr(md5(concat_ws(':', CAST({key} AS VARCHAR), '{salt}', '{seed}')), 1, 8) AS BIGINT) / 4294967296.0)"
