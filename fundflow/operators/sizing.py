"""Size checks used before a broadcast.

Each check is an aggregation: every task sends one row of partial sums,
never its rows, so the check itself gathers nothing.
"""
from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config as C


class Size(NamedTuple):
    rows: int
    bytes: int

    @property
    def broadcastable(self) -> bool:
        return self.rows <= C.BROADCAST_MAX_ROWS and self.bytes <= C.BROADCAST_MAX_BYTES


def size_of(df: DataFrame) -> Size:
    """Rows, and bytes as a broadcast holds them (texts by their length, other values and each row's frame by 16)."""
    text = [F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0)) for f in df.schema.fields
            if isinstance(f.dataType, (T.StringType, T.BinaryType))]
    width = F.lit(16 * (len(df.columns) + 1)).cast("bigint")
    for t in text:
        width = width + t
    r = df.agg(F.count(F.lit(1)).alias("n"), F.sum(width).alias("b")).first()
    return Size(r.n, r.b or 0)


def broadcastable(df: DataFrame) -> bool:
    """True when ``df`` is small enough, in rows and bytes, to be broadcast."""
    return size_of(df).broadcastable


def checked_broadcast(df: DataFrame) -> DataFrame:
    """``df`` marked for broadcast if its checked size allows; else the join is Spark's to plan."""
    return F.broadcast(df) if broadcastable(df) else df


def rows_at_most(df: DataFrame, limit: int) -> bool:
    """True when ``df`` has at most ``limit`` rows."""
    return df.count() <= limit
