"""List relations: watch-list (S3), vaults (S4), roles.

Every list is a relation, never a driver-side set, so the same code serves
the 119-wallet case list and a watch-list of millions.  Addresses are
lower-cased, nulls dropped, repeats removed.
"""
from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config as C

_ADDR = T.StructType([T.StructField("address", T.StringType())])
ROLES_SCHEMA = T.StructType([
    T.StructField("address", T.StringType()),
    T.StructField("role", T.StringType()),
    T.StructField("priority", T.IntegerType()),
])


def _named(df: DataFrame, column: str):
    """The column of that name, in any case."""
    found = [c for c in df.columns if c.strip().lower() == column.lower()]
    if len(found) != 1:
        raise ValueError(f"the list needs one column {column!r}; it has {df.columns}")
    return F.col(f"`{found[0]}`")


def address_relation(spark: SparkSession, source, column: str = "address") -> DataFrame:
    """A one-column ``address`` relation from a list, a DataFrame or a path.

    ``.txt`` holds one address per line (a line with the column's name is a
    heading); ``.csv`` has a header and the column
    is found by its name (in any case); other paths are Parquet.  A table
    without the column raises.
    """
    if isinstance(source, DataFrame):
        df = source.select(_named(source, column).alias("address"))
    elif isinstance(source, str):
        if source.endswith(".txt"):
            df = (spark.read.text(source).select(F.trim("value").alias("address"))
                  .where(F.lower("address") != column.lower()))
        else:
            raw = (spark.read.csv(source, header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
                   if source.endswith(".csv") else spark.read.parquet(source))
            df = raw.select(_named(raw, column).alias("address"))
    elif isinstance(source, Iterable):
        df = spark.createDataFrame([(a,) for a in source], _ADDR)
    else:
        raise TypeError(f"unsupported list source: {type(source)!r}")
    return (df.select(F.lower(F.trim(F.col("address"))).alias("address"))
              .where(F.col("address").isNotNull() & (F.col("address") != ""))
              .dropDuplicates(["address"]))


def watchlist(spark: SparkSession, source) -> DataFrame:
    """S3: watch-listed wallets."""
    return address_relation(spark, source)


def vaults(spark: SparkSession, source) -> DataFrame:
    """Exit vault contracts."""
    return address_relation(spark, source)


def roles(spark: SparkSession, attackers=(), vaults=(), hops=()) -> DataFrame:
    """``(address, role, priority)`` from the three role lists.

    Lists may be Python lists, DataFrames or paths; the union keeps every
    (address, role) so a wallet with two roles is resolved by priority at
    lookup time (J3).
    """
    parts = []
    for source, role in ((attackers, C.ROLE_ATTACKER), (vaults, C.ROLE_VAULT), (hops, C.ROLE_HOP)):
        if source is None:
            continue
        if not isinstance(source, (DataFrame, str)):
            source = list(source)
            if not source:
                continue
        rel = address_relation(spark, source)
        parts.append(rel.select("address", F.lit(role).alias("role"),
                                F.lit(C.ROLE_PRIORITY[role]).cast("int").alias("priority")))
    if not parts:
        return spark.createDataFrame([], ROLES_SCHEMA)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def roles_from(df: DataFrame) -> DataFrame:
    """S5 from a relation ``(address, role[, priority])``; unknown roles rank last."""
    prio = F.col("priority").cast("int") if "priority" in df.columns else None
    if prio is None:
        prio = F.lit(None).cast("int")
        for role, p in C.ROLE_PRIORITY.items():
            prio = F.when(F.col("role") == role, F.lit(p)).otherwise(prio)
        prio = F.coalesce(prio, F.lit(len(C.ROLE_PRIORITY) + 1))
    return df.select(F.lower(F.col("address")).alias("address"), F.col("role"), prio.alias("priority"))
