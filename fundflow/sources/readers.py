"""Scans (S1, S2, S7, S9) and load-time normalisation.

Readers select only the columns the model uses, so the Parquet scan prunes
the rest, and they lower-case address/hash keys once at load.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from . import versions
from ..functions import lower_key, money


def _type(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def _time_text(df: DataFrame, name: str):
    """Block time as text; typed timestamps become the canonical UTC text."""
    dt = _type(df, name)
    if isinstance(dt, T.StringType):
        return F.col(name)
    from ..functions import block_time_text, parse_block_time
    return block_time_text(parse_block_time(F.col(name), dt))


def normalize_transfers(df: DataFrame, lower_keys: bool = True, safe_amounts: bool = False) -> DataFrame:
    """Transfers in canonical form: lower-case keys, exact amounts, text time."""
    key = lower_key if lower_keys else F.col
    return df.select(
        key("tx_hash").alias("tx_hash"),
        _time_text(df, "block_time").alias("block_time"),
        key("from_address").alias("from_address"),
        key("to_address").alias("to_address"),
        money("amount", _type(df, "amount"), safe_amounts).alias("amount"),
        money("amount_usd", _type(df, "amount_usd"), safe_amounts).alias("amount_usd"),
    )


def normalize_transactions(df: DataFrame, lower_keys: bool = True) -> DataFrame:
    """The four transaction columns the model uses (hash, time, from, to)."""
    key = lower_key if lower_keys else F.col
    return df.select(
        key("hash").alias("hash"),
        _time_text(df, "block_time").alias("block_time"),
        key("from").alias("from"),
        key("to").alias("to"),
    )


def scan_transfers(spark: SparkSession, path: str, schema: T.StructType | None = None, **kw) -> DataFrame:
    """Transfer events (Parquet directory or file).

    ``schema`` gives the stored types (``schema.TRANSFERS``: all text) and
    saves the footer inference; without it the stored types are read from
    one footer, since amounts and times may be text, numbers or timestamps.
    """
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return normalize_transfers(reader.parquet(path).select(*S.TRANSFER_COLUMNS), **kw)


def scan_transactions(spark: SparkSession, path: str, schema: T.StructType | None = None, **kw) -> DataFrame:
    """Transactions; only hash, block_time, from, to are read (``schema`` as in S1)."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return normalize_transactions(reader.parquet(path).select(*S.TRANSACTION_COLUMNS), **kw)


def _stored(spark: SparkSession, path: str, schema: T.StructType, form: str) -> DataFrame:
    """A dataset with its schema given; an absent one is empty."""
    if not versions.exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).format(form).load(path)


def scan_actions(spark: SparkSession, path: str) -> DataFrame:
    """The newest action table written by ``write_actions``, or a plain Parquet folder.

    The schema is given, so no footer is read for it.
    """
    return _stored(spark, versions.current(spark, path) or path, S.ACTIONS, "parquet")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the newest graph written by ``write_graph``, or of a plain folder.

    Two JSON-lines datasets ``nodes`` and ``edges``, read with their schema
    given (no inference pass), split across tasks like any line-oriented
    input.  An absent part is empty.
    """
    folder = versions.current(spark, path) or path
    return _stored(spark, f"{folder}/nodes", S.NODES, "json"), _stored(spark, f"{folder}/edges", S.EDGES, "json")
