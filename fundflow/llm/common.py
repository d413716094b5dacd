"""Helpers shared by the operators of this package."""
from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from ..session import scratch_path

_MAKING: ContextVar[list[str] | None] = ContextVar("making", default=None)


@contextmanager
def making() -> Iterator[list[str]]:
    """Collects the paths of the tables that operators write inside it; who opens it owns them."""
    own: list[str] = []
    token = _MAKING.set(own)
    try:
        yield own
    finally:
        _MAKING.reset(token)


def made_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, told to whoever collects them (``making``)."""
    path = scratch_path(spark, name)
    own = _MAKING.get()
    if own is not None:
        own.append(path)
    return path


def delete(spark: SparkSession, paths: list[str]) -> None:
    """Deletes tables that an operator wrote."""
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: What a Python worker remembers between tasks, by operator: a call that lets go of it; and the operator it last worked for.
_FORGET: dict[str, Callable[[], None]] = {}
_LAST: list[str] = []


def remembers(operator: str, forget: Callable[[], None]) -> None:
    """Names the call that drops what an operator's tasks remember in a worker."""
    _FORGET[operator] = forget


def works_for(operator: str) -> None:
    """Called by an operator's tasks as they start.

    A worker that turns to another operator lets go of what the former ones
    remembered and hands freed memory back, so a chain of operators needs no
    more of it than the largest of them.
    """
    if _LAST == [operator]:
        return
    for name, forget in _FORGET.items():
        if name != operator:
            forget()
    _LAST[:] = [operator]
    gc.collect()
    with suppress(OSError, AttributeError):  # no glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` below ``sf_dir`` (any path Spark can read)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def shuffles_end(spark: SparkSession) -> Iterator[None]:
    """A query that is run inside deletes its shuffle files as it ends; for queries whose result is stored."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared checkpoint folder and read back.

    Cuts lineage: later jobs read the files, so a lost executor costs a
    re-read and not a recomputation, and the shuffle files that the table was
    made from go as soon as it is stored.
    """
    spark = df.sparkSession
    path = made_path(spark, name)
    with shuffles_end(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def reread(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def roots(df: DataFrame) -> set[str]:
    """Folders that the stored tables in a frame's plan are read from (no file is listed)."""
    found, leaves = set(), df._jdf.queryExecution().analyzed().collectLeaves().iterator()
    while leaves.hasNext():
        leaf = leaves.next()
        if leaf.getClass().getSimpleName() == "LogicalRelation" and leaf.relation().getClass().getSimpleName() == "HadoopFsRelation":
            paths = leaf.relation().location().rootPaths().iterator()
            while paths.hasNext():
                found.add(paths.next().toString())
    return found


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or the first of ``name_``, ``name__``, ... that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shuffle_width(spark: SparkSession) -> int:
    """Partition count for an explicit exchange: the session's own setting."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
