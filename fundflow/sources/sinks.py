"""Sinks: S6 write_actions, S8 write_graph, S10 preview.

Writes are distributed (one file per task) and versioned: a write becomes
visible by its manifest (``sources.versions``), so one that dies leaves the
former result readable.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from .. import schema as S
from .versions import write_version


def write_actions(actions: DataFrame, path: str, keep: int = 2) -> None:
    """The action table as Parquet, a new version below ``path``."""
    rows = actions.select(*S.ACTION_COLUMNS)
    write_version(actions.sparkSession, path, lambda folder: rows.write.parquet(folder), keep)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str, keep: int = 2) -> None:
    """The graph as two JSON-lines datasets ``nodes`` and ``edges``, one version for both.

    Each task writes its own part files.  Nulls are written as JSON null
    (never dropped, never NaN).  A single ``{"nodes": [...], "edges": [...]}``
    document is not offered: it would pass the whole graph through one task.
    """
    opts = {"ignoreNullFields": "false"}

    def write(folder: str) -> None:
        nodes.write.options(**opts).json(f"{folder}/nodes")
        edges.write.options(**opts).json(f"{folder}/edges")

    write_version(nodes.sparkSession, path, write, keep)


def preview(df: DataFrame, n: int = 5) -> DataFrame:
    """The first ``n`` rows (a limit is the feature here)."""
    return df.limit(n)
