"""Temp views for SQL users (no dialect of our own: Spark SQL over the stages).

    register_views(spark, actions=acts, nodes=nodes, edges=edges, timeline=tl)
    spark.sql("SELECT role, count(*) FROM nodes GROUP BY role")

Each keyword becomes a session temp view of that name; ``frames`` (the
replay grid) is registered too when a timeline and nodes are given.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import replay as R


def register_views(spark: SparkSession, with_frames: bool = True, **stages: DataFrame) -> list[str]:
    names = []
    for name, df in stages.items():
        if df is None:
            continue
        df.createOrReplaceTempView(name)
        names.append(name)
    if with_frames and stages.get("timeline") is not None and stages.get("nodes") is not None:
        R.frames(stages["timeline"], stages["nodes"]).createOrReplaceTempView("frames")
        names.append("frames")
    return names
