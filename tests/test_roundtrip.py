"""Round trips: S6 -> S7 and S8 -> S9 (the graph's two datasets)."""
from paths import SF001
from fundflow.plans.catalog import Stages
from fundflow.session import scratch_path
from fundflow.sources import readers, sinks, versions


def _same(a, b):
    assert a.count() == b.count()
    assert a.exceptAll(b).count() == 0


def test_actions_roundtrip(spark):
    p = Stages(spark, SF001)
    path = scratch_path(spark, "t-actions")
    sinks.write_actions(p.actions, path)
    _same(readers.scan_actions(spark, path), p.actions)


def test_graph_roundtrip(spark):
    p = Stages(spark, SF001)
    path = scratch_path(spark, "t-graph")
    sinks.write_graph(p.nodes, p.edges, path)
    nodes, edges = readers.read_graph(spark, path)
    _same(nodes.select(*p.nodes.columns), p.nodes)
    _same(edges.select(*p.edges.columns), p.edges)


def test_null_amounts_are_written_as_json_null(spark):
    import glob
    import json
    from pyspark.sql import functions as F
    p = Stages(spark, SF001)
    path = scratch_path(spark, "t-null")
    edges = p.edges.limit(3).withColumn("amount_eth", F.lit(None).cast("double"))
    sinks.write_graph(p.nodes.limit(1), edges, path)
    files = glob.glob(f"{versions.current(spark, path).removeprefix('file:')}/edges/part-*.json")
    rows = [json.loads(line) for f in files for line in open(f)]
    assert rows and all("amount_eth" in r and r["amount_eth"] is None for r in rows)
