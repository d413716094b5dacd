"""A write that dies leaves the old version; readers see whole versions only."""
import os

import pytest

from fundflow import schema as S
from fundflow.plans.catalog import Stages
from fundflow.session import scratch_path
from fundflow.sources import readers, sinks, versions
from paths import SF001


def local(path):
    return path.removeprefix("file:")


def test_killed_write_leaves_the_old_result(spark):
    path = scratch_path(spark, "t-versions")
    versions.write_version(spark, path, lambda f: spark.range(5).write.parquet(f), facts={"note": "first"})

    def dies(folder):
        spark.range(9).write.parquet(folder)
        raise RuntimeError("killed")

    with pytest.raises(RuntimeError):
        versions.write_version(spark, path, dies)
    assert spark.read.parquet(versions.current(spark, path)).count() == 5
    assert versions.facts(spark, path)["note"] == "first"
    # a task that fails half-way
    with pytest.raises(Exception):
        versions.write_version(spark, path, lambda f: spark.range(100).selectExpr("if(id = 77, raise_error('x'), id) as id").write.parquet(f))
    assert spark.read.parquet(versions.current(spark, path)).count() == 5
    # a writer that died between creating and filling its manifest
    open(f"{local(path)}/manifests/0000000002.json", "w").close()
    assert spark.read.parquet(versions.current(spark, path)).count() == 5
    versions.write_version(spark, path, lambda f: spark.range(3).write.parquet(f))
    assert spark.read.parquet(versions.current(spark, path)).count() == 3
    assert versions.current(spark, path, 1) and not versions.current(spark, path, 2)


def test_old_versions_go_and_running_readers_keep_theirs(spark):
    path = scratch_path(spark, "t-versions")
    for n in (1, 2, 3, 4):
        versions.write_version(spark, path, lambda f, n=n: spark.range(n).write.parquet(f))
        if n == 3:
            under_way = spark.read.parquet(versions.current(spark, path))
    assert under_way.count() == 3 and len(os.listdir(f"{local(path)}/data")) == 2
    assert spark.read.parquet(versions.current(spark, path)).count() == 4
    assert versions.current(spark, scratch_path(spark, "t-none")) is None
    with pytest.raises(ValueError):
        versions.write_version(spark, path, lambda f: None, keep=0)


def test_two_writers_get_two_numbers(spark):
    path = scratch_path(spark, "t-versions")

    def other_first(folder):
        spark.range(7).write.parquet(folder)
        versions.write_version(spark, path, lambda f: spark.range(1).write.parquet(f))

    versions.write_version(spark, path, other_first)
    assert spark.read.parquet(versions.current(spark, path)).count() == 7
    assert spark.read.parquet(versions.current(spark, path, 1)).count() == 1


def test_actions_and_graph_are_versions(spark, monkeypatch):
    p = Stages(spark, SF001)
    path = scratch_path(spark, "t-actions")
    sinks.write_actions(p.actions, path)
    n = readers.scan_actions(spark, path).count()
    with pytest.raises(Exception):
        sinks.write_actions(p.actions.selectExpr("raise_error('killed') as tx_hash", *S.ACTION_COLUMNS[1:]), path)
    assert readers.scan_actions(spark, path).count() == n > 0
    sinks.write_actions(p.actions.limit(3), path)
    assert readers.scan_actions(spark, path).count() == 3
    # a plain Parquet folder is read too
    p.actions.write.parquet(path + "-plain")
    assert readers.scan_actions(spark, path + "-plain").count() == n

    graph = scratch_path(spark, "t-graph")
    sinks.write_graph(p.nodes, p.edges, graph)
    nodes, edges = readers.read_graph(spark, graph)
    before = nodes.count(), edges.count()
    with pytest.raises(Exception):  # the nodes are complete, the edges die: neither is seen
        sinks.write_graph(p.nodes.limit(1), p.edges.selectExpr("raise_error('killed') as tx_hash"), graph)
    nodes, edges = readers.read_graph(spark, graph)
    assert (nodes.count(), edges.count()) == before


def test_absent_graph_parts_are_empty(spark):
    path = scratch_path(spark, "t-graph")
    nodes, edges = readers.read_graph(spark, path)
    assert nodes.count() == edges.count() == 0 and nodes.schema == S.NODES and edges.schema == S.EDGES
    Stages(spark, SF001).edges.write.json(f"{path}/edges")
    nodes, edges = readers.read_graph(spark, path)
    assert nodes.count() == 0 < edges.count()
    assert readers.scan_actions(spark, path + "-none").count() == 0
