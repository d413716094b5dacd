"""Bucketed joins need no exchange; look-ups skip row groups."""
from fundflow import schema as S
from fundflow.operators import actions as A
from fundflow.operators import graph as G
from fundflow.operators import replay as R
from fundflow.plans.catalog import Stages
from fundflow.session import scratch_path
from fundflow.sources import layouts
from paths import SF001
from test_plans import plan


def test_bucketed_exit_join_has_no_exchange(spark):
    p = Stages(spark, SF001)
    path = scratch_path(spark, "t-buckets")
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")}
    try:
        for k in old:
            spark.conf.set(k, "-1")  # as with sides too large to broadcast
        x = layouts.write_bucketed(p.inputs.transfers, f"{path}/t", layouts.TRANSFER_KEYS, 8)
        y = layouts.write_bucketed(p.inputs.transactions, f"{path}/x", layouts.TRANSACTION_KEYS, 8)
        df = A.exit_transfers(x, y, p.vault)
        s = plan(df)
        assert "SortMergeJoin" in s and "Exchange" not in s, s
        want = A.exit_transfers(p.inputs.transfers, p.inputs.transactions, p.vault)
        assert "Exchange" in plan(want)
        assert sorted(map(str, df.collect())) == sorted(map(str, want.collect()))
        # The exit branch keeps its join free of an exchange
        u = plan(A.actions(x, y, p.watch, p.vault))
        assert "Exchange hashpartitioning(tx_hash" not in u and "Exchange hashpartitioning(hash" not in u
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def scanned(df):
    """Rows that the scans of a plan gave: those of row groups that weren't skipped."""
    df.collect()
    node, rows = df._jdf.queryExecution().executedPlan(), []

    def walk(n):
        name = n.getClass().getSimpleName()
        if name == "FileSourceScanExec":
            rows.append(n.metrics().apply("numOutputRows").value())
        if name == "AdaptiveSparkPlanExec":
            return walk(n.executedPlan())
        kids = n.children().iterator()
        while kids.hasNext():
            walk(kids.next())
    walk(node)
    return sum(rows)


def test_look_ups_skip_row_groups(spark):
    p = Stages(spark, SF001)
    path = scratch_path(spark, "t-lookup")
    layouts.write_lookup(p.timeline, f"{path}/tl", cluster=S.EVENT_ORDER, bloom=["hash", "from", "to"], row_group_bytes=4096)
    layouts.write_lookup(p.nodes, f"{path}/nodes", cluster=["id"], row_group_bytes=4096)
    tl, nodes = spark.read.parquet(f"{path}/tl"), spark.read.parquet(f"{path}/nodes")
    n, m = tl.count(), nodes.count()
    for r in tl.select("hash").distinct().orderBy("hash").limit(3).collect():
        df = R.transfer_detail(tl, r.hash)
        want = R.transfer_detail(p.timeline, r.hash)
        assert sorted(map(str, df.collect())) == sorted(map(str, want.collect()))
        assert 0 < scanned(df) < n / 2, (scanned(df), n)
    assert scanned(R.transfer_detail(tl, "0xnone")) == 0
    wallet = nodes.select("id").orderBy("id").first().id
    one = G.wallet_detail(nodes, wallet)
    assert one.count() == 1 and scanned(one) < m
    assert n > 300 and m > 100
