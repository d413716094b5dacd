"""Plan checks: broadcast semi-join, no cartesian products, pruned scans."""
import pytest

import __spark_entry__ as entry
from paths import SF001
from fundflow.operators import actions as A
from fundflow.operators.membership import Membership
from fundflow.plans import catalog, jobs
from fundflow.plans.catalog import Stages
from fundflow.session import scratch_path
from fundflow.sources import readers


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_watch_semi_is_broadcast(spark):
    p = Stages(spark, SF001)
    df = A.mutual_transfers(p.inputs.transfers, Membership(p.inputs.watchlist, mode="broadcast"))
    s = plan(df)
    assert "BroadcastHashJoin" in s and "LeftSemi" in s


def test_small_list_is_in_set_filter(spark):
    p = Stages(spark, SF001)
    m = Membership(p.inputs.vaults)
    assert m.mode == "inlist"
    s = plan(A.mutual_transfers(p.inputs.transfers, m))
    assert "LeftSemi" not in s


@pytest.mark.parametrize("key", sorted(catalog.queries()))
def test_no_cartesian_product(spark, key):
    s = plan(entry.queries()[key](spark, SF001))
    assert "CartesianProduct" not in s and "BroadcastNestedLoopJoin" not in s


def test_transaction_scan_is_pruned(spark):
    p = Stages(spark, SF001)
    path = scratch_path(spark, "t-tx")
    p.inputs.transactions.write.parquet(path)
    tx = readers.scan_transactions(spark, path)
    t = p.inputs.transfers
    s = plan(A.exit_transfers(t, tx, p.vault))
    scans = [line for line in s.splitlines() if "FileScan parquet" in line and "[hash#" in line]
    assert scans and all("ReadSchema: struct<hash:string,from:string,to:string>" in ln for ln in scans)


def _exchanges(node, out):
    """(partitioning, records written) of every shuffle in an executed plan."""
    name = node.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        return _exchanges(node.executedPlan(), out)
    if name.endswith("QueryStageExec"):
        return _exchanges(node.plan(), out)
    if name == "ReusedExchangeExec":
        return _exchanges(node.child(), out)
    if name == "ShuffleExchangeExec":
        m = node.metrics()
        out.append((node.outputPartitioning().toString(), m.apply("shuffleRecordsWritten").value()))
    children = node.children().iterator()
    while children.hasNext():
        _exchanges(children.next(), out)
    return out


@pytest.mark.parametrize("fn", ["running_totals", "pair_sequence"])
def test_ranged_strategy_sends_no_event_rows_through_one_task(spark, fn):
    """Measured: single-partition shuffles carry only the offsets table."""
    from fundflow.operators import replay as R
    from fundflow.session import default_parallelism
    p = Stages(spark, SF001)
    events = p.timeline.distinct().count()
    df = getattr(R, fn)(p.timeline, strategy="ranged")
    df.collect()
    shuffles = _exchanges(df._jdf.queryExecution().executedPlan(), [])
    bound = 2 * default_parallelism(spark) + 1
    single = [rec for part, rec in shuffles if part.startswith("SinglePartition")]
    assert all(rec <= bound for rec in single), shuffles
    assert any(part.startswith("hashpartitioning(_b") and rec == events for part, rec in shuffles), shuffles


@pytest.mark.parametrize("fn", ["running_totals", "running_wallet_totals"])
def test_ranged_strategy_scans_once_and_freezes_nothing(spark, fn, monkeypatch):
    """One count, no checkpoint, no range exchange, and both branches read one exchange of the source."""
    from fundflow.operators import replay as R
    path = scratch_path(spark, "t-tl")
    Stages(spark, SF001).timeline.write.parquet(path)
    tl = spark.read.parquet(path)
    DataFrame, counts = type(tl), []
    count = DataFrame.count
    monkeypatch.setattr(DataFrame, "count", lambda df: counts.append(1) or count(df))
    monkeypatch.setattr(DataFrame, "checkpoint", lambda *a, **k: pytest.fail("checkpoint"))
    monkeypatch.setattr(DataFrame, "localCheckpoint", lambda *a, **k: pytest.fail("localCheckpoint"))
    df = getattr(R, fn)(tl, strategy="ranged")
    df.collect()
    s = plan(df).split("== Initial Plan ==")[0]
    assert len(counts) == 1 and s.count("Scan parquet") == 1 and s.count("ReusedExchange") == 1, s
    assert "rangepartitioning" not in s
    out = sorted(map(str, df.collect()))
    assert out == sorted(map(str, getattr(R, fn)(tl, strategy="window").collect()))


def test_buckets_are_even_and_cut_a_hot_group(spark):
    from fundflow.operators import sequence as Q
    from pyspark.sql import functions as F
    df = spark.range(20_000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 500)).alias("k"),
                                    F.pmod(F.xxhash64("id"), F.lit(5000)).alias("t"), F.lit(None).cast("string").alias("x"))
    names = ["k", "t", "x"]
    cuts, literal = Q.splitters(df, names, 10, 20_000)
    sizes = [r["count"] for r in df.select(Q.bucket_of(Q.composite_key(names), cuts, literal).alias("b")).groupBy("b").count().collect()]
    assert len(sizes) == 10 and max(sizes) < 3 * 20_000 / 10
    # a bucket is the number of splitters that aren't above the key, as the sort order has it
    rows = (df.distinct().select(*names, Q.bucket_of(Q.composite_key(names), cuts, literal).alias("b"))
            .orderBy(*[F.col(c).asc_nulls_last() for c in names]).collect())
    assert [r.b for r in rows] == sorted(r.b for r in rows)


def test_results_hold_without_automatic_broadcast(spark):
    """The shuffled (sort-merge) join path gives the same rows as the oracle."""
    from oracle_compare import compare, duck
    con = duck(SF001)
    keys = ["J1_exit_transfers", "U1_actions", "T4_activation_play", "W6_lane_index"]
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold",
                                         "spark.sql.adaptive.autoBroadcastJoinThreshold")}
    try:
        for k in old:
            spark.conf.set(k, "-1")
        for key in keys:
            df = entry.queries()[key](spark, SF001)
            ok, msg = compare(df, con, entry.oracle_sql()[key])
            assert ok, (key, msg)
        assert "SortMergeJoin" in plan(entry.queries()["J1_exit_transfers"](spark, SF001))
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def test_frames_gather_only_grid_rows(spark):
    from fundflow.operators import replay as R
    p = Stages(spark, SF001)
    df = R.frames(p.timeline, p.nodes)
    df.collect()
    shuffles = _exchanges(df._jdf.queryExecution().executedPlan(), [])
    assert all(rec <= 1001 for part, rec in shuffles if part.startswith("SinglePartition")), shuffles


def test_extraction_does_not_shuffle_transfers(spark):
    p = Stages(spark, SF001)
    i = p.inputs
    path = scratch_path(spark, "t-x")
    i.transfers.write.parquet(path + "/t")
    i.transactions.write.parquet(path + "/x")
    transfers = readers.scan_transfers(spark, path + "/t")
    transactions = readers.scan_transactions(spark, path + "/x")
    n = transfers.count()
    for mode in ("inlist", "broadcast"):
        df = A.actions(transfers, transactions, Membership(i.watchlist, mode=mode, inlist_max=300), p.vault)
        df.collect()
        shuffles = _exchanges(df._jdf.queryExecution().executedPlan(), [])
        assert all(rec < n for _, rec in shuffles), (mode, shuffles)


def addresses(spark, n):
    from fundflow.sources.fixtures import wallet_address
    from pyspark.sql import functions as F
    return spark.range(n).select(wallet_address(F.col("id")).alias("address"))


def test_forced_in_list_never_cuts_a_list(spark):
    """300 entries: a forced in-list raises, all other modes agree."""
    t = Stages(spark, SF001).inputs.transfers
    w = addresses(spark, 300)
    with pytest.raises(ValueError):
        Membership(w, mode="inlist")
    counts = {m: A.mutual_transfers(t, Membership(w, mode=m)).count() for m in ("auto", "broadcast", "shuffle")}
    counts["long in-list"] = A.mutual_transfers(t, Membership(w, mode="inlist", inlist_max=300)).count()
    assert len(set(counts.values())) == 1 and counts["auto"] > 0, counts


def test_job_path_pushes_the_lists_to_both_scans(spark, tmp_path):
    p = Stages(spark, SF001)
    stored = p.stored  # mixed-case keys
    transfers, transactions = jobs.lowered_inputs(spark, stored.transfers, stored.transactions, str(tmp_path))
    more = spark.createDataFrame([("0xf1",), ("0xf2",)], "address string")
    w, v = Membership(addresses(spark, 30)), Membership(p.inputs.vaults.unionByName(more))
    df = A.actions(transfers, transactions, w, v)
    old = spark.conf.get("spark.sql.maxMetadataStringLength")
    spark.conf.set("spark.sql.maxMetadataStringLength", "100000")
    scans = [line for line in plan(df).splitlines() if "FileScan parquet" in line]
    spark.conf.set("spark.sql.maxMetadataStringLength", old)
    assert len(scans) == 3 and all("In(" in s.split("PushedFilters:")[1] for s in scans), scans
    assert df.count() == A.actions(p.inputs.transfers, p.inputs.transactions, w, v).count() > 0


def test_shuffle_mode_drops_rows_before_the_exit_join(spark):
    p = Stages(spark, SF001)
    v = Membership(p.inputs.vaults, mode="shuffle")
    df = A.exit_transfers(p.inputs.transfers, p.inputs.transactions, v)
    optimized = df._jdf.queryExecution().optimizedPlan().toString()
    inner = optimized.index("Join Inner, ((tx_hash") if "Join Inner, ((tx_hash" in optimized else 0
    assert "LeftSemi" in optimized[inner:]


def test_list_tests_lie_below_the_order_join(spark):
    """Rows that no list holds are dropped before the join's exchange, on both sides."""
    i = Stages(spark, SF001).inputs
    df = A.mutual_transfers(i.transfers, Membership(i.watchlist, mode="broadcast"))
    df.collect()
    text = df._jdf.queryExecution().optimizedPlan().toString()
    assert text.index("Join Inner") < text.index("Join LeftSemi") and text.count("Join LeftSemi") == 2
    sent = sorted(rec for part, rec in _exchanges(df._jdf.queryExecution().executedPlan(), []) if "orderkey" in part)
    lines, orders = (spark.read.parquet(f"{SF001}/{t}.parquet").count() for t in ("lineitem", "orders"))
    assert len(sent) == 2 and sent[0] < orders / 2 and sent[1] < lines / 2, sent


@pytest.mark.parametrize("mode", ["broadcast", "shuffle"])
def test_order_join_carries_no_texts(spark, mode):
    """Keys and numbers are exchanged for the order join; texts are made above it, list tests lie below it."""
    i = Stages(spark, SF001).inputs
    m = Membership(i.watchlist, mode=mode)
    df = A.mutual_transfers(i.transfers, m)
    text = df._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Join LeftSemi") == (2 if mode == "broadcast" else 4)
    below = text[text.index("Join Inner"):]
    assert below.count("Join LeftSemi") == 2
    carried = [line for line in plan(df).split("== Initial Plan ==")[-1].splitlines() if "Exchange hashpartitioning" in line and "orderkey" in line]
    assert len(carried) == 2
    sides = below.splitlines()
    made = [s for s in sides if "Project [" in s and (" AS tx_hash" in s or " AS to_address" in s or " AS from_address" in s)]
    assert not made, made
    want = A.mutual_transfers(i.transfers, Membership(i.watchlist, mode="inlist", inlist_max=100_000))
    assert sorted(map(str, df.collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize("key", ["U1_actions", "F1_both_endpoints_watched", "P7_timeline_projection"])
def test_order_joins_keep_their_plan_at_any_size(spark, key):
    """Neither side of a join by order key is broadcast, however small the tables."""
    for line in plan(entry.queries()[key](spark, SF001)).splitlines():
        assert not ("BroadcastHashJoin" in line and "orderkey" in line), line


def test_first_sightings_scan_their_source_once(spark):
    from fundflow.operators import replay as R
    path = scratch_path(spark, "t-first")
    Stages(spark, SF001).timeline.write.parquet(path)
    df = R._first_seen(spark.read.parquet(path))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for wallets that are too many to broadcast
    df.collect()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    s = plan(df).split("== Initial Plan ==")[0]
    assert s.count("Scan parquet") == 1 and s.count("ReusedExchange") == 1, s


def test_edge_roles_need_no_wallet_totals(spark):
    s = plan(catalog.queries()["J4_edge_with_roles"](spark, SF001))
    assert "sum(" not in s and "count(1)" not in s


@pytest.mark.parametrize("key", ["W1_pair_sequence", "W2_global_sequence", "W3_running_totals", "W4_running_wallet_totals",
                                 "W5_first_appearance", "W6_lane_index", "J2_watch_semi", "J4_edge_with_roles", "T1_snapshot"])
def test_size_checks_gather_no_rows(spark, key, monkeypatch):
    """Default path: every size check sends at most a row per task to one task."""
    from fundflow import config as C
    from fundflow.operators import sizing
    from pyspark.sql import DataFrame
    seen = []
    count = DataFrame.count

    def checked(df):
        one = df.groupBy().count()
        n = one.collect()[0][0]
        seen.extend(r for part, r in _exchanges(one._jdf.queryExecution().executedPlan(), []) if part.startswith("SinglePartition"))
        return n

    monkeypatch.setattr(DataFrame, "count", checked)
    assert sizing.rows_at_most and C.BROADCAST_MAX_ROWS
    catalog.queries()[key](spark, SF001)
    monkeypatch.setattr(DataFrame, "count", count)
    assert all(r <= 64 for r in seen), seen


def test_building_a_query_writes_nothing(spark, monkeypatch):
    from pyspark.sql import DataFrame
    calls = []
    monkeypatch.setattr(DataFrame, "checkpoint", lambda self, *a, **k: calls.append("checkpoint") or self)
    monkeypatch.setattr("fundflow.plans.catalog.scratch_path", lambda *a: calls.append("path") or "unused")
    for key in ("U1_actions", "A4_wallet_stats", "W1_pair_sequence", "T3_frames", "J4_edge_with_roles"):
        catalog.queries()[key](spark, SF001)
    assert not calls


def test_cluster_needs_a_shared_folder():
    from types import SimpleNamespace as N
    from fundflow.session import checkpoint_dir, is_local
    assert is_local("local") and is_local("local[*]") and not is_local("yarn") and not is_local("local-cluster[1,1,512]")
    sc = N(getCheckpointDir=lambda: None, master="yarn", getConf=lambda: N(get=lambda *a: None))
    with pytest.raises(ValueError):
        checkpoint_dir(N(sparkContext=sc, conf=N(get=lambda *a: None)))
