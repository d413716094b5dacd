"""Long lists drop non-members before any exchange; a broadcast is checked in every mode."""
import pytest
from pyspark.sql import functions as F

from fundflow import config as C
from fundflow.operators import actions as A
from fundflow.operators import bloom, sizing
from fundflow.operators.membership import Membership
from fundflow.plans.catalog import Stages
from fundflow.session import scratch_path
from fundflow.sources import readers
from paths import SF001
from test_plans import _exchanges, addresses, plan


def test_filter_keeps_every_member_and_few_others(spark):
    members = spark.range(0, 30_000, 3).select(F.concat(F.lit("0x"), F.hex("id")).alias("address"))
    rows = spark.range(30_000).select("id", F.when(F.col("id") != 1, F.concat(F.lit("0x"), F.hex("id"))).alias("a"))
    f = bloom.Bloom(members, "address", 10_000)
    kept = {r.id for r in f.keep(rows, "a").collect()}
    assert kept >= set(range(0, 30_000, 3)) and len(kept) < 10_000 + 0.05 * 20_000
    assert bloom.Bloom(members.limit(0), "address", 0).keep(rows, "a").count() == 0


def test_filter_size_is_bounded():
    assert bloom.words_for(0) == 1 and bloom.words_for(1000) == 256
    assert bloom.words_for(8_000_000) == bloom.MOST_WORDS and bloom.words_for(100_000_000) == 0


@pytest.fixture
def no_automatic_broadcast(spark):
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    old = {k: spark.conf.get(k) for k in keys}
    for k in keys:
        spark.conf.set(k, "-1")
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_long_list_drops_non_members_before_any_exchange(spark, monkeypatch, no_automatic_broadcast):
    monkeypatch.setattr(C, "BROADCAST_MAX_BYTES", 100)
    i = Stages(spark, SF001).inputs
    path = scratch_path(spark, "t-bloom")
    i.transfers.write.parquet(path)
    transfers = readers.scan_transfers(spark, path)
    watch = addresses(spark, 150)
    m = Membership(watch)
    assert m.mode == "shuffle"
    df = A.mutual_transfers(transfers, m)
    rows = df.collect()
    n = transfers.count()
    assert sorted(map(str, rows)) == sorted(map(str, A.mutual_transfers(
        transfers, Membership(watch, mode="inlist", inlist_max=300)).collect())) and rows
    carried = [rec for part, rec in _exchanges(df._jdf.queryExecution().executedPlan(), []) if "from_address" in part or "to_address" in part]
    assert carried and all(rec <= len(rows) + 0.05 * n < 0.6 * n for rec in carried), (carried, len(rows), n)
    optimized = df._jdf.queryExecution().optimizedPlan().toString()
    assert optimized.count("_f_word") >= 2
    # exits are filtered the same way
    v = Membership(i.vaults.unionByName(addresses(spark, 200)), mode="shuffle")
    exits = A.exit_transfers(transfers, i.transactions, v)
    assert exits.count() == A.exit_transfers(transfers, i.transactions, Membership(i.vaults.unionByName(addresses(spark, 200)))).count()
    assert "_f_word" in exits._jdf.queryExecution().optimizedPlan().toString()


def test_forced_broadcast_is_checked(spark, monkeypatch):
    watch = addresses(spark, 200)
    assert Membership(watch, mode="broadcast").mode == "broadcast"
    with pytest.raises(ValueError, match="too large"):
        Membership(watch, mode="broadcast", broadcast_max=199)
    monkeypatch.setattr(C, "BROADCAST_MAX_BYTES", 200 * 40)
    with pytest.raises(ValueError, match="too large"):
        Membership(watch, mode="broadcast")
    assert Membership(watch, inlist_max=10).mode == "shuffle"
    with pytest.raises(ValueError):
        Membership(watch, mode="none")


def test_sizes_are_bytes(spark):
    df = spark.createDataFrame([("abc", 1), (None, 2), ("é", None)], "s string, x int")
    assert sizing.size_of(df) == (3, 3 * 48 + 3 + 2)
    assert sizing.size_of(df.limit(0)) == (0, 0) and sizing.broadcastable(df)
    side = sizing.checked_broadcast(df)
    assert "BroadcastHashJoin" in plan(df.join(side, "x"))
