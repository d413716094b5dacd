"""Reference-cardinality profile: the expected values of FIXTURES.md §4."""
import pytest
from pyspark.sql import functions as F

from paths import SF001, SF01
from fundflow.operators import actions as A
from fundflow.operators import graph as G
from fundflow.operators import replay as R
from fundflow.sources import fixtures

EXPECTED = {
    SF001: dict(watch=30, mutual=170, exits=673, actions=843, wallets=151, selfs=5,
                amount="452996.2984", laundered="362505.2465", lo="9.1782", hi="1048.8899",
                times=697, inflight=108),
    SF01: dict(watch=120, mutual=635, exits=759, actions=1394, wallets=666, selfs=5,
               amount="751020.6525", laundered="407028.4190", lo="9.3073", hi="1048.6029",
               times=1205, inflight=179),
}


@pytest.mark.parametrize("sf", [SF001, SF01])
def test_expected_values(spark, sf):
    e = EXPECTED[sf]
    i = fixtures.load(spark, sf, "reference")
    acts = A.actions(i.transfers, i.transactions, i.watchlist, i.vaults).cache()
    assert i.watchlist.count() == e["watch"]
    assert i.vaults.count() == 4
    by = {r.label: r.n for r in acts.groupBy("label").agg(F.count("*").alias("n")).collect()}
    assert by == {"mutual_transfer": e["mutual"], "thorchain_launder": e["exits"]}
    assert acts.count() == e["actions"]
    assert G.distinct_wallets(acts).count() == e["wallets"]
    assert acts.where(F.col("from_address") == F.col("to_address")).count() == e["selfs"]
    r = acts.agg(F.sum("amount").alias("s"), F.min("amount").alias("lo"), F.max("amount").alias("hi"),
                 F.sum(F.when(F.col("label") == "thorchain_launder", F.col("amount"))).alias("l")).first()
    assert f"{r.s:.4f}" == e["amount"] and f"{r.l:.4f}" == e["laundered"]
    assert f"{r.lo:.4f}" == e["lo"] and f"{r.hi:.4f}" == e["hi"]
    tl = R.timeline(acts)
    assert tl.select("ts_ms").distinct().count() == e["times"]
    nodes = G.nodes(acts, i.roles)
    fr = R.frames(tl, nodes)
    assert fr.where(F.col("in_flight") > 0).count() == e["inflight"]
    acts.unpersist()


def test_union_plan_equals_single_scan(spark):
    i = fixtures.load(spark, SF001, "reference")
    a = A.actions(i.transfers, i.transactions, i.watchlist, i.vaults)
    b = A.actions(i.transfers, i.transactions, i.watchlist, i.vaults, plan="union")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
