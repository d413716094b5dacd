"""Hand-written edge rows (FIXTURES.md §5)."""
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fundflow.operators import actions as A
from fundflow.operators import graph as G
from fundflow.operators import replay as R
from fundflow.sources import lists, readers

TR = T.StructType([T.StructField(c, T.StringType()) for c in
                   ["tx_hash", "block_time", "from_address", "to_address", "amount", "amount_usd"]])
TX = T.StructType([T.StructField(c, T.StringType()) for c in ["hash", "block_time", "from", "to"]])
BT = "2024-01-01 00:00:00.000 UTC"


def transfers(spark, rows, **kw):
    return readers.normalize_transfers(spark.createDataFrame(rows, TR), **kw)


def transactions(spark, rows):
    return readers.normalize_transactions(spark.createDataFrame(rows, TX))


def test_mixed_case_addresses_match(spark):
    t = transfers(spark, [("0xAA", BT, "0xAbC", "0xDEF", "1.5", "3")])
    w = lists.watchlist(spark, ["0xabc", "0XDEF"])
    out = A.mutual_transfers(t, w).collect()
    assert len(out) == 1 and out[0].from_address == "0xabc" and out[0].tx_hash == "0xaa"


def test_null_and_nan_amounts_are_skipped_in_sums(spark):
    schema = T.StructType(TR.fields[:4] + [T.StructField("amount", T.DoubleType()),
                                          T.StructField("amount_usd", T.DoubleType())])
    raw = spark.createDataFrame([("h1", BT, "a", "b", float("nan"), 1.0),
                                 ("h2", BT, "a", "b", None, 1.0),
                                 ("h3", BT, "a", "b", 2.5, 1.0)], schema)
    acts = A.with_label(readers.normalize_transfers(raw), "mutual_transfer")
    stats = {r.address: r for r in G.wallet_stats(acts).collect()}
    assert stats["a"].total_sent == 2.5 and stats["b"].total_received == 2.5
    assert stats["a"].tx_count == 3
    edges = G.edges(acts).collect()
    assert sorted(e.amount_eth is None for e in edges) == [False, True, True]


def test_bad_amount_text_raises_or_is_null(spark):
    bad = [("h", BT, "a", "b", "12abc", "1")]
    with pytest.raises(Exception):
        transfers(spark, bad).collect()
    assert transfers(spark, bad, safe_amounts=True).first().amount is None


def test_self_transfer_counts_twice(spark):
    acts = A.with_label(transfers(spark, [("h", BT, "a", "a", "2", "4")]), "mutual_transfer")
    r = G.wallet_stats(acts).first()
    assert (r.address, r.total_sent, r.total_received, r.tx_count) == ("a", 2.0, 2.0, 2)


def test_traces_and_duplicate_transactions_multiply(spark):
    t = transfers(spark, [("h", BT, "a", "v", "1", "1"), ("h", BT, "a", "v", "2", "2"),
                          ("h", BT, "a", "x", "3", "3")])
    x = transactions(spark, [("h", BT, "a", "v"), ("h", BT, "a", "v")])
    v = lists.vaults(spark, ["v"])
    w = lists.watchlist(spark, ["zz"])
    ex = A.exit_transfers(t, x, v)
    assert ex.count() == 4                       # 2 traces x 2 matching transactions
    assert A.actions(t, x, w, v).count() == 4
    assert A.actions(t, x, w, v, plan="union").count() == 4


def test_vault_on_watchlist_is_counted_in_both_labels(spark):
    t = transfers(spark, [("h", BT, "a", "v", "1", "1")])
    x = transactions(spark, [("h", BT, "a", "v")])
    w = lists.watchlist(spark, ["a", "v"])
    v = lists.vaults(spark, ["v"])
    labels = sorted(r.label for r in A.actions(t, x, w, v).collect())
    assert labels == ["mutual_transfer", "thorchain_launder"]
    assert sorted(r.label for r in A.actions(t, x, w, v, plan="union").collect()) == labels


def test_exit_sender_is_not_restricted(spark):
    t = transfers(spark, [("h", BT, "stranger", "v", "1", "1")])
    x = transactions(spark, [("h", BT, "stranger", "v")])
    assert A.actions(t, x, lists.watchlist(spark, ["a"]), lists.vaults(spark, ["v"])).count() == 1


def test_wallet_with_two_roles_takes_first_match(spark):
    roles = lists.roles(spark, attackers=["w"], vaults=["w", "v"], hops=["w", "h"])
    got = {r.address: r.role for r in G.resolve_roles(roles).collect()}
    assert got == {"w": "attacker", "v": "thorchain", "h": "pre-inter"}


def test_equal_timestamps_and_single_event(spark):
    acts = A.with_label(transfers(spark, [("h1", BT, "a", "b", "1", "1"),
                                          ("h2", BT, "b", "c", "2", "2")]), "mutual_transfer")
    tl = R.timeline(acts)
    b = R.time_bounds(tl).first()
    assert b.span_ms == 1 and b.start_ms == b.end_ms
    seq = sorted((r.hash, r.idx) for r in R.global_sequence(tl).collect())
    assert seq == [("h1", 0), ("h2", 1)]
    nodes = G.nodes(acts, lists.roles(spark, attackers=["a"]))
    fr = R.frames(tl, nodes).orderBy("frame").collect()
    assert fr[0].events == 2 and fr[0].wallets == 3 and fr[-1].in_flight == 2


def test_unreadable_time_stays_out_of_timeline(spark):
    acts = A.with_label(transfers(spark, [("h1", "not a time", "a", "b", "1", "1"),
                                          ("h2", BT, "a", "b", "1", "1")]), "mutual_transfer")
    assert R.timeline(acts).count() == 1
    assert R.untimed_count(acts).first().untimed == 1
    assert G.edges(acts).count() == 2


def test_empty_inputs_give_empty_typed_outputs(spark):
    t = transfers(spark, [])
    x = transactions(spark, [])
    acts = A.actions(t, x, lists.watchlist(spark, []), lists.vaults(spark, []))
    assert acts.count() == 0 and len(acts.columns) == 7
    nodes = G.nodes(acts, lists.roles(spark))
    tl = R.timeline(acts)
    assert nodes.count() == 0 and tl.count() == 0
    assert R.flow_totals(tl, nodes).first().transfers == 0


def test_attackers_listed_in_snapshot_with_zeros(spark):
    acts = A.with_label(transfers(spark, [("h1", BT, "a", "b", "1", "1"),
                                          ("h2", "2024-01-02 00:00:00.000 UTC", "b", "z", "1", "1")]),
                        "mutual_transfer")
    nodes = G.nodes(acts, lists.roles(spark, attackers=["z"]))
    snap = {r.address: r for r in R.snapshot(R.timeline(acts), nodes, position=0).collect()}
    assert snap["z"].txns == 0 and snap["a"].txns == 1 and set(snap) == {"a", "b", "z"}


def test_activation_modes(spark):
    day = "2024-01-03 00:00:00.000 UTC"
    acts = A.with_label(transfers(spark, [("h1", BT, "a", "b", "1", "1"),
                                          ("h2", day, "c", "d", "1", "1")]), "mutual_transfer")
    tl = R.timeline(acts)
    nodes = G.nodes(acts, lists.roles(spark, attackers=["c"]))
    play = {r.address: r.activation_ms for r in R.activation(tl, nodes, "play").collect()}
    scrub = {r.address: r.activation_ms for r in R.activation(tl, nodes, "scrub").collect()}
    t0 = 1704067200000
    assert play["a"] == t0 and play["b"] == t0 + 36_000_000
    assert play["d"] is None                      # arrives after the clock stops
    assert play["c"] == t0 and scrub["c"] == t0   # attacker: visible from the start
    assert scrub["d"] == t0 + 2 * 86_400_000


def test_scalar_texts(spark):
    from fundflow import functions as X
    df = spark.createDataFrame([("0x1234567890abcdef", "thorchain", 2.675, 1234567.5, 1714000000000)],
                               "a string, role string, x double, big double, ms long")
    r = df.select(X.short_address("a").alias("s"), X.address_tag("a").alias("t"),
                  X.role_title("role").alias("title"), X.role_legend("role").alias("legend"),
                  X.amount_text(F.lit("2.675").cast("decimal(38,18)"), 2).alias("txt"),
                  X.whole_text("big").alias("w"), X.time_text("ms").alias("tt"),
                  X.edge_weight(F.lit(2000.0)).alias("wt"), X.pair_key(F.lit("b"), F.lit("a")).alias("pk"),
                  X.pair_curvature(F.lit(20)).alias("pc"), X.global_curvature(F.lit(20)).alias("gc")).first()
    assert r.s == "0x1234.....cdef" and r.t == "0x123456…"
    assert r.title == "ATTACKER EXIT VIA THORCHAIN BRIDGE" and r.legend == "BRIDGE EXIT"
    assert r.txt == "2.68 ETH" and r.w == "1,234,568" and r.tt == "Apr 24 23:06"
    assert r.wt == 3.0 and r.pk == "a:b" and r.pc == 30 + 240 % 180 and r.gc == 30 + 340 % 150


def test_membership_lowers_a_raw_list(spark):
    from fundflow.operators.membership import Membership
    t = transfers(spark, [("h", BT, "0xab", "0xcd", "1", "1")])
    raw = spark.createDataFrame([("0xAB",), ("0xCD",)], "address string")
    for mode in ("inlist", "broadcast", "shuffle"):
        assert A.mutual_transfers(t, Membership(raw, mode=mode)).count() == 1


def test_time_text_forms(spark):
    from fundflow import functions as X
    rows = [("2024-01-01 10:00:00.000 UTC",), ("2024-01-01 10:00:00 UTC",), ("2024-01-01T10:00:00Z",),
            ("2024-01-01T11:00:00.000+01:00",), ("garbage",)]
    got = [r.ms for r in spark.createDataFrame(rows, "t string")
           .select(X.parse_block_time("t", T.StringType()).alias("ms")).collect()]
    assert got == [1704103200000] * 4 + [None]


def test_empty_graph_summary_counts_zero(spark):
    t = transfers(spark, [])
    acts = A.actions(t, transactions(spark, []), lists.watchlist(spark, []), lists.vaults(spark, []))
    nodes = G.nodes(acts, lists.roles(spark))
    r = G.graph_summary(nodes, G.edges(acts)).first()
    assert (r.wallets, r.attacker_wallets, r.inter_wallets, r.edges) == (0, 0, 0, 0)


def test_list_from_text_file(spark):
    from fundflow.session import scratch_path
    path = scratch_path(spark, "t-list").removeprefix("file:") + ".txt"
    with open(path, "w") as f:
        f.write("address\n0xAbC\n 0xdef \n\n0xabc\n")
    got = sorted(r.address for r in lists.watchlist(spark, path).collect())
    assert got == ["0xabc", "0xdef"]


def test_typed_timestamp_block_time(spark):
    import datetime as dt
    schema = T.StructType(TR.fields[:1] + [T.StructField("block_time", T.TimestampNTZType())] + TR.fields[2:])
    raw = spark.createDataFrame([("h", dt.datetime(2024, 1, 1, 10, 0, 0, 250000), "a", "b", "1", "1")], schema)
    acts = A.with_label(readers.normalize_transfers(raw), "mutual_transfer")
    r = acts.first()
    assert r.block_time == "2024-01-01 10:00:00.250 UTC"
    assert R.timeline(acts).first().ts_ms == 1704103200250
