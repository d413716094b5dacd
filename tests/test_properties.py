"""Property tests on random small inputs (hypothesis).

* the single-scan extraction equals the two-branch union, for any lists,
  duplicate traces, duplicate transactions, overlapping lists and mixed case;
* the ranged running-aggregate strategy equals the plain window.
"""
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fundflow.operators import actions as A
from fundflow.operators.membership import Membership
from fundflow.operators.sequence import running
from fundflow.sources import lists, readers

ADDR = st.sampled_from(["0xa", "0xB", "0xc", "0xD", "0xe", "0xf"])
HASH = st.sampled_from(["h1", "h2", "H3", "h4"])
TR = T.StructType([T.StructField(c, T.StringType()) for c in
                   ["tx_hash", "block_time", "from_address", "to_address", "amount", "amount_usd"]])
TX = T.StructType([T.StructField(c, T.StringType()) for c in ["hash", "block_time", "from", "to"]])
BT = "2024-01-01 00:00:00.000 UTC"
SETTINGS = settings(max_examples=8, deadline=None,
                    suppress_health_check=[HealthCheck.function_scoped_fixture])


@SETTINGS
@given(transfers=st.lists(st.tuples(HASH, ADDR, ADDR, st.integers(1, 5)), max_size=12),
       calls=st.lists(st.tuples(HASH, ADDR, ADDR), max_size=8),
       watch=st.lists(ADDR, max_size=4), vault=st.lists(ADDR, max_size=3),
       mode=st.sampled_from(["inlist", "broadcast", "shuffle"]))
def test_single_scan_equals_union(spark, transfers, calls, watch, vault, mode):
    t = readers.normalize_transfers(spark.createDataFrame(
        [(h, BT, f, to, str(a), str(a)) for h, f, to, a in transfers], TR))
    x = readers.normalize_transactions(spark.createDataFrame([(h, BT, f, to) for h, f, to in calls], TX))
    w = Membership(lists.watchlist(spark, watch), mode=mode)
    v = Membership(lists.vaults(spark, vault), mode=mode)
    a = A.actions(t, x, w, v)
    b = A.actions(t, x, w, v, plan="union")
    assert a.count() == b.count()
    assert a.exceptAll(b).count() == 0


@SETTINGS
@given(rows=st.lists(st.tuples(st.sampled_from(["k1", "k2", "k3"]), st.integers(0, 4),
                               st.integers(0, 3)), min_size=1, max_size=40),
       parts=st.integers(1, 7), keyed=st.booleans())
def test_ranged_equals_window(spark, rows, parts, keyed):
    df = spark.createDataFrame(rows, "k string, t long, x long").withColumn(
        "x", F.col("x").cast("decimal(38,18)"))
    kw = dict(order_by=["t", "x"] + ([] if keyed else ["k"]), partition_by=["k"] if keyed else [],
              sums={"cx": F.col("x")})
    w = running(df, strategy="window", **kw).select("k", "t", "x", "seq", "cx")
    r = running(df, strategy="ranged", partitions=parts, **kw).select("k", "t", "x", "seq", "cx")
    assert w.exceptAll(r).count() == 0 and r.exceptAll(w).count() == 0
