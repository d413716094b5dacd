"""The two physical strategies of ordered running aggregates agree.

The ranged strategy (splitters + buckets + boundary offsets) is forced with
many buckets on small data, including a hot key holding most rows, exact
duplicate rows, nulls in every column and amounts of 18 decimals, and
compared with the plain window.
"""
from pyspark.sql import functions as F

from fundflow.operators import replay as R
from fundflow.operators.sequence import running


def _data(spark):
    rows = []
    for i in range(400):
        key = "hot" if i % 3 else f"k{i % 17}"
        rows.append((key, i // 7, f"h{i % 50}", float(i % 11)))
    rows += [("hot", 5, "dup", 1.0)] * 40          # exact duplicates
    return spark.createDataFrame(rows, "key string, t long, h string, x double").withColumn(
        "x", F.col("x").cast("decimal(38,18)"))


def _cmp(a, b, cols):
    a, b = a.select(*cols), b.select(*cols)
    assert a.count() == b.count()
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_partitioned_running_agrees(spark):
    df = _data(spark)
    kw = dict(order_by=["t", "h", "x"], partition_by=["key"], sums={"cx": F.col("x")})
    w = running(df, strategy="window", **kw)
    r = running(df, strategy="ranged", partitions=13, **kw)
    _cmp(w, r, ["key", "t", "h", "x", "seq", "cx"])


def test_global_running_agrees(spark):
    df = _data(spark)
    kw = dict(order_by=["t", "h", "key", "x"], sums={"cx": F.col("x")})
    w = running(df, strategy="window", **kw)
    r = running(df, strategy="ranged", partitions=9, **kw)
    _cmp(w, r, ["key", "t", "h", "x", "seq", "cx"])
    assert sorted(x.seq for x in r.collect()) == list(range(1, df.count() + 1))


def test_nulls_repeats_and_last_decimals_agree(spark, monkeypatch):
    from fundflow import config as C
    rows = [("a", 1, "1.000000000000000001")] * 9 + [("b", 2, "-3.5")] * 4 + [
        ("a", 2, "-2.25"), (None, 3, "1"), (None, 3, None), ("a", None, None), ("a", None, "0.000000000000000007"), (None, None, None)] * 2
    df = spark.createDataFrame(rows, "k string, t long, x string").withColumn("x", F.col("x").cast("decimal(38,18)"))
    df = df.withColumn("d", F.col("x").cast("decimal(20,2)"))
    sums = {"cx": F.col("x"), "ct": F.col("t"), "cd": F.col("d")}
    for piece in (65_536, 2):
        monkeypatch.setattr(C, "REPEATS_PER_PIECE", piece)
        for kw in (dict(order_by=["t", "x"], partition_by=["k"]), dict(order_by=["t", "k", "x"])):
            w = running(df, strategy="window", sums=sums, **kw)
            for n in (1, 2, 7):
                r = running(df, strategy="ranged", partitions=n, sums=sums, **kw)
                assert r.dtypes == w.dtypes
                _cmp(w, r, w.columns)
    empty = running(df.limit(0), ["t"], sums=sums, strategy="ranged")
    assert empty.count() == 0 and empty.columns == [*df.columns, "seq", "cx", "ct", "cd"]


def test_first_sightings_agree(spark):
    """Ties in time and in the packed part of the key, nulls, and hashes of any text."""
    rows = [("w%d" % (i % 7), "w%d" % (i * 5 % 11), str(i % 4), i // 40, "x", h) for i, h in enumerate(
        ["0xab", "0xabcdefgh1", "0xabcdefgh0", "", None, "é", "Z" * 9, "z" * 9] * 30)]
    rows += [(None, "w50", "1", 0, None, None), ("w51", "w51", None, 2, "x", "0xab"), ("w52", None, "1", None, "x", "h")]
    tl = spark.createDataFrame(rows, "from string, to string, amount string, ts_ms long, label string, hash string").withColumn(
        "amount", F.col("amount").cast("decimal(38,18)"))
    one, other = R.first_appearance(tl, form="packed"), R.first_appearance(tl, form="struct")
    _cmp(one, other, one.columns)
    assert one.count() == 14
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan


def test_replay_windows_agree_on_driver_data(spark):
    from paths import SF001
    from fundflow.plans.catalog import Stages
    p = Stages(spark, SF001)
    tl = p.timeline.cache()
    for fn, cols in ((R.global_sequence, ["hash", "idx"]),
                     (R.running_totals, ["hash", "tx_number", "cum_eth", "cum_laundered"]),
                     (R.pair_sequence, ["hash", "pair_key", "pair_seq"]),
                     (R.running_wallet_totals, ["address", "hash", "txns", "sent", "received"]),
                     (R.first_appearance, ["address", "appearance"])):
        _cmp(fn(tl, strategy="window"), fn(tl, strategy="ranged"), cols)
    _cmp(R.lane_index(tl, p.nodes, strategy="window"), R.lane_index(tl, p.nodes, strategy="ranged"),
         ["address", "role", "lane"])
    tl.unpersist()
