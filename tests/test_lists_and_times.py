"""List files, block-time forms and null amounts."""
import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fundflow import functions as X
from fundflow.operators import replay as R
from fundflow.plans import jobs
from fundflow.sources import lists, versions


def addresses(df):
    return sorted(r.address for r in df.collect())


def test_csv_list_by_column_name(spark, tmp_path):
    p = tmp_path / "list.csv"
    p.write_text('label, Address \n"a, b","0xAbC"\nfoo, 0xdef\nfoo,0xABC\nbar,\n')
    assert addresses(lists.watchlist(spark, str(p))) == ["0xabc", "0xdef"]
    p.write_text("0xabc,foo\n0xdef,bar\n")
    with pytest.raises(ValueError):
        lists.watchlist(spark, str(p))


def test_text_list(spark, tmp_path):
    p = tmp_path / "list.txt"
    p.write_text(" 0xAB \n\n0xcd\n0xab\n")
    assert addresses(lists.vaults(spark, str(p))) == ["0xab", "0xcd"]


def test_table_without_the_column_raises(spark):
    with pytest.raises(ValueError):
        lists.watchlist(spark, spark.createDataFrame([("0xa",)], "wallet string"))


TIMES = [("2024-01-01 10:00:00.000 UTC", 0), ("2024-01-01 10:00:00", 0), ("2024-01-01", -36_000_000), ("2024-01-01T10:00:00", 0),
         ("2024-01-01 10:00:00.123456 UTC", 123), ("2024-01-01T10:00:00.123456Z", 123), ("2024-01-01T10:00", 0),
         ("2024-01-01T10:00:00.5+02:00", 500 - 7_200_000), ("2024-01-01 10:00:00-0130", 5_400_000), ("2024-01-01 10:00:00.123456789", 123),
         (" 2024-01-01T10:00:00Z ", 0), ("2024-01-01 10:00:00 utc", 0), ("", None), ("yesterday", None), ("2024-13-01", None),
         ("2024-01-01 25:00:00", None), (None, None)]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_block_time_forms(spark, zone):
    base = int(dt.datetime(2024, 1, 1, 10, tzinfo=dt.timezone.utc).timestamp() * 1000)
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.createDataFrame([(t,) for t, _ in TIMES], "t string")
        got = [r.ms for r in df.select(X.parse_block_time("t", T.StringType()).alias("ms")).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert got == [None if d is None else base + d for _, d in TIMES]


def events(spark):
    rows = [("a" if i % 3 else "b", "c", None if i % 5 < 2 else float(i), 1000 * (i // 2), "thorchain_launder" if i % 2 else "mutual_transfer", f"h{i:03}")
            for i in range(61)]
    return spark.createDataFrame(rows, "from string, to string, amount double, ts_ms long, label string, hash string").withColumn(
        "amount", F.col("amount").cast("decimal(38,18)"))


@pytest.mark.parametrize("fn", ["running_totals", "running_wallet_totals"])
def test_null_amounts_count_as_zero_in_both_strategies(spark, fn):
    tl = events(spark)
    got = []
    for strategy in ("window", "ranged"):
        rows = getattr(R, fn)(tl.repartition(7), strategy=strategy).collect()
        got.append(sorted(map(str, rows)))
        sums = [c for c in rows[0].asDict() if c.startswith("cum_") or c in ("sent", "received")]
        assert all(r[c] is not None for r in rows for c in sums)
    assert got[0] == got[1]


def test_snapshot_of_null_amounts(spark):
    tl = events(spark).where("hash = 'h000'")
    nodes = spark.createDataFrame([("a", "inter")], "id string, role string")
    rows = {r.address: (r.txns, r.sent, r.received) for r in R.snapshot(tl, nodes, t=10 ** 9).collect()}
    assert rows == {"b": (1, 0.0, 0.0), "c": (1, 0.0, 0.0)}


def test_own_watch_list_brings_no_preset_roles(spark, tmp_path, capsys):
    ins = str(tmp_path)
    t = [("h1", "2024-01-01 10:00:00", "0xA", "0xB", "1.5", "3"), ("h2", "no time", "0xa", "0xb", "2", "4"),
         ("H3", "2024-01-02", "0xb", "0xV", "1", "2")]
    spark.createDataFrame(t, "tx_hash string, block_time string, from_address string, to_address string, amount string, amount_usd string"
                          ).write.parquet(f"{ins}/t")
    spark.createDataFrame([("h3", "2024-01-02", "0xB", "0xv")], "hash string, block_time string, `from` string, `to` string").write.parquet(f"{ins}/x")
    (tmp_path / "w.csv").write_text("address\n0xA\n0xb\n")
    (tmp_path / "v.txt").write_text("0xV\n")
    jobs.main(["all", "--out", f"{ins}/out", "--transfers", f"{ins}/t", "--transactions", f"{ins}/x",
               "--watchlist", f"{ins}/w.csv", "--vaults", f"{ins}/v.txt"])
    assert "events without a readable time: 1" in capsys.readouterr().out
    roles = {r.id: r.role for r in spark.read.json(versions.current(spark, f"{ins}/out/graph") + "/nodes").collect()}
    assert roles == {"0xa": "inter", "0xb": "inter", "0xv": "thorchain"}
    assert spark.read.parquet(versions.current(spark, f"{ins}/out/actions")).count() == 3
