"""A query that reads the action table more than once extracts it once from large inputs."""
import datetime as dt

import pytest

import __spark_entry__ as entry
from fundflow import config as C
from fundflow.plans import catalog


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Small tables with null keys, dates and prices, repeated rows, and orders with and without returned lines."""
    path = str(tmp_path_factory.mktemp("reread"))
    day = lambda i: dt.datetime(1995, 1, 1) + dt.timedelta(days=i)
    orders = [(k, k % 11 * 5, day(k)) for k in range(60)] + [(7, 35, day(7)), (None, 5, day(1)), (61, None, day(2)), (62, 10, None)]
    lines = [(k % 63, i % 12 * 5, k % 4 * 25, float(100 + k * 7 % 31), "R" if (k + i) % 3 == 0 else "N")
             for k in range(63) for i in range(4)]
    lines += lines[:9] + [(None, 5, 25, 3.0, "R"), (3, None, 25, 3.0, "N"), (4, 5, None, 3.0, "R"), (5, 10, 25, None, "N")]
    save = lambda rows, schema, name: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{name}.parquet")
    save(orders, "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp_ntz", "orders")
    save(lines, "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_extendedprice double, l_returnflag string", "lineitem")
    save([(k,) for k in range(60)] + [(5,), (None,)], "c_custkey bigint", "customer")
    save([(k,) for k in range(0, 100, 5)] + [(25,), (None,)], "s_suppkey bigint", "supplier")
    return path


@pytest.mark.parametrize("key", ["W4_running_wallet_totals", "T4_activation_play", "T2_totals_at", "T1_null_amounts",
                                 "T1_stored_snapshot", "F4_as_of", "S8_write_graph"])
def test_large_inputs_are_extracted_once(spark, tables, monkeypatch, key):
    rows = lambda df: sorted(map(repr, df.collect()))
    want = rows(entry.queries()[key](spark, tables))
    made = []
    extract = catalog.A.actions
    monkeypatch.setattr(catalog.A, "actions", lambda *a, **k: made.append(key) or extract(*a, **k))
    monkeypatch.setattr(C, "REREAD_MAX_LINES", 0, raising=False)
    df = entry.queries()[key](spark, tables)
    assert want and rows(df) == want
    assert made == [key]
    assert "orderkey" not in df._jdf.queryExecution().optimizedPlan().toString()
