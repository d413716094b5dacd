"""Timeline store: as-of answers from periodic states equal the plain ones and read only their files."""
import re

import pytest
from pyspark.sql import functions as F

from fundflow.operators import replay as R
from fundflow.operators import states
from fundflow.plans.catalog import Stages
from fundflow.session import scratch_path
from paths import SF001

HOUR = 3_600_000


def same(a, b):
    assert a.dtypes == b.dtypes
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def odd(spark):
    """Ties, nulls, repeated rows, negative times, gaps without events."""
    rows = [(f"w{i % 5}", f"w{i * 3 % 7}", f"{i % 9}.000000000000000001", (i * i % 90) * HOUR - 20 * HOUR,
             "thorchain_launder" if i % 3 else "mutual_transfer", f"h{i % 40}") for i in range(150)]
    rows += [("w1", None, None, 5, "mutual_transfer", "h1"), (None, None, "2", 200 * HOUR, None, None)] * 2 + [("w9", "w1", "1", None, "x", "h")]
    tl = spark.createDataFrame(rows, "from string, to string, amount string, ts_ms long, label string, hash string").withColumn(
        "amount", F.col("amount").cast("decimal(38,18)"))
    nodes = spark.createDataFrame([("w0", "attacker"), ("a0", "attacker"), ("w2", "thorchain"), ("w3", "inter")], "id string, role string")
    return tl, nodes


@pytest.mark.parametrize("width, most", [(HOUR, 16), (7 * HOUR, 3), (10_000 * HOUR, 4), (HOUR, 1)])
def test_store_equals_the_plain_queries(spark, width, most):
    tl, nodes = odd(spark)
    store = states.write_store(tl, scratch_path(spark, "t-store"), width, most)
    timed = tl.where("ts_ms is not null")
    for t in (-21 * HOUR, -20 * HOUR, -1, 0, 5, 33 * HOUR, 34 * HOUR - 1, 69 * HOUR, 200 * HOUR, 900 * HOUR):
        same(store.as_of(t), R.as_of(timed, t))
        same(store.snapshot(t, nodes), R.snapshot(timed, nodes, t))
        got, want = store.totals(t, nodes), R.totals_at(timed.withColumn("amount", F.coalesce("amount", F.lit(0).cast("decimal(38,18)"))), nodes, t)
        same(got, want)
    if most > 1 and width < 10_000 * HOUR:
        assert 0 < store.spark.read.parquet(f"{store.folder}/states").select("state").distinct().count() < most


def test_empty_timeline(spark):
    tl, nodes = odd(spark)
    store = states.write_store(tl.limit(0), scratch_path(spark, "t-store"))
    assert store.as_of(store.time_at(500)).count() == 0
    same(store.snapshot(0, nodes), R.snapshot(tl.limit(0), nodes, 0))
    same(store.totals(0, nodes), R.totals_at(tl.limit(0), nodes, 0))


def read_files(df):
    """Files that the executed plan's scans read, by folder."""
    df.collect()
    found = {}

    def walk(node):
        name = node.getClass().getSimpleName()
        if name == "FileSourceScanExec":
            of = re.search(r"/(events|states|totals)\b", node.relation().location().rootPaths().mkString(","))
            if of:
                found[of.group(1)] = found.get(of.group(1), 0) + node.metrics().apply("numFiles").value()
        inner = {"AdaptiveSparkPlanExec": "executedPlan", "ReusedExchangeExec": "child"}.get(name, "plan" if name.endswith("QueryStageExec") else None)
        kids = [getattr(node, inner)()] if inner else []
        children = node.children().iterator()
        while children.hasNext():
            kids.append(children.next())
        for k in kids:
            walk(k)
    walk(df._jdf.queryExecution().executedPlan())
    return found


def files(spark, folder, where="true"):
    return spark.read.parquet(folder).where(where).select(F.input_file_name()).distinct().count()


def test_only_the_files_of_the_state_and_its_delta_are_read(spark):
    p = Stages(spark, SF001)
    tl, nodes = p.timeline, p.nodes
    store = states.write_store(tl, scratch_path(spark, "t-store"))
    t = store.time_at(500)
    all_events = files(spark, f"{store.folder}/events")
    period, state = t // store.width_ms, store.state_before(t)
    since = store.first + state * store.every
    assert state > 0 and since < period
    delta = files(spark, f"{store.folder}/events", f"period between {since} and {period}")
    got = read_files(store.snapshot(t, nodes))
    assert got["events"] == delta < all_events / 4, (got, delta, all_events)
    assert got["states"] == files(spark, f"{store.folder}/states", f"state = {state}")
    # as-of at mid-way reads about half of the files
    half = read_files(store.as_of(t))["events"]
    assert half == files(spark, f"{store.folder}/events", f"period <= {period}") and 0.3 * all_events < half < 0.7 * all_events
