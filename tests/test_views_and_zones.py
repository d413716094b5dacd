"""SQL over registered views; results independent of the session time zone."""
from paths import SF001
from fundflow.plans.catalog import Stages, queries
from fundflow.plans.views import register_views


def test_sql_over_views(spark):
    p = Stages(spark, SF001)
    names = register_views(spark, actions=p.actions, nodes=p.nodes, edges=p.edges, timeline=p.timeline)
    assert set(names) == {"actions", "nodes", "edges", "timeline", "frames"}
    n = spark.sql("SELECT count(*) AS n FROM actions").first().n
    assert n == p.actions.count()
    last = spark.sql("SELECT events FROM frames WHERE frame = 1000").first().events
    assert last == p.timeline.count()


def test_results_do_not_depend_on_session_zone(spark):
    keys = ["X12_parse_time", "X13_time_text", "T3_frames", "S1_scan_transfers"]
    before = {k: sorted(map(tuple, queries()[k](spark, SF001).collect())) for k in keys}
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("America/New_York", "Asia/Kolkata"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            for k in keys:
                assert sorted(map(tuple, queries()[k](spark, SF001).collect())) == before[k], (zone, k)
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
