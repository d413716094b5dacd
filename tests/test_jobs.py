"""The batch jobs end to end on Parquet inputs (reference-profile lists)."""
from pyspark.sql import functions as F

from paths import SF001
from fundflow.plans import jobs
from fundflow.session import scratch_path
from fundflow.sources import fixtures, versions


def test_extract_graph_replay(spark, capsys):
    i = fixtures.load(spark, SF001, "reference")
    base = scratch_path(spark, "t-jobs")
    i.transfers.write.parquet(f"{base}/in/transfers")
    i.transactions.write.parquet(f"{base}/in/transactions")
    i.watchlist.write.parquet(f"{base}/in/watchlist")
    i.vaults.write.parquet(f"{base}/in/vaults")
    i.roles.where(F.col("role") == "attacker").select("address").write.parquet(f"{base}/in/attackers")
    i.roles.where(F.col("role") == "pre-inter").select("address").write.parquet(f"{base}/in/hops")
    out = f"{base}/out"
    rc = jobs.main(["all", "--out", out, "--transfers", f"{base}/in/transfers",
                    "--transactions", f"{base}/in/transactions", "--watchlist", f"{base}/in/watchlist",
                    "--vaults", f"{base}/in/vaults", "--attackers", f"{base}/in/attackers",
                    "--hops", f"{base}/in/hops"])
    assert rc == 0
    assert spark.read.parquet(versions.current(spark, f"{out}/actions")).count() == 843
    nodes = spark.read.json(versions.current(spark, f"{out}/graph") + "/nodes")
    assert nodes.count() == 151
    roles = {r.role: r.n for r in nodes.groupBy("role").agg(F.count("*").alias("n")).collect()}
    assert roles["attacker"] == 5 and roles["thorchain"] == 4 and roles["pre-inter"] == 1
    replay = versions.current(spark, f"{out}/replay")
    assert spark.read.parquet(f"{replay}/frames").count() == 1001
    assert spark.read.parquet(f"{replay}/timeline").count() == 843
    assert spark.read.parquet(f"{replay}/lanes").count() == 151
