"""Long lists are joined; literal lists and joined flags give the same roles."""
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from paths import SF001
from fundflow import config as C
from fundflow import functions as X
from fundflow.plans import catalog
from oracle_compare import compare, duck


def with_long_list(p: catalog.Stages, n: int) -> catalog.Stages:
    """The role list with ``n`` more wallets that no action touches, and its own rows twice, once in upper case."""
    roles = p.inputs.roles
    more = p.spark.range(n).select(F.concat(F.lit("0xmore"), F.col("id").cast("string")).alias("address"),
                                   F.lit(C.ROLE_ATTACKER).alias("role"), F.lit(C.ROLE_PRIORITY[C.ROLE_ATTACKER]).alias("priority"))
    p.inputs = p.inputs._replace(roles=roles.unionByName(more).unionByName(roles.withColumn("address", F.upper("address"))))
    return p


@pytest.mark.parametrize("broadcast_max", [C.BROADCAST_MAX_ROWS, 0])
def test_a_list_of_any_size_is_classified(spark, monkeypatch, broadcast_max):
    monkeypatch.setattr(C, "BROADCAST_MAX_ROWS", broadcast_max)
    p = with_long_list(catalog.Stages(spark, SF001), 12_000)
    ok, msg = compare(catalog._classified(p), duck(SF001), entry.oracle_sql()["X1_classify"])
    assert ok, msg


def test_first_match_wins_for_literals_and_flags(spark):
    attackers, vaults, hops = ["0xA", "0xab"], ["0xa", "0xB"], ["0xb", "0xAB", "0xC"]
    want = {"0xa": C.ROLE_ATTACKER, "0xAB": C.ROLE_ATTACKER, "0xb": C.ROLE_VAULT, "0xc": C.ROLE_HOP, "0xd": C.ROLE_DEFAULT}
    df = spark.createDataFrame([(a,) for a in want], "id string")
    key = X.lower_key("id")
    flags = [F.when(key.isin([x.lower() for x in own]), True) for own in (attackers, vaults, hops)]  # null if not listed
    for args in ((attackers, vaults, hops), flags, (attackers, flags[1], hops)):
        assert {r.id: r.role for r in df.select("id", X.classify("id", *args).alias("role")).collect()} == want
    assert {r[0] for r in df.select(X.classify("id")).collect()} == {C.ROLE_DEFAULT}
