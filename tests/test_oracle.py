"""Every registered query equals its SQL oracle (DuckDB) on the driver data."""
import pytest

import __spark_entry__ as entry
from fundflow.plans import catalog
from paths import SF001
from oracle_compare import compare, duck

KEYS = sorted(catalog.queries())


@pytest.fixture(scope="module")
def con():
    return duck(SF001)


def test_every_query_has_sql():
    assert set(KEYS) <= set(entry.queries()) and set(KEYS) <= set(entry.oracle_sql())


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, con, key):
    ok, msg = compare(entry.queries()[key](spark, SF001), con, entry.oracle_sql()[key])
    assert ok, msg


def test_entry_flagship(spark):
    """The flagship is U1 over the whole tables."""
    df = entry.entry(spark)
    assert df.count() == len(duck(SF001).sql(entry.oracle_sql()["U1_actions"]).fetchall())
    assert df.columns == ["tx_hash", "block_time", "from_address", "to_address", "amount",
                          "amount_usd", "label"]
