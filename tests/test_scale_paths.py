"""The registered queries through their large-data paths.

Thresholds are set to zero so that every list is a shuffled join, role
tables are not broadcast and every ordered window takes the ranged path
(splitters + buckets + offsets); results must still equal the
SQL oracle.
"""
import pytest

import __spark_entry__ as entry
from paths import SF001
from fundflow import config as C
from oracle_compare import compare, duck

KEYS = ["U1_actions", "F1_both_endpoints_watched", "J3_role_lookup", "J4_edge_with_roles",
        "A4_wallet_stats", "W1_pair_sequence", "W2_global_sequence", "W3_running_totals",
        "W4_running_wallet_totals", "W5_first_appearance", "W6_lane_index", "T1_snapshot",
        "T3_frames", "T4_activation_play"]


@pytest.fixture(scope="module")
def con():
    return duck(SF001)


@pytest.mark.parametrize("key", KEYS)
def test_large_data_paths_match_oracle(spark, con, key, monkeypatch):
    monkeypatch.setattr(C, "INLIST_MAX", 0)
    monkeypatch.setattr(C, "BROADCAST_MAX_ROWS", 0)
    monkeypatch.setattr(C, "LOCAL_WINDOW_MAX_ROWS", 0)
    ok, msg = compare(entry.queries()[key](spark, SF001), con, entry.oracle_sql()[key])
    assert ok, msg
