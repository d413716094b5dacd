"""Fund-flow analytics on Spark.

The public API (every function maps DataFrames to a DataFrame)::

    from fundflow import load, actions, nodes, edges, timeline, snapshot, frames, activation
    transfers, transactions = load(spark, "data/attackers_transfers", "data/attackers_transactions")
    acts = actions(transfers, transactions, watchlist_df, vaults_df)

Lower-level pieces live in ``fundflow.operators``, ``fundflow.sources``
and ``fundflow.functions``.
"""
from __future__ import annotations

from .operators.actions import actions
from .operators.graph import edges, nodes, wallet_detail
from .operators.replay import activation, frames, snapshot, timeline, transfer_detail
from .sources.sinks import write_actions, write_graph


def load(spark, transfers_path: str, transactions_path: str):
    """Read the two input tables (Parquet), normalised: ``(transfers, transactions)``."""
    from .sources.readers import scan_transactions, scan_transfers
    return scan_transfers(spark, transfers_path), scan_transactions(spark, transactions_path)


__all__ = ["load", "actions", "nodes", "edges", "timeline", "snapshot", "frames", "activation",
           "wallet_detail", "transfer_detail", "write_actions", "write_graph"]
