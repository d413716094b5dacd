"""Batch jobs: extract -> graph -> replay, as ``spark-submit``-able commands.

``extract``  transfers + transactions -> ``<out>/actions`` (Parquet), then a
             5-row preview read back from the written data (no recompute).
``graph``    actions -> ``<out>/tables``: ``nodes`` and ``edges`` (Parquet,
             which replay reads), and ``<out>/graph``: both as JSON lines (an
             export); role counts and totals printed.
``replay``   actions -> ``<out>/replay``: ``timeline, frames, activation_*,
             running, pair_sequence, wallet_running, lanes`` (Parquet), and
             ``<out>/store`` (periodic states, ``operators.states``).  The
             timeline is written once and read back, so every replay output
             starts from a stored table instead of re-running the extraction;
             its clock is read once.  Events whose time can't be read are
             counted and printed.
``all``      the three in a row.

Every output is a committed version (``sources.versions``; read its folder
with ``versions.current``): a job that dies leaves the former one readable.

Without any list the traced case's lists (``sources.presets``) are used.  As
soon as one of ``--watchlist/--vaults/--attackers/--hops`` is given (a Parquet
path, a CSV with an ``address`` column or a text file with one address per
line), lists that are not given are empty.

Keys of unknown case are normalised once: the inputs are written lower-case
to ``<out>/inputs`` and read from there, so the list filters reach Parquet.
With ``--lower-keys`` the inputs are known to be lower-case and are read in
place.

Checkpoints go to ``spark.checkpoint.dir``, or to ``<out>/checkpoints``.

Example::

    python -m fundflow.plans.jobs all --transfers data/attackers_transfers \\
        --transactions data/attackers_transactions --out out/

(on a cluster: ``spark-submit --py-files fundflow.zip run_jobs.py all ...``)
"""
from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession

from .. import schema as S
from ..operators import actions as A
from ..operators import graph as G
from ..operators import replay as R
from ..operators import states
from ..session import get_session
from ..sources import layouts, lists, presets, readers, sinks, versions


def _list(spark: SparkSession, given, default, any_given: bool):
    return lists.address_relation(spark, given or (() if any_given else default))


def lowered_inputs(spark: SparkSession, transfers_path: str, transactions_path: str, out: str,
                   lower_keys: bool = False) -> tuple[DataFrame, DataFrame]:
    """Both inputs with lower-case keys as stored, so filters on keys are pushed to the scan."""
    if not lower_keys:
        folder = f"{out}/inputs"
        readers.scan_transfers(spark, transfers_path).write.mode("overwrite").parquet(f"{folder}/transfers")
        readers.scan_transactions(spark, transactions_path).write.mode("overwrite").parquet(f"{folder}/transactions")
        transfers_path, transactions_path = f"{folder}/transfers", f"{folder}/transactions"
    return (readers.scan_transfers(spark, transfers_path, lower_keys=False),
            readers.scan_transactions(spark, transactions_path, lower_keys=False))


def extract(spark: SparkSession, transfers_path: str, transactions_path: str, out: str,
            watchlist=None, vaults=None, lower_keys: bool = False, any_given: bool | None = None) -> DataFrame:
    any_given = bool(watchlist or vaults) if any_given is None else any_given
    transfers, transactions = lowered_inputs(spark, transfers_path, transactions_path, out, lower_keys)
    w = _list(spark, watchlist, presets.WATCHLIST, any_given)
    v = _list(spark, vaults, presets.VAULTS, any_given)
    sinks.write_actions(A.actions(transfers, transactions, w, v), f"{out}/actions")
    written = readers.scan_actions(spark, f"{out}/actions")
    sinks.preview(written).show(truncate=False)
    return written


def build_graph(spark: SparkSession, out: str, attackers=None, vaults=None,
                hops=None, any_given: bool | None = None) -> tuple[DataFrame, DataFrame]:
    any_given = bool(attackers or vaults or hops) if any_given is None else any_given
    actions = readers.scan_actions(spark, f"{out}/actions")
    given = {"attackers": attackers, "vaults": vaults, "hops": hops}
    if not any_given:
        given = {"attackers": presets.ATTACKERS, "vaults": presets.VAULTS, "hops": presets.HOPS}
    roles = lists.roles(spark, **given)

    def write(folder: str) -> None:
        layouts.write_lookup(G.nodes(actions, roles), f"{folder}/nodes", cluster=["id"])
        G.edges(actions).write.parquet(f"{folder}/edges")

    versions.write_version(spark, f"{out}/tables", write)
    nodes, edges = graph_tables(spark, out)
    sinks.write_graph(nodes, edges, f"{out}/graph")
    G.graph_summary(nodes, edges).show(truncate=False)
    return nodes, edges


def graph_tables(spark: SparkSession, out: str) -> tuple[DataFrame, DataFrame]:
    folder = versions.current(spark, f"{out}/tables")
    if folder is None:
        raise FileNotFoundError(f"no committed graph tables below {out}; run the graph job first")
    return spark.read.schema(S.NODES).parquet(f"{folder}/nodes"), spark.read.schema(S.EDGES).parquet(f"{folder}/edges")


def replay(spark: SparkSession, out: str) -> None:
    nodes, edges = graph_tables(spark, out)

    def write(folder: str) -> None:
        layouts.write_lookup(R.timeline(edges), f"{folder}/timeline", cluster=S.EVENT_ORDER, bloom=["hash", "from", "to"])
        tl = spark.read.parquet(f"{folder}/timeline")
        clock = R.Clock(tl)
        outputs = {
            "frames": R.frames(tl, nodes, clock=clock),
            "activation_play": R.activation(tl, nodes, "play", clock),
            "activation_scrub": R.activation(tl, nodes, "scrub", clock),
            "running": R.running_totals(tl),
            "pair_sequence": R.pair_sequence(tl),
            "wallet_running": R.running_wallet_totals(tl),
            "lanes": R.lane_index(tl, nodes),
        }
        for name, df in outputs.items():
            df.write.parquet(f"{folder}/{name}")

    folder = versions.write_version(spark, f"{out}/replay", write)
    tl = spark.read.parquet(f"{folder}/timeline")
    states.write_store(tl, f"{out}/store")
    R.flow_totals(tl, nodes).show(truncate=False)
    print(f"events without a readable time: {R.untimed_count(edges).first().untimed or 0}")


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="fundflow")
    ap.add_argument("command", choices=["extract", "graph", "replay", "all"])
    ap.add_argument("--out", required=True)
    ap.add_argument("--transfers")
    ap.add_argument("--transactions")
    ap.add_argument("--watchlist")
    ap.add_argument("--vaults")
    ap.add_argument("--attackers")
    ap.add_argument("--hops")
    ap.add_argument("--lower-keys", action="store_true", help="the inputs' keys are lower-case as stored")
    ap.add_argument("--master")
    a = ap.parse_args(argv)
    spark = get_session("fundflow", master=a.master)
    if not spark.sparkContext.getCheckpointDir() and not spark.conf.get("spark.checkpoint.dir", None):
        spark.sparkContext.setCheckpointDir(f"{a.out}/checkpoints")
    given = bool(a.watchlist or a.vaults or a.attackers or a.hops)
    if a.command in ("extract", "all"):
        if not (a.transfers and a.transactions):
            ap.error("extract needs --transfers and --transactions")
        extract(spark, a.transfers, a.transactions, a.out, a.watchlist, a.vaults, a.lower_keys, given)
    if a.command in ("graph", "all"):
        build_graph(spark, a.out, a.attackers, a.vaults, a.hops, given)
    if a.command in ("replay", "all"):
        replay(spark, a.out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
