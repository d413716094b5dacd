"""The registered queries: one per operator ID of the inventory.

Every query builds the model's inputs from the driver tables in ``sf_dir``
(``sources.fixtures``, profile ``scale`` by default, so every derived table
grows with the inputs) and runs the operator over the whole tables.
Outputs are presented with plain types (DOUBLE, BIGINT, STRING) so they can
be compared with the SQL oracle.
"""
from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config as C
from .. import functions as X
from .. import schema as S
from ..operators import actions as A
from ..operators import graph as G
from ..operators import replay as R
from ..operators import states
from ..operators.membership import Membership
from ..operators.sizing import checked_broadcast
from ..session import scratch_path
from ..sources import fixtures, layouts, lists, readers, sinks, versions

DEFAULT_PROFILE = "scale"
AS_OF_POSITION = 500      # slider position used by the as-of queries (mid-way)


class Stages:
    """Lazily built stages of the fund-flow pipeline over one input set."""

    def __init__(self, spark: SparkSession, sf_dir: str, profile: str = DEFAULT_PROFILE):
        self.spark, self.sf_dir = spark, sf_dir
        self.inputs = fixtures.load(spark, sf_dir, profile)

    @cached_property
    def line_count(self) -> int:
        """Rows of the largest table read (from its footers): what decides if the action table is stored."""
        return fixtures.line_count(self.spark, self.sf_dir)

    @cached_property
    def watch(self) -> Membership:
        return Membership(self.inputs.watchlist)

    @cached_property
    def vault(self) -> Membership:
        return Membership(self.inputs.vaults)

    @cached_property
    def actions(self) -> DataFrame:
        """The action table, as a plan.

        The batch jobs (``plans.jobs``) store it instead, once for all their
        outputs, and so does a query that reads it more than once from large
        tables (``_reread``).
        """
        i = self.inputs
        return A.actions(i.transfers, i.transactions, self.watch, self.vault)

    @cached_property
    def stored(self) -> fixtures.Stored:
        """The inputs written once with mixed-case keys, text amounts and list files."""
        return fixtures.store(self.inputs, scratch_path(self.spark, "inputs"))

    @cached_property
    def scanned_transfers(self) -> DataFrame:
        return readers.scan_transfers(self.spark, self.stored.transfers, S.TRANSFERS)

    @cached_property
    def scanned_transactions(self) -> DataFrame:
        return readers.scan_transactions(self.spark, self.stored.transactions, S.TRANSACTIONS)

    @cached_property
    def nodes(self) -> DataFrame:
        return G.nodes(self.actions, self.inputs.roles)

    @cached_property
    def edges(self) -> DataFrame:
        return G.edges(self.actions)

    @cached_property
    def timeline(self) -> DataFrame:
        return R.timeline(self.actions)


def present(df: DataFrame) -> DataFrame:
    """Plain output types: DECIMAL/FLOAT -> DOUBLE, small ints -> BIGINT."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DecimalType, T.FloatType)):
            c = c.cast("double")
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        cols.append(c.alias(f.name))
    return df.select(*cols)


# --- helpers for look-up parameters (derived from the data, not fixed) ------------
def busiest_wallet(nodes: DataFrame):
    """The wallet with most transfers (ties: smallest address), as a scalar."""
    return nodes.orderBy(F.col("tx_count").desc(), F.col("id")).limit(1).select("id").scalar()


def most_traced_hash(tl: DataFrame):
    """The transaction hash with most traces (ties: smallest hash), as a scalar."""
    return (tl.groupBy("hash").agg(F.count(F.lit(1)).alias("n"))
              .orderBy(F.col("n").desc(), F.col("hash")).limit(1).select("hash").scalar())


def _roundtrip_actions(p: Stages) -> DataFrame:
    path = scratch_path(p.spark, "actions")
    sinks.write_actions(p.actions, path)
    return readers.scan_actions(p.spark, path)


def _written_actions(p: Stages) -> DataFrame:
    """What the sink stored, by its own footer (S7 reads it with the model's schema)."""
    path = scratch_path(p.spark, "actions")
    sinks.write_actions(p.actions, path)
    return p.spark.read.parquet(versions.current(p.spark, path))


def _classified(p: Stages) -> DataFrame:
    """X1 with its three lists joined as flags, so a list of any size stays off the driver."""
    roles = (C.ROLE_ATTACKER, C.ROLE_VAULT, C.ROLE_HOP)
    flags = [f"_{r}" for r in roles]
    listed = (lists.roles_from(p.inputs.roles).where(F.col("address").isNotNull()).groupBy("address")
              .agg(*[F.max(F.col("role") == r).alias(f) for r, f in zip(roles, flags)]))
    side = checked_broadcast(listed)
    wallets = G.distinct_wallets(p.actions).withColumnRenamed("address", "id")
    return (wallets.join(side, X.lower_key("id") == side["address"], "left")
            .select("id", X.classify("id", *map(F.col, flags)).alias("role")))


def _time_forms(p: Stages) -> DataFrame:
    """X12 on every text form a block time may have."""
    bt = F.col("block_time")
    forms = {
        "ts_ms": bt, "iso_zulu": F.replace(F.replace(bt, F.lit(" UTC"), F.lit("Z")), F.lit(" "), F.lit("T")),
        "no_zone": F.substring(bt, 1, 19), "minutes": F.replace(F.substring(bt, 1, 16), F.lit(" "), F.lit("T")),
        "day": F.substring(bt, 1, 10), "micros": F.concat(F.substring(bt, 1, 19), F.lit(".123456789 UTC")),
        "tenths": F.concat(F.substring(bt, 1, 19), F.lit(".5Z")), "ahead": F.concat(F.substring(bt, 1, 19), F.lit("+0200")),
        "unread": F.concat(F.lit("at "), bt),
    }
    return p.actions.select("tx_hash", "from_address", "to_address", "block_time",
                            *[X.parse_block_time(c, T.StringType()).alias(n) for n, c in forms.items()])


def _wider(df: DataFrame) -> DataFrame:
    """A table as a lake may hold it: columns in another order, and more of them, some named like the output's."""
    more = {"chain": F.lit("main"), "label": F.lit("as received"), "gas": F.length(F.col(df.columns[0]))}
    return df.select(*[c.alias(n) for n, c in more.items()], *[F.col(f"`{c}`") for c in reversed(df.columns)])


def _store(p: Stages) -> states.TimelineStore:
    """The timeline with its periodic states, written and opened again."""
    return states.write_store(p.timeline, scratch_path(p.spark, "store"))


def _stored_snapshot(p: Stages) -> DataFrame:
    store = _store(p)
    return store.snapshot(store.time_at(AS_OF_POSITION), p.nodes)


def _stored_totals(p: Stages) -> DataFrame:
    store = _store(p)
    return store.totals(store.time_at(AS_OF_POSITION), p.nodes)


def _stored_as_of(p: Stages) -> DataFrame:
    store = _store(p)
    return store.as_of(store.time_at(AS_OF_POSITION))


def _bucketed_exits(p: Stages) -> DataFrame:
    """J1 over both inputs stored in the buckets of its keys."""
    path, i = scratch_path(p.spark, "bucketed"), p.inputs
    transfers = layouts.write_bucketed(i.transfers, f"{path}/transfers", layouts.TRANSFER_KEYS)
    transactions = layouts.write_bucketed(i.transactions, f"{path}/transactions", layouts.TRANSACTION_KEYS)
    return A.exit_transfers(transfers, transactions, p.vault)


def _stored_wallet(p: Stages) -> DataFrame:
    """F6 in nodes stored by wallet."""
    path = scratch_path(p.spark, "nodes")
    layouts.write_lookup(p.nodes, path, cluster=["id"])
    nodes = p.spark.read.schema(S.NODES).parquet(path)
    found = nodes.orderBy(F.col("tx_count").desc(), F.col("id")).select("id").first()  # one row: what is looked up
    return G.wallet_detail(nodes, found.id if found else "")


def _stored_transfer(p: Stages) -> DataFrame:
    """F7 in a timeline stored by time, with Bloom filters on hash and wallets."""
    path = scratch_path(p.spark, "timeline")
    layouts.write_lookup(p.timeline, path, cluster=S.EVENT_ORDER, bloom=["hash", "from", "to"])
    tl = p.spark.read.parquet(path)
    found = tl.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), F.col("hash")).select("hash").first()
    return R.transfer_detail(tl, found.hash if found else "")


def _some_null(tl: DataFrame) -> DataFrame:
    """The timeline with some amounts missing."""
    return tl.withColumn("amount", F.when(~F.col("hash").endswith("3"), F.col("amount")))


def _roundtrip_graph(p: Stages) -> tuple[DataFrame, DataFrame]:
    path = scratch_path(p.spark, "graph")
    sinks.write_graph(p.nodes, p.edges, path)
    return readers.read_graph(p.spark, path)


def _reread(fn: Callable[[Stages], DataFrame]) -> Callable[[Stages], DataFrame]:
    """A query that reads the action table more than once (bounds, counts, samples, nodes beside events).

    Extracting the table exchanges a good part of the input, so from large
    inputs it is extracted once and stored, and every reading is a scan of
    what was stored.  From small ones, building a query writes nothing.
    """
    def run(p: Stages) -> DataFrame:
        if p.line_count > C.REREAD_MAX_LINES:
            p.actions = _roundtrip_actions(p)
        return fn(p)
    run.__doc__ = fn.__doc__
    return run


# --- the catalog ------------------------------------------------------------------
def _q(fn: Callable[[Stages], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return present(fn(Stages(spark, sf_dir)))
    run.__doc__ = fn.__doc__
    return run


QUERIES: dict[str, Callable[[Stages], DataFrame]] = {
    # sources / sinks
    "S1_scan_transfers": lambda p: p.scanned_transfers,
    "S2_scan_transactions": lambda p: p.scanned_transactions,
    "S3_watchlist": lambda p: lists.watchlist(p.spark, p.stored.watchlist),
    "S4_vaults": lambda p: lists.vaults(p.spark, p.stored.vaults),
    "S5_roles": lambda p: lists.roles_from(p.spark.read.parquet(p.stored.roles)),
    "S6_write_actions": _written_actions,
    "S7_scan_actions": _roundtrip_actions,
    "S8_write_graph": _reread(lambda p: _roundtrip_graph(p)[0]),
    "S9_read_graph": _reread(lambda p: _roundtrip_graph(p)[1]),
    "S10_preview": lambda p: sinks.preview(p.actions.orderBy(
        "block_time", "tx_hash", "from_address", "to_address", "amount", "label")),
    # projections / filters
    "P1_with_label": lambda p: A.with_label(p.inputs.transfers, C.LABEL_MUTUAL),
    "P2_action_columns": lambda p: A.actions(_wider(p.inputs.transfers), _wider(p.inputs.transactions), p.watch, p.vault),
    "P3_drop_right_time": lambda p: A.exit_transfers(
        p.inputs.transfers, p.inputs.transactions.withColumn("block_time", F.lit("another time")), p.vault),
    "P4_cast_amounts": lambda p: A.actions(p.scanned_transfers, p.scanned_transactions, p.watch, p.vault).select(
        "tx_hash", F.col("amount").cast("double").alias("amount"),
        F.col("amount_usd").cast("double").alias("amount_usd"), "label"),
    "P5_lower_keys": lambda p: readers.normalize_transfers(p.spark.read.parquet(p.stored.transfers)).select(
        "tx_hash", "from_address", "to_address"),
    "P6_edge_projection": lambda p: p.edges,
    "P7_timeline_projection": lambda p: p.timeline,
    "P7_untimed_count": lambda p: R.untimed_count(p.actions.withColumn(
        "block_time", F.when(F.col("tx_hash").endswith("7"), F.lit("unknown")).otherwise(F.col("block_time")))),
    "F1_both_endpoints_watched": lambda p: A.mutual_transfers(p.inputs.transfers, p.watch),
    "F2_calls_into_vault": lambda p: A.vault_calls(p.inputs.transactions, p.vault),
    "F3_is_exit": lambda p: R.is_exit(p.timeline),
    "F4_as_of": _reread(lambda p: R.as_of(p.timeline, position=AS_OF_POSITION)),
    "F5_role_filter": lambda p: G.role_filter(p.nodes, C.ROLE_ATTACKER),
    "F6_wallet_detail": _reread(lambda p: G.wallet_detail(p.nodes, busiest_wallet(p.nodes))),
    "F7_transfer_detail": _reread(lambda p: R.transfer_detail(p.timeline, most_traced_hash(p.timeline))),
    "F6_stored_wallet": _stored_wallet,
    "F7_stored_transfer": _stored_transfer,
    "F8_labelled_amount": lambda p: p.timeline.select(
        "hash", "from", "to", "ts_ms", X.labelled_amount("amount").alias("amount_label")),
    # joins
    "J1_exit_transfers": lambda p: A.exit_transfers(p.inputs.transfers, p.inputs.transactions, p.vault),
    "J1_bucketed_exits": _bucketed_exits,
    "J2_watch_semi": lambda p: A.mutual_transfers(
        p.inputs.transfers, Membership(p.inputs.watchlist, mode="broadcast")),
    "J3_role_lookup": lambda p: G.role_lookup(G.distinct_wallets(p.actions), p.inputs.roles),
    "J4_edge_with_roles": lambda p: G.edges_with_roles(p.edges, p.inputs.roles),
    # aggregations
    "A1_total_sent": lambda p: G.total_sent(p.actions),
    "A2_total_received": lambda p: G.total_received(p.actions),
    "A3_tx_count": lambda p: G.tx_count(p.actions),
    "A4_wallet_stats": lambda p: p.nodes,
    "A5_distinct_wallets": lambda p: G.distinct_wallets(p.actions),
    "A6_role_counts": lambda p: G.role_counts(p.nodes),
    "A7_graph_summary": _reread(lambda p: G.graph_summary(p.nodes, p.edges)),
    "A8_time_bounds": lambda p: R.time_bounds(p.timeline),
    "A9_flow_totals": _reread(lambda p: R.flow_totals(p.timeline, p.nodes)),
    "A10_pair_counts": lambda p: R.pair_counts(p.timeline),
    "A11_wallet_usd_totals": lambda p: G.wallet_usd_totals(p.actions),
    # windows
    "W1_pair_sequence": _reread(lambda p: R.pair_sequence(p.timeline)),
    "W2_global_sequence": _reread(lambda p: R.global_sequence(p.timeline)),
    "W3_running_totals": _reread(lambda p: R.running_totals(p.timeline)),
    "W4_running_wallet_totals": _reread(lambda p: R.running_wallet_totals(p.timeline)),
    "W3_null_amounts": _reread(lambda p: R.running_totals(_some_null(p.timeline))),
    "W4_null_amounts": _reread(lambda p: R.running_wallet_totals(_some_null(p.timeline))),
    "W5_first_appearance": _reread(lambda p: R.first_appearance(p.timeline)),
    "W6_lane_index": _reread(lambda p: R.lane_index(p.timeline, p.nodes)),
    # replay / as-of
    "T1_snapshot": _reread(lambda p: R.snapshot(p.timeline, p.nodes, position=AS_OF_POSITION)),
    "T1_null_amounts": _reread(lambda p: R.snapshot(_some_null(p.timeline), p.nodes, position=AS_OF_POSITION)),
    "T2_totals_at": _reread(lambda p: R.totals_at(p.timeline, p.nodes, position=AS_OF_POSITION)),
    "T1_stored_snapshot": _reread(_stored_snapshot),
    "T2_stored_totals": _reread(_stored_totals),
    "F4_stored_as_of": _reread(_stored_as_of),
    "T3_frames": _reread(lambda p: R.frames(p.timeline, p.nodes)),
    "T4_activation_play": _reread(lambda p: R.activation(p.timeline, p.nodes, "play")),
    "T4_activation_scrub": _reread(lambda p: R.activation(p.timeline, p.nodes, "scrub")),
    "T5_transfer_state": _reread(lambda p: R.transfer_state(p.timeline, position=AS_OF_POSITION)),
    "T6_inflight_at": _reread(lambda p: R.inflight_at(p.timeline, p.nodes)),
    "T7_scrub_position": _reread(lambda p: R.scrub_positions(p.timeline)),
    # order / limit
    "O1_timeline_order": lambda p: R.timeline_order(p.timeline),
    "O2_preview": lambda p: sinks.preview(R.timeline_order(p.timeline)),
    # set operations
    "U1_actions": lambda p: p.actions,
    "U2_endpoints": lambda p: G.endpoints(p.actions),
    # scalar functions
    "X1_classify": _classified,
    "X2_short_address": lambda p: p.nodes.select("id", "short"),
    "X3_address_tag": lambda p: p.nodes.select("id", X.address_tag("id").alias("tag")),
    "X4_role_title": lambda p: p.nodes.select("id", "role", X.role_title("role").alias("title")),
    "X5_role_legend": lambda p: p.nodes.select("id", "role", X.role_legend("role").alias("legend")),
    "X6_pair_key": lambda p: p.timeline.select("hash", "from", "to", X.pair_key("from", "to").alias("pair_key")),
    "X7_edge_weight": lambda p: p.timeline.select("hash", "from", "to", X.edge_weight("amount").alias("weight")),
    "X8_curvature": lambda p: p.timeline.select(
        "hash", "from", "to", X.pair_curvature(F.expr("(ts_ms div 60000) % 1000")).alias("pair_curve"),
        X.global_curvature(F.expr("(ts_ms div 60000) % 1000")).alias("global_curve")),
    "X9_round_money": lambda p: p.edges.select("tx_hash", "from", "to", "amount_eth", "amount_usd"),
    "X10_round_whole": lambda p: p.nodes.select(
        "id", X.round_whole("total_sent").alias("sent_whole"),
        X.whole_text("total_received").alias("received_text")),
    "X11_amount_text": lambda p: p.timeline.select(
        "hash", "from", "to", X.amount_text("amount", 2).alias("text_2dp"),
        X.amount_text("amount", 4).alias("text_4dp")),
    "X12_parse_time": _time_forms,
    "X13_time_text": lambda p: p.timeline.select("hash", "from", "to", "ts_ms",
                                                 X.time_text("ts_ms").alias("time_text")),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: _q(v) for k, v in QUERIES.items()}
