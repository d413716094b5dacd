"""Wallet graph: A1-A7, A11, J3, J4, P6, U2, X1-X3, F5-F7.

Per-wallet totals come from one hash aggregation over *endpoint rows*: each
action is turned into two rows (sender side, receiver side) by one
``explode`` over the scanned rows, then grouped by address.  Partial
aggregation runs before the shuffle, so a wallet that receives a third of
all transfers costs one partial row per task, not a hot reducer.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from .. import functions as X
from .sizing import checked_broadcast

SEND, RECEIVE = "send", "receive"


def endpoints(actions: DataFrame, keep=("amount", "amount_usd")) -> DataFrame:
    """One row per (action, end): ``address, side`` + the ``keep`` columns.

    A self-transfer yields two rows for the same address.  Only the columns
    asked for go into the exploded struct (Catalyst does not prune fields
    of a generated struct, so extra ones would be read from the scan).
    """
    keep = list(keep)
    side = lambda addr, name: F.struct(
        F.col(addr).alias("address"), F.lit(name).alias("side"), *[F.col(c) for c in keep])
    return (actions.select(F.explode(F.array(side("from_address", SEND), side("to_address", RECEIVE))).alias("e"))
                   .select("e.*"))


def distinct_wallets(actions: DataFrame) -> DataFrame:
    """A5: every address that sends or receives (nulls dropped)."""
    return (endpoints(actions, keep=()).select("address").where(F.col("address").isNotNull())
            .distinct())


def wallet_sums(actions: DataFrame, with_usd: bool = False) -> DataFrame:
    """A1-A3 (+ A11) as exact sums: one grouped aggregation, no per-wallet scans."""
    e = endpoints(actions, keep=("amount", "amount_usd") if with_usd else ("amount",))
    e = e.where(F.col("address").isNotNull())
    sent = F.col("side") == SEND
    aggs = [F.sum(F.when(sent, F.col("amount"))).alias("_sent"),
            F.sum(F.when(~sent, F.col("amount"))).alias("_received")]
    if with_usd:
        aggs += [F.sum(F.when(sent, F.col("amount_usd"))).alias("_sent_usd"),
                 F.sum(F.when(~sent, F.col("amount_usd"))).alias("_received_usd")]
    return e.groupBy("address").agg(*aggs, F.count(F.lit(1)).alias("tx_count"))


def _zero(c: str):
    return F.coalesce(F.col(c), F.lit(0).cast(C.MONEY_TYPE))


def wallet_stats(actions: DataFrame) -> DataFrame:
    """A4: ``address, total_sent, total_received, tx_count`` (0 when none, 4 dp)."""
    s = wallet_sums(actions)
    return s.select(
        "address",
        X.round_money(_zero("_sent"), C.ETH_DECIMALS).alias("total_sent"),
        X.round_money(_zero("_received"), C.ETH_DECIMALS).alias("total_received"),
        F.col("tx_count").cast("bigint").alias("tx_count"),
    )


def total_sent(actions: DataFrame) -> DataFrame:
    """A1."""
    return wallet_stats(actions).select("address", "total_sent")


def total_received(actions: DataFrame) -> DataFrame:
    """A2."""
    return wallet_stats(actions).select("address", "total_received")


def tx_count(actions: DataFrame) -> DataFrame:
    """A3: sends + receipts (a self-transfer counts twice)."""
    return wallet_stats(actions).select("address", "tx_count")


def wallet_usd_totals(actions: DataFrame) -> DataFrame:
    """Wallet totals in ETH and USD (USD rounded to 2 dp)."""
    s = wallet_sums(actions, with_usd=True)
    return s.select(
        "address",
        X.round_money(_zero("_sent"), C.ETH_DECIMALS).alias("total_sent"),
        X.round_money(_zero("_received"), C.ETH_DECIMALS).alias("total_received"),
        X.round_money(_zero("_sent_usd"), C.USD_DECIMALS).alias("total_sent_usd"),
        X.round_money(_zero("_received_usd"), C.USD_DECIMALS).alias("total_received_usd"),
        F.col("tx_count").cast("bigint").alias("tx_count"),
    )


# --- J3: role lookup ----------------------------------------------------------
def resolve_roles(roles: DataFrame) -> DataFrame:
    """One role per address: the lowest priority number wins (first match)."""
    return (roles.where(F.col("address").isNotNull())
            .groupBy(F.lower("address").alias("address"))
            .agg(F.min_by("role", F.struct("priority", "role")).alias("role")))


def _roles_side(roles: DataFrame) -> DataFrame:
    resolved = resolve_roles(roles)
    return checked_broadcast(resolved)


def role_lookup(wallets: DataFrame, roles: DataFrame, address: str = "address") -> DataFrame:
    """Add ``role`` to each row (default ``inter``) by a left join.

    The resolved role table is broadcast when its checked size allows.
    """
    r = _roles_side(roles).select(F.col("address").alias("_r_addr"), F.col("role").alias("_r_role"))
    out = wallets.join(r, F.col(address) == F.col("_r_addr"), "left")
    return out.drop("_r_addr").withColumn("role", F.coalesce(F.col("_r_role"), F.lit(C.ROLE_DEFAULT))).drop("_r_role")


def nodes(actions: DataFrame, roles: DataFrame, with_usd: bool = False) -> DataFrame:
    """Graph nodes: ``id, short, role, total_sent, total_received, tx_count``."""
    stats = wallet_usd_totals(actions) if with_usd else wallet_stats(actions)
    out = role_lookup(stats, roles)
    cols = [F.col("address").alias("id"), X.short_address("address").alias("short"), "role",
            "total_sent", "total_received", "tx_count"]
    if with_usd:
        cols += ["total_sent_usd", "total_received_usd"]
    return out.select(*cols)


def role_counts(nodes_df: DataFrame) -> DataFrame:
    """Wallets per role; a known role without wallets has 0."""
    known = nodes_df.sparkSession.createDataFrame(
        [(r,) for r in (*C.ROLE_PRIORITY, C.ROLE_DEFAULT)], "role string").withColumn("_one", F.lit(0))
    seen = nodes_df.select("role", F.lit(1).alias("_one"))
    return seen.unionByName(known).groupBy("role").agg(F.sum("_one").cast("bigint").alias("wallets"))


def graph_summary(nodes_df: DataFrame, edges_df: DataFrame) -> DataFrame:
    """One row ``wallets, edges`` (+ per-role wallet counts).

    Both counts are global aggregates evaluated as scalar subqueries.
    """
    by_role = {r: F.coalesce(F.sum(F.when(F.col("role") == r, 1).otherwise(0)), F.lit(0)).cast("bigint")
               for r in (C.ROLE_ATTACKER, C.ROLE_HOP, C.ROLE_DEFAULT, C.ROLE_VAULT)}
    n_edges = edges_df.select(F.count(F.lit(1))).scalar()
    return nodes_df.agg(
        F.count(F.lit(1)).alias("wallets"),
        *[v.alias(f"{k.replace('-', '_')}_wallets") for k, v in by_role.items()],
    ).select("*", n_edges.cast("bigint").alias("edges"))


# --- P6: edges ------------------------------------------------------------------
def edges(actions: DataFrame) -> DataFrame:
    """``from, to, tx_hash, amount_eth (4 dp), amount_usd (2 dp), timestamp, label``."""
    return actions.select(
        F.col("from_address").alias("from"),
        F.col("to_address").alias("to"),
        "tx_hash",
        X.round_money("amount", C.ETH_DECIMALS).alias("amount_eth"),
        X.round_money("amount_usd", C.USD_DECIMALS).alias("amount_usd"),
        F.col("block_time").alias("timestamp"),
        "label",
    )


def special_roles(nodes_df: DataFrame) -> DataFrame:
    """Wallets whose role is not the default, as ``(address, role)``.

    ``nodes_df`` is the role list ``(address, role, priority)`` itself, which
    is broadcast after a check of its size and needs no wallet totals, or the
    graph's nodes.  Nodes may be a plan whose size is known only once it has
    run, so that join is left to the adaptive planner, which broadcasts the
    side if it turns out small; counting it first would run the plan twice.
    """
    if "priority" in nodes_df.columns:
        return _roles_side(nodes_df)
    return nodes_df.where(F.col("role") != C.ROLE_DEFAULT).select(F.col("id").alias("address"), "role")


def with_roles(df: DataFrame, nodes_df: DataFrame, *pairs: tuple[str, str]) -> DataFrame:
    """Add one role column per ``(address column, role column)`` pair.

    Looks up the small non-default role table (broadcast hash joins, no
    shuffle of ``df``); any other wallet gets the default role.
    """
    roles = special_roles(nodes_df)
    for addr, name in pairs:
        r = roles.select(F.col("address").alias(f"_r_{name}"), F.col("role").alias(f"_v_{name}"))
        df = (df.join(r, F.col(addr) == F.col(f"_r_{name}"), "left")
                .withColumn(name, F.coalesce(F.col(f"_v_{name}"), F.lit(C.ROLE_DEFAULT)))
                .drop(f"_r_{name}", f"_v_{name}"))
    return df


def edges_with_roles(edges_df: DataFrame, roles: DataFrame) -> DataFrame:
    """Each edge with its sender's and receiver's role (from the role list, or nodes)."""
    return with_roles(edges_df, roles, ("from", "from_role"), ("to", "to_role"))


# --- F5-F7: look-ups ------------------------------------------------------------
def role_filter(nodes_df: DataFrame, role: str = C.ROLE_ATTACKER) -> DataFrame:
    """nodes of one role."""
    return nodes_df.where(F.col("role") == role)


def wallet_detail(nodes_df: DataFrame, address) -> DataFrame:
    """one wallet: address, role, txns, sent and received (whole ETH), title.

    ``address`` is a text (lower-cased here) or a Column (e.g. a scalar subquery).
    """
    key = F.lit(address.lower()) if isinstance(address, str) else address
    return (nodes_df.where(F.col("id") == key)
            .select(F.col("id").alias("address"), "role", F.col("tx_count").alias("txns"),
                    X.round_whole("total_sent").alias("sent"),
                    X.round_whole("total_received").alias("received"),
                    X.role_title("role").alias("title")))
