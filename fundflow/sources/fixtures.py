"""Adapter: the driver's TPC-H-like tables reshaped into the model's inputs.

Mapping: order -> transaction, order line -> transfer (an internal trace of
that transaction), customer -> wallet, supplier -> vault-range address.
Returned lines pay a vault-range address; other lines pay a wallet.  Every
order is a transaction: it calls the vault of its first returned line, or
its own wallet if no line was returned.
Times are the order date plus ``orderkey % 1440`` minutes.

Two profiles:

* ``reference`` keeps the traced case's cardinalities: 120 watch-listed
  wallets at most (every fifth customer below 600), receivers folded onto
  150 wallets, four vaults (suppliers 0-3).  ``actions`` then hardly grows
  with the scale factor.
* ``scale`` lifts the caps so every derived table grows with the inputs:
  every fifth customer is watch-listed, the receiver is the part key, every
  25th supplier is a vault, every 100th customer a hop wallet and the other
  multiples of 25 are attackers.

The ``reference`` profile has 5 attackers (customers 5, 10, 15, 20, 25) and 1
hop wallet (customer 0); only tests use it.
"""
from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C

PROFILES = {
    # watch cap (exclusive, None = none), receiver modulus (None = part key), vault rule,
    # listed people: every role_step-th customer (up to role_cap), hops every hop_step-th (None: the first)
    "reference": {"watch_cap": 600, "receiver_mod": 150, "vault_mod": None, "vault_cap": 4,
                  "role_step": 5, "role_cap": 25, "hop_step": None},
    "scale": {"watch_cap": None, "receiver_mod": None, "vault_mod": 25, "vault_cap": None,
              "role_step": 25, "role_cap": None, "hop_step": 100},
}


class Inputs(NamedTuple):
    transfers: DataFrame
    transactions: DataFrame
    watchlist: DataFrame
    vaults: DataFrame
    roles: DataFrame


def _hex(k: Column, width: int, prefix: str) -> Column:
    return F.concat(F.lit(prefix), F.lpad(F.lower(F.hex(k)), width, "0"))


def wallet_address(k: Column) -> Column:
    return _hex(k, 40, "0x")


def vault_address(k: Column) -> Column:
    return _hex(k, 39, "0xf")


def tx_hash(k: Column) -> Column:
    return _hex(k, 64, "0x")


def block_time(order_date: Column, order_key: Column) -> Column:
    minutes = (order_key % 1440).cast("int")
    t = order_date.cast("timestamp_ntz") + F.make_dt_interval(mins=minutes)
    return F.concat(t.cast("string"), F.lit(".000 UTC"))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _is_vault(k: Column, p: dict) -> Column:
    if p["vault_mod"] is not None:
        return k % p["vault_mod"] == 0
    return k < p["vault_cap"]


def load(spark: SparkSession, sf_dir: str, profile: str = "scale") -> Inputs:
    """Reference-shaped inputs from the driver tables in ``sf_dir``."""
    p = PROFILES[profile]
    lineitem = _table(spark, sf_dir, "lineitem")
    orders = _table(spark, sf_dir, "orders")
    customer = _table(spark, sf_dir, "customer")
    supplier = _table(spark, sf_dir, "supplier")

    # Texts are made above the join by order key, so that its exchange and sort
    # carry keys and numbers only; a list test on an end is a predicate, which
    # moves below the join with the text it tests and drops rows before their
    # exchange.  Neither table is small by nature, so both joins by order key
    # are planned alike at any size.
    receiver_key = F.col("l_partkey") if p["receiver_mod"] is None else F.col("l_partkey") % p["receiver_mod"]
    cents = F.col("l_extendedprice").cast("decimal(18,2)")
    transfers = (
        lineitem.join(orders.hint("merge"), F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            tx_hash(F.col("l_orderkey")).alias("tx_hash"),
            block_time(F.col("o_orderdate"), F.col("o_orderkey")).alias("block_time"),
            wallet_address(F.col("o_custkey")).alias("from_address"),
            F.when(F.col("l_returnflag") == "R", vault_address(F.col("l_suppkey")))
             .otherwise(wallet_address(receiver_key)).alias("to_address"),
            (cents * F.lit(0.01).cast("decimal(3,2)")).cast(C.MONEY_TYPE).alias("amount"),
            # to the cent first: engines differ in how a binary double widens
            # to 18 decimals, not in how it rounds to 2
            cents.cast(C.MONEY_TYPE).alias("amount_usd"),
        )
    )

    first_vault = (lineitem.where(F.col("l_returnflag") == "R")
                   .groupBy("l_orderkey").agg(F.min("l_suppkey").alias("sk")))
    transactions = (
        orders.join(first_vault.hint("merge"), F.col("l_orderkey") == F.col("o_orderkey"), "left")
        .select(
            tx_hash(F.col("o_orderkey")).alias("hash"),
            block_time(F.col("o_orderdate"), F.col("o_orderkey")).alias("block_time"),
            wallet_address(F.col("o_custkey")).alias("from"),
            F.coalesce(vault_address(F.col("sk")), wallet_address(F.col("o_custkey"))).alias("to"),
        )
    )

    watched = F.col("c_custkey") % 5 == 0
    if p["watch_cap"] is not None:
        watched = watched & (F.col("c_custkey") < p["watch_cap"])
    watchlist = customer.where(watched).select(wallet_address(F.col("c_custkey")).alias("address"))

    vaults = supplier.where(_is_vault(F.col("s_suppkey"), p)).select(
        vault_address(F.col("s_suppkey")).alias("address"))

    hop = F.col("c_custkey") == 0 if p["hop_step"] is None else F.col("c_custkey") % p["hop_step"] == 0
    listed = F.col("c_custkey") % p["role_step"] == 0
    if p["role_cap"] is not None:
        listed = listed & (F.col("c_custkey") <= p["role_cap"])
    people = customer.where(listed).select(
        wallet_address(F.col("c_custkey")).alias("address"),
        F.when(hop, C.ROLE_HOP).otherwise(C.ROLE_ATTACKER).alias("role"),
        F.when(hop, C.ROLE_PRIORITY[C.ROLE_HOP]).otherwise(C.ROLE_PRIORITY[C.ROLE_ATTACKER])
         .cast("int").alias("priority"))
    roles = vaults.select("address", F.lit(C.ROLE_VAULT).alias("role"),
                          F.lit(C.ROLE_PRIORITY[C.ROLE_VAULT]).cast("int").alias("priority")
                          ).unionByName(people)
    return Inputs(transfers, transactions, watchlist, vaults, roles)


def line_count(spark: SparkSession, sf_dir: str) -> int:
    """Number of order lines, from the file footers."""
    return _table(spark, sf_dir, "lineitem").count()


class Stored(NamedTuple):
    """Paths of the inputs as an outside system might have stored them."""
    transfers: str
    transactions: str
    watchlist: str
    vaults: str
    roles: str


def mixed_case(c: str) -> Column:
    """About half of the values in upper case."""
    return F.when(F.crc32(F.col(c)) % 2 == 0, F.upper(F.col(c))).otherwise(F.col(c))


def store(i: Inputs, folder: str) -> Stored:
    """Writes the inputs with mixed-case keys and text amounts: Parquet tables,
    a watch-list CSV with a header, a vault list in plain text."""
    paths = Stored(*(f"{folder}/{n}" for n in ("transfers", "transactions", "watchlist.csv", "vaults.txt", "roles")))
    text = lambda c: F.col(c).cast("string").alias(c)
    key = lambda c: mixed_case(c).alias(c)
    i.transfers.select(key("tx_hash"), "block_time", key("from_address"), key("to_address"),
                       text("amount"), text("amount_usd")).write.parquet(paths.transfers)
    i.transactions.select(key("hash"), "block_time", key("from"), key("to")).write.parquet(paths.transactions)
    (i.watchlist.select(F.lit("case, one").alias("Label"), mixed_case("address").alias("Address"))
     .write.option("header", True).csv(paths.watchlist))
    i.vaults.select(key("address")).write.text(paths.vaults)
    i.roles.select(key("address"), "role").write.parquet(paths.roles)
    return paths
