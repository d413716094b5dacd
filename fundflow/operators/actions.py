"""Action extraction: F1, F2, J1, P1-P3, U1.

``actions`` is the labelled union of
* mutual transfers: both ends on the watch-list (F1), and
* exit transfers: traces matching, on (tx hash, sender, receiver), a
  transaction that calls a vault (F2 + J1); one output row per matching
  transaction, as an inner join gives.

Default plan (``union``): one branch per label.  Each branch filters its
scan by the lists (``In`` filters reach Parquet while a list is short and
the keys are stored lower-case; semi-joins otherwise), so rows drop before
any exchange and only vault candidates enter the exit join.

Lists too long to broadcast filter their scan by a Bloom filter first.

``plan="single_scan"`` reads the transfer table once, flags every row and
left-joins pre-aggregated vault calls.  It gives the same bag; it pays when
the scan costs more than carrying mutual rows through the join.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from .. import schema as S
from .membership import Membership


def _membership(rel) -> Membership:
    return rel if isinstance(rel, Membership) else Membership(rel)


def with_label(df: DataFrame, label: str) -> DataFrame:
    """P1 + P2: constant label, canonical 7-column order."""
    return df.select(*S.TRANSFER_COLUMNS, F.lit(label).alias("label"))


def mutual_transfers(transfers: DataFrame, watchlist) -> DataFrame:
    """F1 (+P1, P2): transfers with both ends on the watch-list."""
    w = _membership(watchlist)
    return with_label(w.semi(transfers, "from_address", "to_address"), C.LABEL_MUTUAL)


def vault_calls(transactions: DataFrame, vaults) -> DataFrame:
    """transactions whose receiver is a vault (the sender is not restricted)."""
    return _membership(vaults).semi(transactions, "to")


def exit_transfers(transfers: DataFrame, transactions: DataFrame, vaults) -> DataFrame:
    """J1 (+P3, P1, P2): transfers matching a vault call on three keys.

    P3: the transaction side is cut to its three keys before the join, so
    the transfer's ``block_time`` is the one kept.
    """
    v = _membership(vaults)
    calls = vault_calls(transactions, v).select(
        F.col("hash").alias("_c_hash"), F.col("from").alias("_c_from"), F.col("to").alias("_c_to"))
    transfers = v.semi(transfers, "to_address")  # the join would drop the others later
    cond = ((F.col("tx_hash") == F.col("_c_hash")) & (F.col("from_address") == F.col("_c_from"))
            & (F.col("to_address") == F.col("_c_to")))
    return with_label(transfers.join(calls, cond, "inner"), C.LABEL_EXIT)


def actions(transfers: DataFrame, transactions: DataFrame, watchlist, vaults,
            plan: str = "union") -> DataFrame:
    """Mutual transfers plus exit transfers (bag union, 7 columns)."""
    w, v = _membership(watchlist), _membership(vaults)
    if plan == "union":
        return mutual_transfers(transfers, w).unionByName(exit_transfers(transfers, transactions, v))
    if plan != "single_scan":
        raise ValueError(f"unknown plan {plan!r}")

    if w.is_inlist and v.is_inlist:
        cand = transfers.where(
            (w.test("from_address") & w.test("to_address")) | v.test("to_address"))
        cand = cand.withColumn("_mutual", F.coalesce(
            w.test("from_address") & w.test("to_address"), F.lit(False)))
    else:
        cand = w.flag(transfers, "from_address", "_w_from")
        cand = w.flag(cand, "to_address", "_w_to")
        cand = v.flag(cand, "to_address", "_v_to")
        cand = (cand.where(F.col("_w_from") & F.col("_w_to") | F.col("_v_to"))
                    .withColumn("_mutual", F.col("_w_from") & F.col("_w_to")))

    calls = (vault_calls(transactions, v)
             .groupBy(F.col("hash").alias("_c_hash"), F.col("from").alias("_c_from"),
                      F.col("to").alias("_c_to"))
             .agg(F.count(F.lit(1)).alias("_n_calls")))
    cond = ((F.col("tx_hash") == F.col("_c_hash")) & (F.col("from_address") == F.col("_c_from"))
            & (F.col("to_address") == F.col("_c_to")))
    joined = cand.join(calls, cond, "left")
    labels = F.concat(
        F.when(F.col("_mutual"), F.array(F.lit(C.LABEL_MUTUAL))).otherwise(
            F.array().cast("array<string>")),
        F.array_repeat(F.lit(C.LABEL_EXIT), F.coalesce(F.col("_n_calls"), F.lit(0)).cast("int")),
    )
    return joined.select(*S.TRANSFER_COLUMNS, F.explode(labels).alias("label"))
