"""List membership as a relation, with the strategy chosen by checked size.

* up to ``INLIST_MAX`` values: an IN-set literal, so the test is pushed into
  the Parquet scan (``PushedFilters: In``) and needs no join;
* up to ``BROADCAST_MAX_ROWS`` rows and ``BROADCAST_MAX_BYTES`` bytes: a
  broadcast hash join (semi or flag);
* beyond: a shuffled join, picked by Catalyst/AQE.  A Bloom filter of the
  list (``operators.bloom``) drops most non-members in the scan's stage, so
  they never reach the exchange.

A strategy forced on a longer list raises instead of cutting the list or
broadcasting it.  The size check is one aggregate (a row per task).
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from .bloom import Bloom
from .sizing import Size, size_of


class Membership:
    def __init__(self, relation: DataFrame, column: str = "address",
                 inlist_max: int | None = None, broadcast_max: int | None = None,
                 mode: str = "auto"):
        if mode not in ("auto", "inlist", "broadcast", "shuffle"):
            raise ValueError(f"unknown mode {mode!r}")
        inlist_max = C.INLIST_MAX if inlist_max is None else inlist_max
        self.relation = relation.select(F.lower(F.col(column)).alias("address")).where(
            F.col("address").isNotNull())
        self.values: list[str] | None = None
        size: Size = size_of(self.relation)
        small = size.rows <= broadcast_max and size.bytes <= C.BROADCAST_MAX_BYTES if broadcast_max is not None else size.broadcastable
        if mode == "inlist" and size.rows > inlist_max:
            raise ValueError(f"the list has more than {inlist_max} values; use mode 'broadcast', "
                             "'shuffle' or 'auto'")
        if mode == "broadcast" and not small:
            raise ValueError(f"a list of {size.rows} rows and {size.bytes} bytes is too large to broadcast; "
                             "use mode 'shuffle' or 'auto'")
        if mode == "auto":
            mode = "inlist" if size.rows <= inlist_max else "broadcast" if small else "shuffle"
        self.mode = mode
        if mode == "inlist":
            self.values = sorted({r[0] for r in self.relation.collect()})  # at most inlist_max rows
            return
        self.relation = self.relation.dropDuplicates(["address"])
        self.bloom = Bloom(self.relation, "address", size.rows) if mode == "shuffle" else None

    # -- column form (IN-set only) -------------------------------------------
    @property
    def is_inlist(self) -> bool:
        return self.mode == "inlist"

    def test(self, col) -> Column:
        if not self.is_inlist:
            raise ValueError("column test needs an IN-list membership")
        c = F.col(col) if isinstance(col, str) else col
        return c.isin(self.values) if self.values else F.lit(False)

    def _side(self) -> DataFrame:
        # One shape for every use, so a list tested on two columns is
        # broadcast once (Spark reuses the identical exchange).
        side = self.relation.select(F.col("address").alias("_m_key"), F.lit(True).alias("_m_hit"))
        return F.broadcast(side) if self.mode == "broadcast" else side

    # -- relational forms ----------------------------------------------------
    def semi(self, df: DataFrame, *columns: str) -> DataFrame:
        """Rows of ``df`` whose ``columns`` are all in the list.

        IN-sets, broadcast lists and Bloom filters are predicates (a list as
        an IN subquery, planned as a semi-join): Catalyst moves a predicate
        below projections that compute and below joins, where it moves no
        semi-join.  The exact join of a list too long to broadcast stays
        where it is, so only rows that are left by then are exchanged for it.
        """
        if self.mode == "shuffle":
            df = self.bloom.keep(df, *columns)  # all columns before the first exchange
        for col in columns:
            if self.is_inlist:
                df = df.where(self.test(col))
            elif self.mode == "broadcast":
                df = df.where(F.col(col).isin(self._side().select("_m_key")))
            else:
                side = self._side()
                df = df.join(side, F.col(col) == side["_m_key"], "left_semi")
        return df

    def flag(self, df: DataFrame, col: str, name: str) -> DataFrame:
        """``df`` plus a boolean column ``name`` = (``col`` in the list)."""
        if self.is_inlist:
            return df.withColumn(name, F.coalesce(self.test(col), F.lit(False)))
        side = self._side()
        joined = df.join(side, F.col(col) == side["_m_key"], "left")
        return (joined.withColumn(name, F.coalesce(side["_m_hit"], F.lit(False)))
                      .drop(side["_m_key"]).drop(side["_m_hit"]))
