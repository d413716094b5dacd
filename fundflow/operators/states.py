"""Timeline store: as-of questions from periodic states plus a delta.

A view that moves through time keeps its state and applies the events since.
Stored, that is

``events/period=P``   the events of each period (days by default), sorted by
                      time within a file;
``states/state=S``    per wallet, its transfers, sent and received before
                      period S x ``every`` (MOST_STATES of them at most, so
                      the states take a bounded multiple of the wallets);
``totals``            transfers, amount and laundered amount before each
                      state: a row per state.

At time T a query reads the last state before T and the events of the periods
from there up to T; the manifest names the periods, so no other folder is
listed or read.  The store is one committed version (``sources.versions``): a job
that dies while it writes leaves the former store readable.

Events without a time aren't stored.  Null amounts count as zero in a state,
null addresses are no wallets.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import config as C
from .. import schema as S
from ..sources import versions
from . import replay as R
from .graph import with_roles

DAY_MS = 86_400_000
MOST_STATES = 16


def _zero() -> Column:
    return F.lit(0).cast(C.MONEY_TYPE)


def _sides(tl: DataFrame) -> DataFrame:
    """``address, sent, received`` per side of an event; a null amount is zero."""
    e = R.event_endpoints(tl).where(F.col("address").isNotNull())
    amount, out = F.coalesce("amount", _zero()), F.col("side_rank") == R.SEND_RANK
    return e.select("*", F.when(out, amount).otherwise(_zero()).alias("sent"), F.when(out, _zero()).otherwise(amount).alias("received"))


def _sums(rows: DataFrame, *keys: str) -> DataFrame:
    """Sums that stay as exact as the money type."""
    return rows.groupBy(*keys).agg(F.sum("txns").cast("bigint").alias("txns"),
                                   *[F.sum(c).cast(C.MONEY_TYPE).alias(c) for c in ("sent", "received")])


def write_store(tl: DataFrame, path: str, width_ms: int = DAY_MS, most_states: int = MOST_STATES, keep: int = 2) -> "TimelineStore":
    """Writes the store of a timeline as a new version below ``path``."""
    spark = tl.sparkSession
    clock = R.Clock(tl)
    first = 0 if clock.empty else clock.start_ms // width_ms
    last = 0 if clock.empty else clock.end_ms // width_ms
    every = -(-(last - first + 1) // most_states)

    def write(folder: str) -> None:
        timed = tl.where(F.col("ts_ms").isNotNull()).withColumn("period", F.expr(f"cast(floor(ts_ms / {width_ms}) as bigint)"))
        # range partitions by time: a period's events lie in few files, a busy period in several
        (timed.repartitionByRange("ts_ms", "hash").sortWithinPartitions("period", *S.EVENT_ORDER)
         .write.partitionBy("period").parquet(f"{folder}/events"))
        events = spark.read.schema(timed.schema).parquet(f"{folder}/events")
        at = F.floor((F.col("period") - first) / every).cast("bigint") + 1  # the first state that counts the event
        per = _sums(_sides(events.withColumn("state", at)).withColumn("txns", F.lit(1)), "address", "state")
        w = Window.partitionBy("address").orderBy("state")  # at most a row per state
        upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        until = F.coalesce(F.lead("state").over(w) - 1, F.lit((last - first) // every))
        held = per.select("address", F.sum("txns").over(upto).alias("txns"),
                          *[F.sum(c).over(upto).cast(C.MONEY_TYPE).alias(c) for c in ("sent", "received")],
                          F.col("state").alias("from_state"), until.alias("until"))
        held = held.where("from_state <= until").withColumn("state", F.explode(F.sequence("from_state", "until"))).drop("from_state", "until")
        held.write.partitionBy("state").parquet(f"{folder}/states")
        totals = events.withColumn("state", at).groupBy("state").agg(
            F.count(F.lit(1)).alias("transfers"), F.sum(F.coalesce("amount", _zero())).cast(C.MONEY_TYPE).alias("eth"),
            F.sum(F.coalesce(R._laundered(), _zero())).cast(C.MONEY_TYPE).alias("laundered"))
        totals.coalesce(1).write.parquet(f"{folder}/totals")  # a row per state
        # the periods that have events (at most the days between first and last)
        facts["periods"] = sorted(r.period for r in events.select("period").distinct().collect())

    facts = dict(width_ms=width_ms, every=every, first=first, last=last, start_ms=clock.start_ms, end_ms=clock.end_ms)
    versions.write_version(spark, path, write, keep, facts)
    return open_store(spark, path)


def open_store(spark: SparkSession, path: str) -> "TimelineStore":
    """The newest committed store below ``path``."""
    folder, facts = versions.current(spark, path), versions.facts(spark, path)
    if folder is None:
        raise FileNotFoundError(f"no committed timeline store below {path}")
    return TimelineStore(spark, folder, *[facts[k] for k in ("width_ms", "every", "first", "last", "start_ms", "end_ms")],
                         tuple(facts["periods"]))


_EVENTS = "`from` string, `to` string, amount decimal(38,18), ts_ms bigint, label string, hash string, period bigint"
_STATES = "address string, txns bigint, sent decimal(38,18), received decimal(38,18), state bigint"
_TOTALS = "state bigint, transfers bigint, eth decimal(38,18), laundered decimal(38,18)"


@dataclass(frozen=True)
class TimelineStore:
    spark: SparkSession
    folder: str
    width_ms: int
    every: int
    first: int
    last: int
    start_ms: int | None
    end_ms: int | None
    periods: tuple[int, ...]

    # --- places in time -----------------------------------------------------
    def time_at(self, position: int, n: int = C.FRAME_COUNT) -> int:
        """Latest whole ms reached at a slider position."""
        return 0 if self.start_ms is None else self.start_ms + position * max(self.end_ms - self.start_ms, 1) // n

    def state_before(self, t: int) -> int:
        """The last stored state that counts no event after ``t``; 0 stands for the empty one."""
        return min(max(t // self.width_ms - self.first, 0), self.last - self.first) // self.every

    # --- tables ----------------------------------------------------------------
    def _parts(self, name: str, schema: str, folders: list[str]) -> DataFrame:
        """Some partitions of a table; only their folders are listed."""
        base = f"{self.folder}/{name}"
        found = [f"{base}/{f}" for f in folders]
        if not found:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", base).parquet(*found)

    def events(self, first: int | None = None, last: int | None = None) -> DataFrame:
        """Events of the periods from ``first`` to ``last``."""
        return self._parts("events", _EVENTS, [f"period={p}" for p in self.periods
                                               if (first is None or p >= first) and (last is None or p <= last)])

    def as_of(self, t: int) -> DataFrame:
        """events up to ``t``; only the files of the periods up to then are read."""
        return self.events(last=t // self.width_ms).where(F.col("ts_ms") <= t).drop("period")

    def delta(self, t: int) -> DataFrame:
        """Events after the last state and up to ``t``; only the files of those periods are read."""
        since = self.first + self.state_before(t) * self.every
        return self.events(since, t // self.width_ms).where(F.col("ts_ms") <= t).drop("period")

    def state(self, t: int) -> DataFrame:
        """``address, txns, sent, received`` of the last stored state before ``t``."""
        name = f"state={self.state_before(t)}"
        there = versions.exists(self.spark, f"{self.folder}/states/{name}")
        return self._parts("states", _STATES, [name] if there else []).drop("state")

    # --- T1, T2 ------------------------------------------------------------------
    def snapshot(self, t: int, nodes: DataFrame) -> DataFrame:
        """Per wallet txns, sent and received over events up to ``t``; attackers are always listed."""
        delta = _sides(self.delta(t)).select("address", F.lit(1).cast("bigint").alias("txns"), "sent", "received")
        attackers = R._attackers(nodes).select("address", F.lit(0).cast("bigint").alias("txns"), _zero().alias("sent"), _zero().alias("received"))
        per = _sums(self.state(t).unionByName(delta).unionByName(attackers), "address")
        per = per.select("address", "txns", F.col("sent").cast("double").alias("sent"), F.col("received").cast("double").alias("received"))
        return with_roles(per, nodes, ("address", "role")).select("address", "role", "txns", "sent", "received")

    def totals(self, t: int, nodes: DataFrame) -> DataFrame:
        """Wallets seen by ``t`` (all attackers included), transfers and amounts up to ``t``."""
        delta = self.delta(t)
        seen = (self.state(t).select("address").unionByName(_sides(delta).select("address")).unionByName(R._attackers(nodes))
                .where(F.col("address").isNotNull()).distinct())
        stored = self.spark.read.schema(_TOTALS).parquet(f"{self.folder}/totals").where(F.col("state") <= self.state_before(t))
        rows = stored.drop("state").unionByName(delta.agg(
            F.count(F.lit(1)).alias("transfers"), F.sum(F.coalesce("amount", _zero())).cast(C.MONEY_TYPE).alias("eth"),
            F.sum(F.coalesce(R._laundered(), _zero())).cast(C.MONEY_TYPE).alias("laundered")))
        agg = rows.agg(F.coalesce(F.sum("transfers"), F.lit(0)).cast("bigint").alias("transfers"),
                       *[F.coalesce(F.sum(c).cast(C.MONEY_TYPE), _zero()).alias(f"_{c}") for c in ("eth", "laundered")])
        return R.totals_columns(agg, seen.select(F.count(F.lit(1))).scalar())
