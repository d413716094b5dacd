"""Timeline and replay, re-aimed as batch queries.

P7, O1, A8-A10, W1-W6, T1-T7, F3, F4, F7.

The replay view consumes time-sorted events one by one and keeps running
state.  Here every piece of that state is a declarative query:

* state *at a time T* is a filter ``ts <= T`` plus an aggregation;
* state *after each event* is an ordered running aggregate
  (``operators.sequence.running``);
* state *on the 1001-position slider grid* never crosses events with grid
  points: each event gets its first grid position by integer arithmetic,
  events are grouped by that position (with partial aggregation) and prefix
  sums run over the grid rows, in blocks with carried offsets.

A time ``T`` can be given as epoch ms (number or Column) or as a slider
position ``position`` (0..n); positions use the exact integer rule
``(ts - start) * n <= position * span``.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config as C
from .. import functions as X
from .. import schema as S
from .graph import with_roles
from .sequence import plus, running
from .sizing import checked_broadcast

SEND_RANK, RECEIVE_RANK = 0, 1   # the sender is created before the receiver


# --- P7 / O1 ---------------------------------------------------------------------
def timeline(src: DataFrame, keep_untimed: bool = False) -> DataFrame:
    """Events ``from, to, amount, ts_ms, label, hash`` from actions or edges.

    ``amount`` stays exact (DECIMAL), at the 4 decimals the graph carries.
    Rows whose time cannot be read are dropped unless ``keep_untimed``.
    """
    if "amount_eth" in src.columns:          # edges
        time_col, dtype = "timestamp", src.schema["timestamp"].dataType
        out = src.select(F.col("from"), F.col("to"),
                         F.col("amount_eth").cast(C.MONEY_TYPE).alias("amount"),
                         X.parse_block_time(time_col, dtype).alias("ts_ms"),
                         F.col("label"), F.col("tx_hash").alias("hash"))
    else:                                    # actions
        dtype = src.schema["block_time"].dataType
        out = src.select(F.col("from_address").alias("from"), F.col("to_address").alias("to"),
                         F.bround(F.col("amount"), C.ETH_DECIMALS).cast(C.MONEY_TYPE).alias("amount"),
                         X.parse_block_time("block_time", dtype).alias("ts_ms"),
                         F.col("label"), F.col("tx_hash").alias("hash"))
    return out if keep_untimed else out.where(F.col("ts_ms").isNotNull())


def untimed_count(src: DataFrame) -> DataFrame:
    """Rows of actions/edges whose time cannot be read (kept out of the timeline)."""
    t = timeline(src, keep_untimed=True)
    return t.agg(F.sum(F.when(F.col("ts_ms").isNull(), 1).otherwise(0)).cast("bigint").alias("untimed"))


def event_order() -> list[Column]:
    """O1: the total order of events (time, then every field)."""
    return [F.col(c).asc_nulls_last() for c in S.EVENT_ORDER]


def timeline_order(tl: DataFrame) -> DataFrame:
    """O1: events sorted by time with a total tie-break (a global sort)."""
    return tl.orderBy(*event_order())


# --- F3, F4 --------------------------------------------------------------------
def is_exit(tl: DataFrame) -> DataFrame:
    """laundering exits only."""
    return tl.where(F.col("label") == C.LABEL_EXIT)


def _laundered(amount: str = "amount") -> Column:
    return F.when(F.col("label") == C.LABEL_EXIT, F.col(amount)).otherwise(F.lit(0).cast(C.MONEY_TYPE))


# --- A8: bounds ------------------------------------------------------------------
def time_bounds(tl: DataFrame) -> DataFrame:
    """``start_ms, end_ms, span_ms`` (span 0 counts as 1) and ``events``."""
    return tl.agg(F.min("ts_ms").alias("start_ms"), F.max("ts_ms").alias("end_ms"),
                  F.count(F.lit(1)).alias("events")).select(
        "start_ms", "end_ms",
        F.greatest(F.col("end_ms") - F.col("start_ms"), F.lit(1)).cast("bigint").alias("span_ms"),
        "events")


class Clock:
    """Start, end and span of a timeline.

    The bounds are one global aggregate (partial per task, one row to the
    driver), evaluated once and then used as literals, so a replay plan
    carries no repeated subqueries over the timeline, and as-of filters are
    plain ``ts_ms <= literal`` comparisons that reach the Parquet scan.
    """

    def __init__(self, tl: DataFrame):
        b = time_bounds(tl).first()
        self.empty = b is None or b.start_ms is None
        self.start_ms = None if self.empty else int(b.start_ms)
        self.end_ms = None if self.empty else int(b.end_ms)
        self.span_ms = 1 if self.empty else int(b.span_ms)
        lit = lambda v: F.lit(v).cast("bigint")
        self.start, self.end, self.span = lit(self.start_ms), lit(self.end_ms), lit(self.span_ms)

    def at(self, position: int, n: int = C.FRAME_COUNT) -> Column:
        """Clock time of slider position ``position`` (DOUBLE ms)."""
        return self.start + (F.lit(position).cast("bigint") * self.span) / F.lit(float(n))

    def last_ms(self, position: int, n: int = C.FRAME_COUNT) -> int | None:
        """Latest whole ms reached at ``position``: ``start + (position*span) // n``.

        For integer times, ``(ts - start) * n <= position * span`` holds
        exactly when ``ts <= last_ms``.
        """
        return None if self.empty else self.start_ms + (position * self.span_ms) // n

    def reached(self, position: int, n: int = C.FRAME_COUNT, ts: str = "ts_ms") -> Column:
        """``ts <= at(position)``, exactly, as a pushable literal comparison."""
        return F.col(ts) <= F.lit(self.last_ms(position, n)).cast("bigint")


def _time_filter(tl: DataFrame, t=None, position: int | None = None, n: int = C.FRAME_COUNT):
    if position is not None:
        return tl.where(Clock(tl).reached(position, n))
    t = F.lit(t) if not isinstance(t, Column) else t
    return tl.where(F.col("ts_ms") <= t)


def as_of(tl: DataFrame, t=None, position: int | None = None, n: int = C.FRAME_COUNT) -> DataFrame:
    """events with ``ts <= T`` (inclusive)."""
    return _time_filter(tl, t, position, n)


# --- A9, T2 ------------------------------------------------------------------------
def _attackers(nodes_df: DataFrame) -> DataFrame:
    return nodes_df.where(F.col("role") == C.ROLE_ATTACKER).select(F.col("id").alias("address"))


def _seen_wallets(tl: DataFrame, nodes_df: DataFrame) -> DataFrame:
    ends = tl.select(F.explode(F.array(F.col("from"), F.col("to"))).alias("address"))
    return ends.unionByName(_attackers(nodes_df)).where(F.col("address").isNotNull()).distinct()


def _totals(tl: DataFrame, nodes_df: DataFrame) -> DataFrame:
    n_wallets = _seen_wallets(tl, nodes_df).select(F.count(F.lit(1))).scalar()
    agg = tl.agg(F.count(F.lit(1)).alias("transfers"),
                 F.coalesce(F.sum("amount"), F.lit(0).cast(C.MONEY_TYPE)).alias("_eth"),
                 F.coalesce(F.sum(_laundered()), F.lit(0).cast(C.MONEY_TYPE)).alias("_laundered"))
    return totals_columns(agg, n_wallets)


def totals_columns(agg: DataFrame, n_wallets: Column) -> DataFrame:
    """The columns of A9 and T2 from ``transfers, _eth, _laundered`` and a wallet count."""
    return agg.select(
        n_wallets.cast("bigint").alias("wallets"), "transfers",
        F.col("_eth").cast("double").alias("eth"),
        F.col("_laundered").cast("double").alias("laundered"),
        X.round_whole("_eth").alias("eth_whole"),
        X.round_whole("_laundered").alias("laundered_whole"),
        X.whole_text("_eth").alias("eth_text"),
        X.whole_text("_laundered").alias("laundered_text"))


def flow_totals(tl: DataFrame, nodes_df: DataFrame) -> DataFrame:
    """Wallets, transfers, ETH moved, ETH laundered (also as whole-ETH text)."""
    return _totals(tl, nodes_df)


def totals_at(tl: DataFrame, nodes_df: DataFrame, t=None, position: int | None = None,
              n: int = C.FRAME_COUNT) -> DataFrame:
    """A9 over events up to T; wallets = seen by T plus all attackers."""
    return _totals(_time_filter(tl, t, position, n), nodes_df)


# --- A10, W1 ---------------------------------------------------------------------
def pair_counts(tl: DataFrame) -> DataFrame:
    """A10: transfers per unordered wallet pair."""
    return (tl.groupBy(X.pair_low("from", "to").alias("wallet_a"), X.pair_high("from", "to").alias("wallet_b"))
              .agg(F.count(F.lit(1)).alias("transfers"))
              .select("wallet_a", "wallet_b", F.concat_ws(":", "wallet_a", "wallet_b").alias("pair_key"),
                      "transfers"))


def pair_sequence(tl: DataFrame, strategy: str = "auto") -> DataFrame:
    """N-th transfer of its unordered pair (1-based) and its curvature."""
    keyed = tl.select("*", X.pair_key("from", "to").alias("pair_key"))
    out = running(keyed, S.EVENT_ORDER, ["pair_key"], seq="pair_seq", strategy=strategy)
    return out.withColumn("curvature", X.pair_curvature("pair_seq"))


# --- W2, W3 ---------------------------------------------------------------------
def global_sequence(tl: DataFrame, strategy: str = "auto") -> DataFrame:
    """0-based position in time order and its curvature."""
    out = running(tl, S.EVENT_ORDER, seq="_seq", strategy=strategy)
    return (out.withColumn("idx", (F.col("_seq") - 1).cast("bigint")).drop("_seq")
               .withColumn("curvature", X.global_curvature("idx")))


def running_totals(tl: DataFrame, strategy: str = "auto") -> DataFrame:
    """Tx number, cumulative ETH and cumulative laundered ETH after each event."""
    out = running(tl, S.EVENT_ORDER, seq="tx_number",
                  sums={"_cum_eth": F.col("amount"), "_cum_laundered": _laundered()},
                  strategy=strategy)
    return (out.withColumn("cum_eth", F.col("_cum_eth").cast("double"))
               .withColumn("cum_laundered", F.col("_cum_laundered").cast("double"))
               .drop("_cum_eth", "_cum_laundered"))


# --- W4 ---------------------------------------------------------------------------
def event_endpoints(tl: DataFrame) -> DataFrame:
    """Each event as two rows (sender first): ``address, side_rank`` + event fields."""
    side = lambda addr, rank: F.struct(F.col(addr).alias("address"), F.lit(rank).alias("side_rank"))
    return (tl.select("*", F.explode(F.array(side("from", SEND_RANK), side("to", RECEIVE_RANK))).alias("_e"))
              .select("_e.address", "_e.side_rank", *tl.columns))


def running_wallet_totals(tl: DataFrame, strategy: str = "auto") -> DataFrame:
    """Per wallet, its txns/sent/received after each of its events."""
    e = event_endpoints(tl).where(F.col("address").isNotNull())
    sent = F.col("side_rank") == SEND_RANK
    zero = F.lit(0).cast(C.MONEY_TYPE)
    out = running(e, [*S.EVENT_ORDER, "side_rank"], ["address"], seq="txns",
                  sums={"_sent": F.when(sent, F.col("amount")).otherwise(zero),
                        "_received": F.when(~sent, F.col("amount")).otherwise(zero)},
                  strategy=strategy)
    return (out.withColumn("sent", F.col("_sent").cast("double"))
               .withColumn("received", F.col("_received").cast("double"))
               .drop("_sent", "_received"))


# --- W5, W6 -----------------------------------------------------------------------
SIGHTING = [*S.EVENT_ORDER, "side_rank"]       # what orders first sightings


def leading_order() -> Column:
    """The leading part of the event order as one 64-bit number: its time, nulls last.

    Fixed width, so a ``min`` of it runs as a hash aggregate; it never
    contradicts the full order, and rows that agree in it are of one time.
    """
    return F.coalesce(F.col("ts_ms"), F.lit((1 << 63) - 1))


def _first_seen(tl: DataFrame, form: str = "packed") -> DataFrame:
    """Per wallet, the first (event order, side) it appears at: ``address`` and the SIGHTING columns.

    ``packed``: the least leading key per wallet by a hash aggregate, then the
    exact order among the rows that hold it (each task keeps one row per
    wallet before the exchange).  Both read one exchange of the distinct
    sides, so the source is scanned once.  ``struct``: one ``min`` of a
    struct, which Spark sorts both sides of every event for.
    """
    e = event_endpoints(tl).where(F.col("address").isNotNull())
    if form == "struct":
        key = F.struct(*[x for c in SIGHTING for x in (F.col(c).isNull().alias(f"no_{c}"), F.col(c))])
        return e.groupBy("address").agg(F.min(key).alias("f")).select("address", *[F.col(f"f.{c}") for c in SIGHTING])
    if form != "packed":
        raise ValueError(f"unknown form {form!r}")
    # naming _m keeps the distinct sides whole in both branches, so that they share its exchange
    e = e.groupBy("address", *SIGHTING).agg(F.count(F.lit(1)).alias("_m")).where(F.col("_m") > 0)
    least = e.groupBy(F.col("address").alias("_a")).agg(F.min(leading_order()).alias("_least"))
    rows = e.join(least, (F.col("address") == F.col("_a")) & (leading_order() == F.col("_least")))
    w = Window.partitionBy("address").orderBy(*[F.col(c).asc_nulls_last() for c in SIGHTING])
    return (rows.select("address", *SIGHTING, F.row_number().over(w).alias("_n")).where(F.col("_n") == 1)
            .select("address", *SIGHTING))


def first_appearance(tl: DataFrame, strategy: str = "auto", form: str = "packed") -> DataFrame:
    """Wallets in first-seen order: ``address, first_ts_ms, first_side, appearance``."""
    out = running(_first_seen(tl, form), SIGHTING, seq="_seq", strategy=strategy)
    return out.select("address", F.col("ts_ms").alias("first_ts_ms"),
                      F.when(F.col("side_rank") == SEND_RANK, "send").otherwise("receive").alias("first_side"),
                      (F.col("_seq") - 1).cast("bigint").alias("appearance"))


def lane_index(tl: DataFrame, nodes_df: DataFrame, strategy: str = "auto", form: str = "packed") -> DataFrame:
    """0-based order of each wallet inside its role lane.

    Wallets enter lanes in first-seen order; attackers are created before
    any event, so they form their lane up front (also ordered by first
    sighting); wallets never seen on the timeline come last, by address.
    """
    w = nodes_df.select(F.col("id").alias("address"), "role").join(_first_seen(tl, form), "address", "left")
    out = running(w, [*SIGHTING, "address"], ["role"], seq="_seq", strategy=strategy)
    return out.select("address", "role", (F.col("_seq") - 1).cast("bigint").alias("lane"))


# --- T1 ----------------------------------------------------------------------------
def snapshot(tl: DataFrame, nodes_df: DataFrame, t=None, position: int | None = None,
             n: int = C.FRAME_COUNT) -> DataFrame:
    """Per wallet txns/sent/received over events up to T; attackers always listed."""
    seen = _time_filter(tl, t, position, n)
    e = event_endpoints(seen).where(F.col("address").isNotNull())
    sent = F.col("side_rank") == SEND_RANK
    zero = F.lit(0).cast(C.MONEY_TYPE)
    rows = e.select("address", F.lit(1).alias("_one"),
                    F.coalesce(F.when(sent, F.col("amount")), zero).alias("_s"),
                    F.coalesce(F.when(~sent, F.col("amount")), zero).alias("_r"))
    att = _attackers(nodes_df).select("address", F.lit(0).alias("_one"), zero.alias("_s"), zero.alias("_r"))
    per = rows.unionByName(att).groupBy("address").agg(
        F.sum("_one").cast("bigint").alias("txns"),
        F.sum("_s").cast("double").alias("sent"),
        F.sum("_r").cast("double").alias("received"))
    return with_roles(per, nodes_df, ("address", "role")).select(
        "address", "role", "txns", "sent", "received")


# --- T3, T6 ----------------------------------------------------------------------
def _ceil_div(a: str, b: str) -> Column:
    """ceil(a / b) for a >= 0, b > 0, exact in integers (columns by name)."""
    return F.expr(f"({a} + {b} - 1) div {b}")


def frames(tl: DataFrame, nodes_df: DataFrame, n: int = C.FRAME_COUNT, clock: Clock | None = None) -> DataFrame:
    """T3 + T6: replay totals at every slider position 0..n.

    Per position: clock time, events consumed, ETH, laundered ETH, wallets
    visible (seen by then, plus all attackers from position 0) and transfers
    in flight (started, not yet 10 h old).

    Events become marks at the position that first reaches them (start and
    settle marks from one ``explode``), wallets a mark at their first
    sighting; marks and the empty grid are summed per position by one
    aggregation.  Prefix sums run in blocks of ``GRID_BLOCK`` positions, each
    a task of its own, and take the totals of the earlier blocks as offsets
    (a row per block), so a grid of any size is spread over the tasks.
    """
    if n < 1:
        raise ValueError("a grid has at least one step")
    spark = tl.sparkSession
    clock = clock or Clock(tl)
    zero = F.lit(0).cast(C.MONEY_TYPE)
    ev = tl.select(
        ((F.col("ts_ms") - clock.start) * F.lit(n).cast("bigint")).alias("_rel"),
        ((F.col("ts_ms") + F.lit(C.SETTLE_MS) - clock.start) * F.lit(n).cast("bigint")).alias("_rel_settle"),
        clock.span.alias("_span"), "amount", "label", "from", "to")
    ev = ev.select(_ceil_div("_rel", "_span").alias("frame"),
                   _ceil_div("_rel_settle", "_span").alias("settle"),
                   "amount", "label", "from", "to")

    def mark(frame, started=0, amount=zero, laundered=zero, settled=0, wallets=0):
        numbers = {"started": started, "settled": settled, "wallets": wallets}
        return [frame.cast("bigint").alias("frame"), *[F.lit(v).cast("bigint").alias(k) for k, v in numbers.items()],
                amount.alias("amount"), laundered.alias("laundered")]

    marks = ev.select(F.explode(F.array(
        F.struct(*mark(F.col("frame"), started=1, amount=F.col("amount"), laundered=_laundered())),
        F.struct(*mark(F.col("settle"), settled=1)))).alias("m")).select("m.*").where(F.col("frame") <= n)
    ends = ev.select("frame", F.explode(F.array(F.col("from"), F.col("to"))).alias("address"))
    ends = ends.unionByName(_attackers(nodes_df).select(F.lit(0).cast("bigint").alias("frame"), "address"))
    first = ends.where(F.col("address").isNotNull()).groupBy("address").agg(F.min("frame").alias("frame"))
    grid = spark.range(0, n + 1).select(*mark(F.col("id")))
    rows = marks.unionByName(first.select(*mark(F.col("frame"), wallets=1))).unionByName(grid)

    sums = {"started": T.LongType(), "settled": T.LongType(), "wallets": T.LongType(),
            "amount": T.DecimalType(38, 18), "laundered": T.DecimalType(38, 18)}
    per = rows.groupBy("frame").agg(*[F.sum(F.coalesce(F.col(c), F.lit(0).cast(t))).cast(t).alias(c) for c, t in sums.items()])
    per = per.withColumn("_block", F.expr(f"frame div {C.GRID_BLOCK}"))
    upto = Window.partitionBy("_block").orderBy("frame").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cum = per.select("frame", "_block", *[F.sum(c).over(upto).cast(t).alias(c) for c, t in sums.items()])
    if n >= C.GRID_BLOCK:
        before = Window.orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
        offsets = (per.groupBy(F.col("_block").alias("_at")).agg(*[F.sum(c).cast(t).alias(f"_{c}") for c, t in sums.items()])
                   .select("_at", *[F.coalesce(F.sum(f"_{c}").over(before).cast(t), F.lit(0).cast(t)).alias(f"_{c}")
                                    for c, t in sums.items()]))  # a row per block
        cum = cum.join(checked_broadcast(offsets), F.col("_block") == F.col("_at")).select(
            "frame", *[plus(F.col(c), F.col(f"_{c}"), t).alias(c) for c, t in sums.items()])
    return cum.select(
        "frame", (clock.start + (F.col("frame") * clock.span) / F.lit(float(n))).alias("t_ms"),
        F.col("started").alias("events"),
        F.col("amount").cast("double").alias("eth"),
        F.col("laundered").cast("double").alias("laundered"),
        "wallets", (F.col("started") - F.col("settled")).alias("in_flight"),
    )


def inflight_at(tl: DataFrame, nodes_df: DataFrame, n: int = C.FRAME_COUNT) -> DataFrame:
    """Transfers in flight at each slider position."""
    return frames(tl, nodes_df, n).select("frame", "t_ms", "in_flight")


# --- T4 -----------------------------------------------------------------------------
def activation(tl: DataFrame, nodes_df: DataFrame, mode: str = "play", clock: Clock | None = None) -> DataFrame:
    """T4: when each wallet becomes visible (epoch ms; null = never).

    attackers: at the start.  ``play``: first send, or first receipt plus
    the 10 h trip, whichever is earlier; the clock stops at the last event,
    so later values are null.  ``scrub``: first send or first receipt.
    """
    if mode not in ("play", "scrub"):
        raise ValueError("mode must be 'play' or 'scrub'")
    clock = clock or Clock(tl)
    delay = C.SETTLE_MS if mode == "play" else 0
    e = event_endpoints(tl).where(F.col("address").isNotNull())
    t = F.when(F.col("side_rank") == SEND_RANK, F.col("ts_ms")).otherwise(F.col("ts_ms") + F.lit(delay))
    first = e.groupBy("address").agg(F.min(t).alias("_t"))
    w = nodes_df.select(F.col("id").alias("address"), "role").join(first, "address", "left")
    visible = F.col("_t") if mode == "scrub" else F.when(F.col("_t") <= clock.end, F.col("_t"))
    return w.select("address", "role",
                    F.when(F.col("role") == C.ROLE_ATTACKER, clock.start).otherwise(visible)
                     .cast("bigint").alias("activation_ms"))


# --- T5, T7, F7 -------------------------------------------------------------------------
def transfer_state(tl: DataFrame, t=None, position: int | None = None, n: int = C.FRAME_COUNT) -> DataFrame:
    """T5: per event, trip progress at T (capped at 1) and pending/in_flight/settled."""
    if position is not None:
        t = Clock(tl).at(position, n)
    t = F.lit(t) if not isinstance(t, Column) else t
    p = X.transfer_progress(t, "ts_ms")
    return tl.select("hash", "from", "to", "ts_ms", "label", p.alias("progress"),
                     X.transfer_state(p).alias("state"))


def scrub_positions(tl: DataFrame) -> DataFrame:
    """Slider position of each event's time."""
    clock = Clock(tl)
    return tl.select("hash", "from", "to", "ts_ms",
                     X.scrub_position("ts_ms", clock.start, clock.span).alias("position"))


def transfer_detail(tl: DataFrame, tx_hash) -> DataFrame:
    """one transfer (all traces of a hash): from, to, amount, amount text (4 dp), hash.

    ``tx_hash`` is a text (lower-cased here) or a Column.
    """
    key = F.lit(tx_hash.lower()) if isinstance(tx_hash, str) else tx_hash
    return (tl.where(F.col("hash") == key)
              .select("from", "to", F.col("amount").cast("double").alias("amount"),
                      X.amount_text("amount", C.ETH_DECIMALS).alias("amount_text"), "hash", "ts_ms"))
