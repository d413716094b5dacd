"""Column expressions (scalar functions X1-X13, F8, P4, P5).

Everything here returns a ``pyspark.sql.Column`` built from built-in
functions, so it stays inside whole-stage codegen; there is no Python UDF.

Conventions:
* money is exact ``DECIMAL(38,18)`` while summed and rounded, and becomes
  ``DOUBLE`` only at the output;
* per-row display maths (weights, progress) is done in ``DOUBLE``, as the
  replay view does;
* nothing depends on the session time zone: times are epoch milliseconds
  (``BIGINT``) or ``TIMESTAMP_NTZ`` values read as UTC.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config as C

__all__ = [
    "lower_key", "money", "parse_block_time", "ms_to_ntz", "block_time_text",
    "classify", "short_address", "address_tag", "role_title", "role_legend",
    "pair_key", "pair_low", "pair_high", "edge_weight", "pair_curvature",
    "global_curvature", "round_money", "round_whole", "whole_text",
    "amount_text", "labelled_amount", "time_text", "scrub_position",
    "transfer_progress", "transfer_state", "as_column",
]


def as_column(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- P5: keys are compared lower-cased --------------------------------------
def lower_key(c) -> Column:
    return F.lower(as_column(c))


# --- P4: amounts to the canonical exact type --------------------------------
def money(c, data_type: T.DataType | None = None, safe: bool = False) -> Column:
    """Cast an amount column to ``DECIMAL(38,18)``.

    Floating NaN becomes null (a pandas sum skips it); text that does not
    parse raises under ANSI mode unless ``safe`` (then null).
    """
    col = as_column(c)
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        col = F.when(F.isnan(col), F.lit(None)).otherwise(col)
    if isinstance(data_type, T.StringType):
        col = F.when(F.lower(F.trim(col)) == "nan", F.lit(None)).otherwise(F.trim(col))
    return col.try_cast(C.MONEY_TYPE) if safe else col.cast(C.MONEY_TYPE)


# --- X12: block time text -> epoch milliseconds -----------------------------
_EPOCH_NTZ = "1970-01-01 00:00:00"
# date, hours and minutes, seconds, fraction, zone
_TIME_TEXT = (r"^(\d{4}-\d\d-\d\d)(?:[T ](\d\d:\d\d)(:\d\d)?(?:[.](\d{1,9}))?"
              r"\s*((?i:UTC|GMT|Z)|[+-]\d\d:?\d\d)?)?$")


def parse_block_time(c, data_type: T.DataType | None = None) -> Column:
    """Epoch ms of a block time; null when it cannot be read.

    Text is a date, or a date and a time parted by a blank or ``T``; seconds
    and a fraction of 1 to 9 digits (cut to ms) are optional, and so is a zone
    (``UTC``, ``GMT``, ``Z`` or an offset).  Without a zone, text and
    timestamps are taken as UTC; the session zone never matters.
    """
    col = as_column(c)
    if isinstance(data_type, T.TimestampNTZType):
        return F.timestamp_diff("MILLISECOND", F.to_timestamp_ntz(F.lit(_EPOCH_NTZ)), col)
    if isinstance(data_type, T.TimestampType):
        return F.unix_millis(col)
    if isinstance(data_type, T.DateType):
        return F.timestamp_diff("MILLISECOND", F.to_timestamp_ntz(F.lit(_EPOCH_NTZ)),
                                col.cast("timestamp_ntz"))
    text = F.trim(col)
    part = lambda k: F.regexp_extract(text, _TIME_TEXT, k)
    zone = F.regexp_replace(F.upper(part(5)), r"^(?:UTC|GMT|Z)?$", "+00:00")
    clock = F.concat(part(1), F.lit(" "), F.coalesce(F.nullif(part(2), F.lit("")), F.lit("00:00")),
                     F.coalesce(F.nullif(part(3), F.lit("")), F.lit(":00")), F.lit("."),
                     F.rpad(part(4), 3, "0"), F.regexp_replace(zone, r"^([+-]\d\d)(\d\d)$", "$1:$2"))
    # the canonical form (and named zones) by one parse; only other texts go through the patterns
    return F.unix_millis(F.coalesce(
        F.try_to_timestamp(text, F.lit(C.BLOCK_TIME_PATTERN)),
        F.when(text.rlike(_TIME_TEXT), F.try_to_timestamp(clock, F.lit("yyyy-MM-dd HH:mm:ss.SSSXXX")))))


def ms_to_ntz(ms) -> Column:
    """Epoch ms -> TIMESTAMP_NTZ holding the UTC wall time."""
    return F.timestamp_add("MILLISECOND", as_column(ms),
                           F.to_timestamp_ntz(F.lit(_EPOCH_NTZ)))


def block_time_text(ms) -> Column:
    """Epoch ms -> ``yyyy-MM-dd HH:mm:ss.SSS UTC`` (the canonical text form)."""
    return F.concat(F.date_format(ms_to_ntz(ms), "yyyy-MM-dd HH:mm:ss.SSS"), F.lit(" UTC"))


# --- X1: role classification (literal sets or joined flags; J3 is the relational form) -----
def classify(address, attackers=(), vaults=(), hops=()) -> Column:
    """First match wins: attacker, then vault, then hop, else the default.

    Each list is literal addresses, or a boolean column that says whether
    the address is listed (for a list of any size, joined before).
    """
    a = lower_key(address)
    out = None
    for values, role in ((attackers, C.ROLE_ATTACKER), (vaults, C.ROLE_VAULT), (hops, C.ROLE_HOP)):
        if isinstance(values, Column):
            cond = values
        elif values:
            cond = a.isin([x.lower() for x in values])
        else:
            continue
        out = F.when(cond, role) if out is None else out.when(cond, role)
    return F.lit(C.ROLE_DEFAULT) if out is None else out.otherwise(C.ROLE_DEFAULT)


# --- X2, X3: address abbreviations ------------------------------------------
def short_address(address) -> Column:
    a = as_column(address)
    return F.concat(F.substring(a, 1, C.SHORT_HEAD), F.lit(C.SHORT_SEP),
                    F.right(a, F.lit(C.SHORT_TAIL)))


def address_tag(address) -> Column:
    return F.concat(F.substring(as_column(address), 1, C.TAG_HEAD), F.lit(C.TAG_SUFFIX))


# --- X4, X5: role texts -------------------------------------------------------
def _role_text(role, mapping: dict[str, str], upper_all: bool) -> Column:
    r = as_column(role)
    out = None
    for key, text in mapping.items():
        out = F.when(r == key, text) if out is None else out.when(r == key, text)
    out = out.otherwise(F.upper(r))
    return F.upper(out) if upper_all else out


def role_title(role) -> Column:
    return _role_text(role, C.ROLE_TITLE, upper_all=False)


def role_legend(role) -> Column:
    return _role_text(role, C.ROLE_LEGEND, upper_all=True)


# --- X6: unordered pair -------------------------------------------------------
def pair_low(a, b) -> Column:
    return F.least(as_column(a), as_column(b))


def pair_high(a, b) -> Column:
    return F.greatest(as_column(a), as_column(b))


def pair_key(a, b) -> Column:
    """Both ends sorted (byte order, as for hex text) and joined by ':'."""
    return F.concat_ws(":", pair_low(a, b), pair_high(a, b))


# --- X7, X8: edge drawing numbers --------------------------------------------
def edge_weight(amount) -> Column:
    x = as_column(amount).cast("double")
    return F.least(F.lit(C.WEIGHT_BASE) + x / F.lit(C.WEIGHT_DIVISOR), F.lit(C.WEIGHT_CAP))


def pair_curvature(n) -> Column:
    return (F.lit(C.PAIR_CURVE_BASE)
            + (as_column(n).cast("bigint") * C.PAIR_CURVE_STEP) % C.PAIR_CURVE_MOD).cast("bigint")


def global_curvature(idx) -> Column:
    return (F.lit(C.GLOBAL_CURVE_BASE)
            + (as_column(idx).cast("bigint") * C.GLOBAL_CURVE_STEP) % C.GLOBAL_CURVE_MOD).cast("bigint")


# --- X9, X10, X11, F8: rounding and money text --------------------------------
def round_money(x, decimals: int) -> Column:
    """Exact half-even rounding of a decimal amount, returned as DOUBLE."""
    return F.bround(as_column(x).cast(C.MONEY_TYPE), decimals).cast("double")


def round_whole(x) -> Column:
    """Half-up rounding to an integer (``Math.round`` for non-negative x)."""
    return F.floor(as_column(x).cast("double") + F.lit(0.5)).cast("bigint")


def whole_text(x) -> Column:
    """Half-up whole number with thousands separators."""
    return F.format_number(round_whole(x), 0)


def amount_text(x, decimals: int = 2) -> Column:
    """Fixed-decimals text with the unit, rounded half-up on the exact value."""
    d = F.round(as_column(x).cast(C.MONEY_TYPE), decimals).cast(f"decimal(38,{decimals})")
    return F.concat(d.cast("string"), F.lit(" ETH"))


def labelled_amount(amount, decimals: int = 2) -> Column:
    """Label text only for amounts above the display threshold."""
    a = as_column(amount)
    return F.when(a > F.lit(C.LABEL_MIN_AMOUNT), amount_text(a, decimals))


# --- X13: short UTC time text -------------------------------------------------
def time_text(ms) -> Column:
    """``Mon DD HH:MM`` in UTC, from parts (no locale, no session zone)."""
    t = ms_to_ntz(ms)
    months = F.array(*[F.lit(m) for m in C.MONTH_ABBR])
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return F.concat(F.element_at(months, F.month(t)), F.lit(" "), two(F.dayofmonth(t)),
                    F.lit(" "), two(F.hour(t)), F.lit(":"), two(F.minute(t)))


# --- T5, T7: replay clock maths ----------------------------------------------
def scrub_position(t_ms, start_ms, span_ms) -> Column:
    """Slider position 0..FRAME_COUNT of a clock time (half-up rounding)."""
    pct = (as_column(t_ms).cast("double") - as_column(start_ms).cast("double")) / as_column(span_ms).cast("double")
    return F.floor(pct * F.lit(float(C.FRAME_COUNT)) + F.lit(0.5)).cast("bigint")


def transfer_progress(t_ms, ts_ms) -> Column:
    """Share of the 10 h trip done at clock time ``t_ms``, capped at 1."""
    return F.least(F.lit(1.0), (as_column(t_ms).cast("double") - as_column(ts_ms).cast("double"))
                   / F.lit(float(C.SETTLE_MS)))


def transfer_state(progress) -> Column:
    p = as_column(progress)
    return (F.when(p < 0, "pending").when(p < 1, "in_flight").otherwise("settled"))
