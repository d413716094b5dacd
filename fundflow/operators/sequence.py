"""Ordered running aggregates: position and running sums per row.

``running(df, order_by, partition_by, sums)`` adds, for every row, its
1-based position in ``order_by`` order (ascending, nulls last) within its
``partition_by`` group and the inclusive running sum of each expression in
``sums`` (null counts as 0).  It is the engine under W1-W6.

Two physical strategies give the same result; one count chooses:

``window``
    a plain ``Window.partitionBy(...).orderBy(...)`` up to
    ``LOCAL_WINDOW_MAX_ROWS`` rows.

``ranged``
    for any size and any key skew (also the global order, which is one
    group):

    1. equal rows are counted as one row and its number, with partial counts
       before the exchange, so a run of repeated rows is no hot task;
    2. splitters, taken once from a sample of about ``SPLITTER_SAMPLES`` rows
       per bucket, become a literal; a row's bucket is the number of
       splitters at or below its whole composite key (group, order, then
       every other column), found by binary search.  That is a function of
       the row alone, so a recomputed task sends every row to the same
       bucket and nothing has to be frozen or written;
    3. a local window per (bucket, group).  Buckets split a group that holds
       a third of all rows, since the order columns are part of the key;
    4. only groups that a splitter cuts need an offset: totals of the groups
       at either end of each bucket (at most 2 x buckets rows), summed over
       the earlier buckets, are broadcast with that proven bound.  Rows and
       totals read the same exchange of step 1, so the source is scanned once;
    5. a row and its number become that many rows again, in pieces.

Running sums of decimals are exact up to 10**(37 - scale).
"""
from __future__ import annotations

import json
from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config as C
from ..session import default_parallelism


def running(df: DataFrame, order_by: Sequence[str], partition_by: Sequence[str] = (),
            sums: dict[str, Column] | None = None, seq: str = "seq",
            strategy: str = "auto", partitions: int | None = None) -> DataFrame:
    """``df`` plus ``seq`` (BIGINT, 1-based) and one running sum per ``sums`` entry.

    ``partitions`` is the number of buckets of the ranged strategy (chosen by
    the number of rows unless given).
    """
    # a null counts as 0 in a running sum, in either strategy
    sums = {name: F.coalesce(e, F.lit(0)) for name, e in (sums or {}).items()}
    order_by, partition_by = list(order_by), list(partition_by)
    if strategy not in ("auto", "window", "ranged"):
        raise ValueError(f"unknown strategy {strategy!r}")
    rows = None if strategy == "window" else df.count()
    if strategy == "window" or strategy == "auto" and rows <= C.LOCAL_WINDOW_MAX_ROWS:
        return _window(df, order_by, partition_by, sums, seq)
    buckets = partitions or max(default_parallelism(df.sparkSession), -(-rows // C.RANGED_ROWS_PER_PARTITION))
    return _ranged(df, order_by, partition_by, sums, seq, buckets, rows)


def _ascending(names: Sequence[str]) -> list[Column]:
    return [F.col(c).asc_nulls_last() for c in names]


def _window(df, order_by, partition_by, sums, seq):
    w = Window.partitionBy(*partition_by).orderBy(*_ascending(order_by))
    frame = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.select("*", F.row_number().over(w).cast("bigint").alias(seq),
                     *[F.sum(e).over(frame).alias(name) for name, e in sums.items()])


# --- exact arithmetic ---------------------------------------------------------------
def plus(a: Column, b: Column, dtype: T.DataType) -> Column:
    """a + b; the sum of two wide decimals would lose its last digit."""
    if isinstance(dtype, T.DecimalType):
        narrow = T.DecimalType(min(dtype.precision, 37), dtype.scale)
        a, b = a.cast(narrow), b.cast(narrow)
    return (a + b).cast(dtype)


def _times(v: Column, k: Column, dtype: T.DataType) -> Column:
    """v * k for a whole k; decimals by their whole and broken parts, so that no digit is lost."""
    if not isinstance(dtype, T.DecimalType):
        return F.when(k == 1, v).otherwise(v * k).cast(dtype)
    count = k.cast("decimal(15,0)")
    whole = F.when(v >= 0, F.floor(v)).otherwise(F.ceil(v))
    exact = plus((whole * count).cast(dtype), ((v % F.lit(1).cast("decimal(1,0)")) * count).cast(dtype), dtype)
    return F.when(k == 1, v.cast(dtype)).otherwise(exact)


# --- splitters and buckets ------------------------------------------------------------
def composite_key(names: Sequence[str]) -> Column:
    """The columns as one struct that sorts like them, ascending with nulls last."""
    return F.struct(*[x for i, c in enumerate(names) for x in (F.col(c).isNull().alias(f"n{i}"), F.col(c).alias(f"v{i}"))])


def _rank(key: Sequence) -> tuple:
    """A key's place in Spark's order, for Python's sort."""
    return tuple(0 if v is None else v for v in key)


def _literal(keys: list, dtype: T.StructType) -> Column:
    """Keys as one array literal (folded from JSON, so the plan holds one value and not an expression per field)."""
    for f in dtype.fields:
        if not isinstance(f.dataType, (T.StringType, T.IntegralType, T.DecimalType, T.DoubleType, T.BooleanType)):
            raise ValueError(f"rows can't be split on a column of type {f.dataType.simpleString()}")
    rows = [{f.name: str(v) if isinstance(v, Decimal) else v for f, v in zip(dtype.fields, key) if v is not None} for key in keys]
    return F.from_json(F.lit(json.dumps(rows)), T.ArrayType(dtype))


def splitters(df: DataFrame, names: Sequence[str], buckets: int, rows: int) -> tuple[list, Column]:
    """Distinct keys that cut ``df`` into about ``buckets`` parts of like size: as rows, and as a literal array.

    The sample is bounded: about ``SPLITTER_SAMPLES`` rows per bucket reach the driver.
    """
    keys = df.select(composite_key(names).alias("k"))
    wanted = C.SPLITTER_SAMPLES * buckets
    sample = keys.sample(min(1.0, wanted / rows), 7) if rows > wanted else keys
    found = sorted({_rank(r.k): r.k for r in sample.collect()}.items())
    at = sorted({i * len(found) // buckets for i in range(1, buckets)} - {0})
    cuts = [found[i][1] for i in at if i < len(found)]
    return cuts, _literal(cuts, keys.schema["k"].dataType)


def bucket_of(key: Column, cuts: list, literal: Column) -> Column:
    """Number of splitters at or below ``key``, by binary search."""
    if not cuts:
        return F.lit(0)
    steps = [1 << i for i in reversed(range(len(cuts).bit_length()))]
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda low, step: F.when(
        F.coalesce(F.get(literal, low + step - 1) <= key, F.lit(False)), low + step).otherwise(low))


def _ranged(df, order_by, partition_by, sums, seq, buckets, rows):
    columns = df.columns
    names = partition_by + [c for c in order_by if c not in partition_by]
    names += [c for c in columns if c not in names]
    plain = _window(df.limit(0), order_by, partition_by, sums, seq).schema
    dtype = {name: plain[name].dataType for name in sums}

    cuts, literal = splitters(df, names, buckets, rows) if rows else ([], None)
    distinct = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_m"))
    m = F.col("_m")
    rows_ = distinct.select("*", bucket_of(composite_key(names), cuts, literal).alias("_b"),
                            *[e.cast(dtype[name]).alias(f"_v_{name}") for name, e in sums.items()],
                            *[_times(e, m, dtype[name]).alias(f"_t_{name}") for name, e in sums.items()])

    w = Window.partitionBy("_b", *partition_by).orderBy(*_ascending(c for c in names if c not in partition_by))
    frame = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = rows_.select("*", F.sum("_m").over(frame).alias("_n"),
                         *[F.sum(f"_t_{name}").over(frame).cast(dtype[name]).alias(f"_r_{name}") for name in sums])
    if cuts:
        # groups at the ends of a bucket: the only ones that another bucket may hold too
        def cut_at(i: Column) -> Column:
            cut = F.get(literal, i)
            same = [F.col(c).eqNullSafe(cut[f"v{k}"]) for k, c in enumerate(partition_by)]
            out = cut.isNotNull()
            for s in same:
                out = out & s
            return out

        # naming _m keeps the filter above step 1, so that both branches share its exchange
        ends = rows_.where(cut_at(F.col("_b") - 1) | cut_at(F.col("_b")) | (m < 1)).groupBy("_b", *partition_by).agg(
            F.sum("_m").alias("_n"), *[F.sum(f"_t_{name}").cast(dtype[name]).alias(f"_t_{name}") for name in sums])
        earlier = Window.partitionBy(*partition_by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        offsets = ends.select(F.col("_b").alias("_ob"), *[F.col(c).alias(f"_k{k}") for k, c in enumerate(partition_by)],
                              F.sum("_n").over(earlier).alias("_on"),
                              *[F.sum(f"_t_{name}").over(earlier).cast(dtype[name]).alias(f"_o_{name}") for name in sums])
        on = F.col("_b") == F.col("_ob")
        for k, c in enumerate(partition_by):
            on = on & F.col(c).eqNullSafe(F.col(f"_k{k}"))
        local = local.join(F.broadcast(offsets), on, "left")  # at most 2 x buckets rows

    none = F.lit(None)
    off = {name: F.coalesce(F.col(f"_o_{name}") if cuts else none, F.lit(0).cast(dtype[name])) for name in sums}
    local = local.select(
        *columns, "_m", *[f"_v_{name}" for name in sums],
        (F.col("_n") - m + F.coalesce(F.col("_on") if cuts else none, F.lit(0))).alias("_start"),
        *[plus(plus(F.col(f"_r_{name}"), -F.col(f"_t_{name}"), dtype[name]), off[name], dtype[name]).alias(f"_s_{name}")
          for name in sums])
    piece = F.lit(C.REPEATS_PER_PIECE)
    pieces = local.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((m - 1) / piece))).alias("_p"))
    out = pieces.select("*", F.explode(F.sequence(F.col("_p") * piece + 1, F.least(m, (F.col("_p") + 1) * piece))).alias("_i"))
    i = F.col("_i")
    return out.select(*columns, (F.col("_start") + i).cast("bigint").alias(seq),
                      *[plus(F.col(f"_s_{name}"), _times(F.col(f"_v_{name}"), i, dtype[name]), dtype[name]).alias(name)
                        for name in sums])
