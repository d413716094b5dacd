"""Embedding whitening: principal components by FEAST contour integration.

Every entry c becomes the whole number ``floor(64 c) + 1000000`` and each
distinct vector counts once (the fit list).  Spark makes the fit list, its
sums, its covariance V (entries are centred before they are multiplied) and
the whitened rows; only sums of the size of V, which doesn't grow with the
rows, reach the driver.

Components.  V's largest eigenvalues are enclosed in intervals by inertia:
the signs of the pivots of a symmetric factorisation of V - sI count the
eigenvalues above s.  Per interval a random block is filtered by quadrature
of complex shifted solves (zI - V)^-1 Y around the interval and Rayleigh-Ritz
extracts eigenpairs, repeated until their residuals are at rounding level.  A
last Rayleigh-Ritz over all intervals makes them orthonormal, and an inertia
count at the smallest one verifies that none is missed.

Defined results: a row whose vector is null or holds a null or non-finite
entry is left out, of the fit as of the result; a vector shorter than the
longest counts as filled up with zeros; an entry beyond 2**52 / 64 counts as
that; directions without variance are no components, so fewer than asked for
may come back, and none for an empty table or equal vectors; repeated rows
are returned each; a null id is kept; a deviation beyond the range of a long
is null; other columns are ignored.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

SCALE, SHIFT = 64, 1_000_000
MOST_ENTRY = float(1 << 52)
COMPONENTS = 16
#: Quadrature nodes on the upper half of a contour, and rounds of filtering.
NODES, ROUNDS = 8, 40
#: Eigenvalues an interval should hold at most, and the ratio of its ends.
PER_INTERVAL, RATIO = 4, 3.0
_EPS = float(np.finfo(float).eps)


# --- rows to whole numbers -------------------------------------------------------
def entries(column, width: int) -> tuple[np.ndarray, np.ndarray]:
    """``(kept, x)`` of an Arrow list column: which rows are valid, and their entries less SHIFT."""
    import pyarrow.compute as pc
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    kept = lengths >= 0
    lengths = np.maximum(lengths, 0)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(float)  # a null entry reads as NaN
    rows = np.repeat(np.arange(len(lengths)), lengths)
    kept[rows[~np.isfinite(values)]] = False
    place = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    good = kept[rows]
    x = np.zeros((len(lengths), width), np.int64)
    x[rows[good], place[good]] = np.clip(np.floor(values[good] * SCALE), -MOST_ENTRY, MOST_ENTRY).astype(np.int64)
    return kept, x[kept]


def pack(x: np.ndarray) -> list[bytes]:
    """One key per vector: entries as 16-bit numbers if all of them fit, else as 64-bit ones."""
    small = (np.abs(x) < 1 << 15).all(1)
    short, long = x.astype("<i2"), x.astype("<i8")
    return [(short if s else long)[i].tobytes() for i, s in enumerate(small)]


def unpack(keys: list[bytes], width: int) -> np.ndarray:
    return np.array([np.frombuffer(k, "<i2" if len(k) == 2 * width else "<i8") for k in keys], np.int64).reshape(len(keys), width)


def fit_list(rows: DataFrame, width: int) -> DataFrame:
    """Each distinct vector once, as ``x``; copies meet within the tasks first."""
    def run(parts):
        import pyarrow as pa
        for b in parts:
            yield pa.RecordBatch.from_arrays([pa.array(pack(entries(b.column("vector"), width)[1]), pa.binary())], ["x"])

    return written(rows.select("vector").mapInArrow(run, "x binary").distinct(), "fit-list")


# --- sums over the fit list ---------------------------------------------------------
_HALF = 1 << 26


def sums(fit: DataFrame, width: int) -> tuple[int, list[int]]:
    """``(n, sums)``: vectors, and exact sums (less SHIFT) per dimension."""
    def run(parts):
        import pyarrow as pa
        n, high, low = 0, np.zeros(width, np.int64), np.zeros(width, np.int64)
        for b in parts:
            x = unpack(b.column("x").to_pylist(), width)
            n += len(x)
            high += (x // _HALF).sum(0)
            low += (x % _HALF).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(np.full(width, n)), pa.array(high), pa.array(low)],
                                         ["i", "n", "high", "low"])

    found = {r.i: r for r in fit.mapInArrow(run, "i long, n long, high long, low long").groupBy("i")
             .agg(*[F.sum(c).alias(c) for c in ("n", "high", "low")]).collect()}  # a row per dimension
    return (found[0].n if found else 0), [found[i].high * _HALF + found[i].low if found else 0 for i in range(width)]


def products(fit: DataFrame, width: int, move: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """Sum of y y' over the fit list, y = ``move(x)`` with ``size`` entries; size**2 numbers reach the driver."""
    def run(parts):
        import pyarrow as pa
        total = np.zeros((size, size))
        for b in parts:
            y = move(unpack(b.column("x").to_pylist(), width))
            total += y.T @ y
        i, j = np.triu_indices(size)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total[i, j])], ["i", "j", "v"])

    out = np.zeros((size, size))
    for r in fit.mapInArrow(run, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[r.i, r.j] = out[r.j, r.i] = r.v
    return out


# --- FEAST -----------------------------------------------------------------------------
def above(matrix: np.ndarray, shift: float) -> int:
    """Eigenvalues above ``shift``: positive pivots of a symmetric factorisation (1x1 and 2x2 pivots)."""
    a = matrix - shift * np.eye(len(matrix))
    count, alpha = 0, (1 + 17 ** 0.5) / 8
    while len(a):
        size = np.abs(a)
        own = np.diagonal(size).copy()
        np.fill_diagonal(size, -1.0)
        i, (p, q) = int(own.argmax()), divmod(int(size.argmax()), len(a))
        if own[i] >= alpha * size[p, q]:
            if own[i] == 0:
                break
            chosen = [i]
            count += a[i, i] > 0
        else:  # a 2x2 pivot has one eigenvalue of either sign
            chosen = [p, q]
            count += 1
        rest = np.delete(np.arange(len(a)), chosen)
        side = a[np.ix_(rest, chosen)]
        a = a[np.ix_(rest, rest)] - side @ np.linalg.solve(a[np.ix_(chosen, chosen)], side.T)
    return int(count)


def intervals(matrix: np.ndarray, most: int) -> list[tuple[float, float, int]]:
    """``(low, high, count)``: disjoint intervals that hold the ``most`` largest eigenvalues, or all above rounding."""
    top = float(np.abs(matrix).sum(1).max()) * (1 + 4 * _EPS)
    low, high = 4 * len(matrix) * _EPS * top, top
    wanted = min(most, above(matrix, low)) if top > 0 else 0
    if not wanted:
        return []
    inside = above(matrix, low)
    while inside > wanted and high - low > 1e-12 * top:
        middle = (low * high) ** 0.5 if high > 2 * low else (low + high) / 2
        n = above(matrix, middle)
        if n >= wanted:
            low, inside = middle, n
        else:
            high = middle
    out, todo = [], [(low, top, inside, 0)]
    while todo:
        a, b, n, depth = todo.pop()
        if not n:
            continue
        if depth > 60 or (n <= PER_INTERVAL and b <= RATIO * a) or b - a <= 1e-9 * b:
            out.append((a, b, n))
            continue
        middle = (a * b) ** 0.5
        right = above(matrix, middle) - above(matrix, b)
        todo += [(a, middle, n - right, depth + 1), (middle, b, right, depth + 1)]
    return out


def feast(matrix: np.ndarray, low: float, high: float, count: int, seed: int = 1) -> np.ndarray:
    """Eigenvectors of the ``count`` eigenvalues in ``(low, high]``, and of what lies close by, as columns."""
    d, norm = len(matrix), float(np.abs(matrix).sum(1).max())
    at, weight = np.polynomial.legendre.leggauss(NODES)
    angle, weight = np.pi * (at + 1) / 2, weight / 2
    centre, radius = (low + high) / 2, (high - low) / 2 * (1 + 1e-6)
    turns = radius * np.exp(1j * angle)
    size = min(d, 2 * count + 8)
    while True:
        block = np.random.default_rng(seed).standard_normal((d, size))
        least = np.inf
        for _ in range(ROUNDS):
            filtered = np.zeros((d, size))
            for turn, w in zip(turns, weight):
                filtered += (w * turn * np.linalg.solve((centre + turn) * np.eye(d) - matrix, block.astype(complex))).real
            base, _ = np.linalg.qr(filtered)
            values, inner = np.linalg.eigh(base.T @ matrix @ base)  # Rayleigh-Ritz
            block = base @ inner
            found = (values > low - 1e-9 * high) & (values <= high * (1 + 1e-9))
            residual = np.linalg.norm(matrix @ block[:, found] - block[:, found] * values[found], axis=0).max(initial=0.0)
            if found.sum() >= count and (residual <= 8 * _EPS * norm or residual > 0.5 * least and residual <= 1e-11 * norm):
                return block[:, found]
            least = min(least, residual) if found.sum() >= count else np.inf
        if size == d:
            raise RuntimeError(f"no convergence on ({low}, {high}]")
        size = min(d, 2 * size)


def components(matrix: np.ndarray, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """``(values, vectors)`` of the largest eigenvalues, falling; vectors are columns."""
    found = [feast(matrix, *i) for i in intervals(matrix, most)]
    if not found:
        return np.zeros(0), np.zeros((len(matrix), 0))
    u, s, _ = np.linalg.svd(np.hstack(found), full_matrices=False)
    base = u[:, s > 1e-3]  # a vector that two intervals gave is one direction
    values, inner = np.linalg.eigh(base.T @ matrix @ base)
    order = np.argsort(-values)
    values, vectors = values[order], base @ inner[:, order]
    keep = min(most, sum(n for _, _, n in intervals(matrix, most)), len(values))
    bound = values[keep - 1] * (1 - 1e-9)
    if above(matrix, bound) != int((values > bound).sum()):
        raise RuntimeError("the inertia count finds eigenvalues that the contours missed")
    return values[:keep], vectors[:, :keep]


# --- the operator -------------------------------------------------------------------------
def deviations(n: int, centred: np.ndarray, rest: list[int]) -> list[int | None]:
    """Exact sums of ``(n * centred - rest)**2`` per row; null beyond a long."""
    width = len(rest)
    widest = n * int(np.abs(centred).max(initial=0)) + max(map(abs, rest), default=0)
    if widest * widest * max(width, 1) < 1 << 63:
        return ((n * centred - np.array(rest, np.int64)) ** 2).sum(1).tolist()
    exact = ((centred.astype(object) * n - np.array(rest, object)) ** 2).sum(1).tolist()
    return [v if v < 1 << 63 else None for v in exact]


def whiten(rows: DataFrame, id_column: str = "vec_id", column: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """Per valid row and component: ``vec_id, component, n, deviation, whitened, explained, identity_error``."""
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = rows.select(F.col(id_column).cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("vector"))
    width = rows.agg(F.max(F.size("vector"))).first()[0] or 0
    fit = fit_list(rows, width) if width > 0 else None
    n, total = sums(fit, width) if fit is not None else (0, [])
    if not n:
        return rows.sparkSession.createDataFrame([], schema)
    middle = [(2 * s + n) // (2 * n) for s in total]           # the whole number next to the mean
    rest = [s - n * m for s, m in zip(total, middle)]
    whole, part = np.array(middle, np.int64), np.array([r / n for r in rest])
    covariance = products(fit, width, lambda x: (x - whole) - part, width) / n
    values, vectors = components(covariance, most)
    k, trace = len(values), float(np.trace(covariance))
    if not k:
        return rows.sparkSession.createDataFrame([], schema)
    scaled = vectors / np.sqrt(values)
    seen = products(fit, width, lambda x: np.column_stack([((x - whole) - part) @ scaled, np.ones(len(x))]), k + 1) / n
    error = float(np.abs(seen[:k, :k] - np.outer(seen[:k, k], seen[:k, k]) - np.eye(k)).max())

    def run(parts) -> Iterator:
        import pyarrow as pa
        for b in parts:
            kept, x = entries(b.column("vector"), width)
            if not len(x):
                continue
            centred = x - whole
            ids = b.column("vec_id").filter(pa.array(kept)).take(pa.array(np.repeat(np.arange(len(x)), k)))
            far = pa.array(deviations(n, centred, rest), pa.int64()).take(pa.array(np.repeat(np.arange(len(x)), k)))
            m = len(x) * k
            yield pa.RecordBatch.from_arrays([
                ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(m, n, np.int64)), far,
                pa.array(((centred - part) @ scaled).ravel()), pa.array(np.tile(values / trace, len(x))), pa.array(np.full(m, error))],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, schema)


def whitening_query(spark: SparkSession, vectors: DataFrame) -> DataFrame:
    """op11: every valid row of ``embeddings`` and up to COMPONENTS components."""
    return whiten(vectors)
