import math
from fractions import Fraction

import numpy as np
import pytest

from fundflow.llm import whitening as W

SF01 = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<float>, label int"


def matrix(values, seed=0):
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))
    return (q * np.array(values, float)) @ q.T


SPECTRA = [
    list(np.linspace(1, 40, 40)), list(2.0 ** np.arange(30)), [5.0] * 10 + [1.0] * 20, [0.0] * 20 + [3.0, 7.0],
    [1e6] + list(np.linspace(1, 1.001, 30)), [1e-9 * i for i in range(1, 25)], [2.0], [0.0] * 5, [9.0] * 17 + [9.0 + 1e-7] * 3]


@pytest.mark.parametrize("values", SPECTRA)
def test_components_are_the_largest_eigenpairs(values):
    v = matrix(values)
    got, vectors = W.components(v)
    top = max(values)
    want = sorted((x for x in values if x > 1e-12 * top), reverse=True)[:16]
    assert np.allclose(got, want, rtol=1e-9, atol=1e-13 * top) and len(got) == len(want)
    assert np.abs(vectors.T @ vectors - np.eye(len(got))).max(initial=0) < 1e-12
    assert np.abs(v @ vectors - vectors * got).max(initial=0) <= 1e-11 * max(top, 1e-300)


def test_inertia_counts_eigenvalues():
    for values in SPECTRA:
        v = matrix(values)
        real = np.linalg.eigvalsh(v)
        for s in np.random.default_rng(1).uniform(-1, max(values) + 1, 20):
            assert W.above(v, s) == (real > s).sum()


def brute(rows):
    """Plain Python and numpy's eigensolver."""
    width = max((len(v) for _, v in rows if v is not None), default=0)
    valid = [(i, [math.floor(64 * c) + 1000000 for c in v] + [1000000] * (width - len(v))) for i, v in rows
             if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in valid})
    n = len(fit)
    s = [sum(x[j] for x in fit) for j in range(width)]
    centred = np.array([[float(Fraction(n * x[j] - s[j], n)) for j in range(width)] for x in fit])
    cov = centred.T @ centred / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1][:16], u[:, ::-1][:, :16]
    return valid, n, s, e, u, np.trace(cov)


def compare(out, rows):
    valid, n, s, e, u, trace = brute(rows)
    k = int((e > 1e-12 * e[0]).sum())
    assert len(out) == len(valid) * k
    got = sorted(((r.vec_id if r.vec_id is not None else -1, r.deviation, r.component, r) for r in out), key=lambda t: t[:3])
    want = sorted(((i if i is not None else -1, sum((n * x - t) ** 2 for x, t in zip(v, s)), c + 1,
                    np.array([float(Fraction(n * x - t, n)) for x, t in zip(v, s)]) @ u[:, c] / math.sqrt(e[c]), c)
                   for i, v in valid for c in range(k)), key=lambda t: t[:3])
    sign = {}
    for (i, d, c, r), (j, dev, comp, w, col) in zip(got, want):
        assert (i, d, c) == (j, dev, comp) and r.n == n
        assert abs(r.explained - e[col] / trace) <= 1e-9 * r.explained and r.identity_error < 1e-6
        if abs(w) > 1e-6:
            assert sign.setdefault(c, np.sign(w) * np.sign(r.whitened)) == np.sign(w) * np.sign(r.whitened)
        assert abs(abs(r.whitened) - abs(w)) < 1e-5


def test_awkward_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(c)) for c in rng.normal(size=7) * [9, 6, 4, 2.5, 1.5, 1, .6]]) for i in range(60)]
    rows += [(100, None), (101, [1.0, None]), (102, [math.nan] * 7), (103, [math.inf]), (104, []), (105, [2.0]),
             (None, rows[3][1]), (3, rows[3][1]), (106, rows[4][1]), (107, [1e3] * 7)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], SCHEMA).repartition(3)
    for c in ("vector", "x", "n", "component"):
        df = df.withColumn(c, W.F.lit("clash"))
    compare(W.whiten(df).collect(), rows)


def test_no_rows_and_no_variance(spark):
    for rows in ([], [(1, None, 1)], [(1, [], 1)], [(1, [1.0, 2.0], 1)] * 3):
        out = W.whiten(spark.createDataFrame(rows, SCHEMA))
        assert out.count() == 0 and out.columns[:2] == ["vec_id", "component"]


def test_deviation_is_exact_or_null():
    x = np.array([[10**6, -3], [0, 0]])
    assert W.deviations(10**9, x, [7, 8]) == [None, 7 * 7 + 8 * 8]
    assert W.deviations(10**4, x, [7, 8]) == [(10**10 - 7) ** 2 + (3 * 10**4 + 8) ** 2 if (10**10 - 7) ** 2 < 2**63 else None, 113]
    big = W.unpack(W.pack(np.array([[1 << 40, 2], [5, 6]])), 2)
    assert big.tolist() == [[1 << 40, 2], [5, 6]]


def test_whole_table_equals_brute_force(spark):
    df = spark.read.parquet(f"{SF01}/embeddings.parquet")
    compare(W.whitening_query(spark, df).collect(), [(r.vec_id, r.embedding) for r in df.collect()])
