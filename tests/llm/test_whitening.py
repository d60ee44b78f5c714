"""Whitening against exact sums and the whole covariance's eigenvectors."""

import math
from fractions import Fraction

import numpy as np
import pytest

from parlance.llm.queries import queries
from parlance.llm.whitening import centred, fit, identity_error, whiten

COLUMNS = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def table(spark, vectors, ids=None, kind="double"):
    rows = [(i, None if v is None else [None if x is None else float(x) for x in v], "clash") for i, v in zip(ids or range(len(vectors)), vectors)]
    return spark.createDataFrame(rows, f"vec_id bigint, embedding array<{kind}>, whitened string")


def brute(vectors):
    """Remaining vectors' integers, exact deviations, and the covariance."""
    kept = [v for v in vectors if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dims = max(map(len, kept), default=0)
    x = [[math.floor(64 * v[j]) + 1_000_000 if j < len(v) else 1_000_000 for j in range(dims)] for v in kept]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(r, sums)) for r in x]
    c = np.array([[float(Fraction(n * a - s, n)) for a, s in zip(r, sums)] for r in x]).reshape(n, dims)
    return c, deviation, c.T @ c / max(n, 1)


def compare(spark, vectors, basis, df, most=32):
    c, deviation, v = brute(vectors)
    values, turn = np.linalg.eigh(v)
    values, turn = values[::-1][:most], turn[:, ::-1][:, :most]
    k = len(basis.variances)
    assert k == (values > 1e-11 * max(values.max(initial=0), 1e-300)).sum()
    assert np.allclose(basis.variances, values[:k], rtol=1e-9) and np.allclose(basis.explained, values[:k] / np.trace(v), rtol=1e-9)
    rows = whiten(df, basis).collect()
    assert sorted(r.deviation for r in rows) == sorted(deviation)
    got = np.array([r.whitened for r in rows]).reshape(len(rows), k)
    apart = np.concatenate([np.diff(values[: k + 1]), [-np.inf]])
    for j in range(k):
        if min(abs(apart[j]), abs(apart[j - 1]) if j else np.inf) > 1e-3 * values[0]:
            want = c @ turn[:, j] / math.sqrt(values[j])
            sign = np.sign(want @ np.sort(want)) or 1
            a, b = np.sort(got[:, j]), np.sort(want)
            assert min(np.abs(a - b).max(), np.abs(a + b[::-1]).max()) < 1e-7, (j, sign)
    assert np.abs(got.T @ got / len(got) - np.eye(k)).max() < 1e-6 and identity_error(df, basis) < 1e-6


def test_residuals_end_the_passes_where_variances_fall(spark):
    rng = np.random.default_rng(1)
    vectors = (rng.standard_normal((600, 120)) * 300 * 0.25 ** np.arange(120)).tolist()
    df = table(spark, vectors)
    basis = fit(df, most=5, spare=8, passes=4)
    assert basis.span == 13 and basis.residual <= 1e-12
    compare(spark, vectors, basis, df, 5)


def test_full_dimension_where_variances_are_alike(spark):
    rng = np.random.default_rng(2)
    vectors = rng.standard_normal((700, 90)).astype(np.float32).tolist()
    df = table(spark, vectors)
    basis = fit(df)
    assert basis.span == 90 and basis.passes == 7
    compare(spark, vectors, basis, df)
    one = fit(df, most=90, spare=0)
    assert one.passes == 1 and np.allclose(one.variances[:32], basis.variances)


@pytest.mark.parametrize("seed", range(3))
def test_awkward_vectors(spark, seed):
    rng = np.random.default_rng(seed)
    vectors = [rng.standard_normal(rng.integers(1, 9)).tolist() for _ in range(60)] + [[1.5, -2.5]] * 40
    vectors += [None, [], [None, 1.0], [float("nan")], [float("inf"), 0.0], [1.0, float("-inf")], [0.0] * 8]
    df = table(spark, vectors, ids=[None if k % 9 == 0 else k % 30 for k in range(len(vectors))])
    compare(spark, vectors, fit(df), df)


@pytest.mark.parametrize("vectors", [[], [None], [[]], [[1.0, 2.0]], [[1.0, 2.0]] * 7, [[float("nan")]]])
def test_tables_without_variance(spark, vectors, tmp_path):
    df = table(spark, vectors)
    basis = fit(df)
    assert basis.components.shape[1] == 0 and identity_error(df, basis) == 0
    rows = whiten(df, basis).collect()
    assert [(r.deviation, r.whitened) for r in rows] == [(0, [])] * sum(v is not None and v != [] and v[0] == v[0] or v == [] for v in vectors)
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries()["op12_whitening"](spark, str(tmp_path))
    assert got.columns == COLUMNS and got.count() == 0


def test_huge_entries_stay_exact_or_null():
    x = np.array([[1 << 40, 5], [-(1 << 40), 6], [3, 7]], np.int64)
    sums = [int(s) for s in x.sum(axis=0)]
    c, deviation = centred(x, 3, sums)
    exact = [sum((3 * int(a) - s) ** 2 for a, s in zip(r, sums)) for r in x]
    assert deviation == [s if s < 1 << 63 else None for s in exact] and deviation[0] is None and deviation[2] is not None
    assert np.allclose(c, x - np.array(sums) / 3)
    x = np.array([[1 << 52], [0]], np.int64)
    assert centred(np.repeat(x, 2000, axis=0), 4000, [2000 << 52])[1] == [None] * 4000


def test_query(spark, tmp_path):
    rng = np.random.default_rng(7)
    vectors = [*rng.standard_normal((300, 40)).tolist(), None, [3.0] * 40, [float("nan")] * 40]
    table(spark, vectors).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries()["op12_whitening"](spark, str(tmp_path)).toPandas()
    assert list(got.columns) == COLUMNS and len(got) == 301 * 32 and set(got.n) == {301} and got.identity_error.nunique() == 1
    assert got.identity_error.max() < 1e-4 and sorted(set(got.component)) == list(range(1, 33))
    assert got.groupby("component").explained.nunique().eq(1).all() and got.explained.sum() <= 301 + 1e-6
