"""Whitening against a dense eigendecomposition in numpy, and edge cases."""

import math

import numpy as np
import pytest

from dialoglake.llm import whitening as W

SCHEMA = "vec_id long, embedding array<double>, component string, n string, x string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, "c", "n", "x") for i, v in rows], SCHEMA)


def plain(vectors):
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for v in vectors], dtype=object)
    n, sums = len(x), x.sum(0)
    deviation = [int(sum((n * a - s) ** 2 for a, s in zip(row, sums))) for row in x]
    a = np.array([[float(v) - float(s) / n for v, s in zip(row, sums)] for row in x])
    cov = a.T @ a / n
    e, v = np.linalg.eigh(cov)
    return n, deviation, a, e[::-1], v[:, ::-1], np.trace(cov)


def check(got, ids, vectors, most=32):
    n, deviation, a, e, v, trace = plain(vectors)
    k = min(most, int((e > 1e-12 * e[0]).sum()))
    assert len(got) == k * len(ids)
    by = {(r.vec_id, r.component): r for r in got}
    for c in range(k):
        w = np.array([by[i, c + 1].whitened for i in ids])
        assert abs(w @ w / n - 1) < 1e-9 and abs(w.mean()) < 1e-9
        assert all(abs(by[i, c + 1].explained - e[c] / trace) < 1e-9 * e[c] / trace for i in ids)
        apart = min((abs(e[c] - e[j]) for j in range(len(e)) if j != c), default=1.0)
        if apart > 1e-3 * e[0]:
            want = a @ v[:, c] / np.sqrt(e[c])
            assert min(np.abs(w - want).max(), np.abs(w + want).max()) < 1e-8
    for i, d in zip(ids, deviation):
        assert by[i, 1].deviation == d and by[i, 1].n == n
    assert all(r.identity_error < 1e-9 for r in got)


def test_against_eigh(spark):
    rng = np.random.default_rng(1)
    mix = rng.standard_normal((12, 12)) * np.linspace(1, 20, 12)
    vectors = (rng.standard_normal((300, 12)) @ mix / 10).tolist()
    check(W.whiten(table(spark, enumerate(vectors)).repartition(5)).collect(), range(300), vectors)
    check(W.whiten(table(spark, enumerate(vectors)), most=3).collect(), range(300), vectors, 3)


def test_equal_eigenvalues_and_lost_rank(spark):
    """Every point of a cube's corners: all eigenvalues are the same; one dimension is constant, one repeats another."""
    corners = [[float(i >> k & 1) for k in range(5)] for i in range(32)]
    vectors = [[*c, 3.0, c[0]] for c in corners]
    check(W.whiten(table(spark, enumerate(vectors))).collect(), range(32), vectors)


def test_rows_left_out(spark):
    nan, inf = float("nan"), float("inf")
    good = [[1.0, 2.0], [2.5, -1.0], [0.25, 7.0], [3.0, 3.5], [1.0, 2.0]]
    bad = [None, [1.0, None], [nan, 1.0], [inf, 1.0], [-inf, 0.0], [1e300, 0.0], [1.0], [], [1.0, 2.0, 3.0]]
    got = W.whiten(table(spark, [*enumerate(good), *((100 + k, v) for k, v in enumerate(bad))])).collect()
    check(got, range(5), good)
    assert W.whiten(table(spark, [])).collect() == []
    assert W.whiten(table(spark, [(1, [2.0, 3.0])] * 3)).collect() == []
    assert W.whiten(table(spark, [(1, [])])).collect() == []
    null_id = W.whiten(table(spark, [(None, [2.0, 3.0]), (None, [1.0, 7.0])])).collect()
    assert [r.vec_id for r in null_id] == [None, None] and {r.component for r in null_id} == {1}


def test_deviation_beyond_long_is_null_and_large_sums_are_exact(spark):
    rows = [(k, [float(k % 3) * 2**44, 1.0]) for k in range(6)]
    got = W.whiten(table(spark, rows)).collect()
    assert {r.deviation for r in got if r.vec_id % 3 != 1} == {None}
    x = W.whole_numbers(table(spark, rows), 64, 1_000_000, "vec_id", "embedding")
    n, sums = W.column_sums(x)
    assert n == 6 and sums == [sum((k % 3) * 2**50 + 1_000_000 for k in range(6)), 6 * 1_000_064]


@pytest.mark.parametrize("seed", range(4))
def test_bidiagonal_matrix_of_dense_products(seed):
    rng = np.random.default_rng(seed)
    a = rng.standard_normal((40, 9)) * (10.0 ** -np.arange(9))
    v, b = W.bidiagonalise(9, lambda q, w: ((a @ q) @ (a @ q), (a @ w).T @ (a @ q), a.T @ (a @ q)), 9)
    assert np.abs(v.T @ v - np.eye(9)).max() < 1e-12
    s, want = np.linalg.svd(b)[1], np.linalg.svd(a)[1]
    assert (np.abs(s - want) < 1e-9 * want[0]).all() and (np.abs(s - want) < 1e-6 * want)[:5].all()
    assert not np.tril(b, -1).any() and not np.triu(b, 2).any()


def test_end_by_convergence():
    rng = np.random.default_rng(9)
    d = W.FULL + 40
    a = rng.standard_normal((60, d))
    a[:, :3] *= np.array([100, 60, 30])
    steps = []
    v, b = W.bidiagonalise(d, lambda q, w: (steps.append(1), ((a @ q) @ (a @ q), (a @ w).T @ (a @ q), a.T @ (a @ q)))[1], 3)
    assert len(b) < 62 and (np.abs(np.linalg.svd(b)[1][:3] - np.linalg.svd(a)[1][:3]) < 1e-8).all()
