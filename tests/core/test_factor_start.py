"""Sparse singular pairs, the non-negative start and the stop rule against NumPy."""

from __future__ import annotations

import numpy as np
import pytest

from loamstat.operators import factor


def table(seed: int, n: int, m: int) -> np.ndarray:
    """Sparse and of rank 6: sums of sparse outer products."""
    rng = np.random.default_rng(seed)
    some = lambda k: rng.random((6, k)) * (rng.random((6, k)) < 0.4)
    return some(n).T @ (some(m) * np.array([20, 9, 5, 3, 2, 1])[:, None])


def cells_of(spark, x):
    i, j = np.nonzero(x)
    return spark.createDataFrame([(int(a), int(b), float(x[a, b])) for a, b in zip(i, j, strict=True)], "i long, j long, value double").repartition(4)


def dense(df, key, value, n, k):
    out = np.zeros((n, k))
    for r in df.collect():
        out[r[key], r["k"]] = r[value]
    return out


def start(x, rank):
    """The double SVD start on dense arrays."""
    u, s, vt = np.linalg.svd(x, full_matrices=False)
    w, h = np.zeros((x.shape[0], rank)), np.zeros((x.shape[1], rank))
    for c in range(rank):
        a, b = u[:, c], vt[c]
        if c == 0:
            w[:, 0], h[:, 0] = np.sqrt(s[0]) * np.abs(a), np.sqrt(s[0]) * np.abs(b)
            continue
        parts = [(np.maximum(sign * a, 0), np.maximum(sign * b, 0)) for sign in (1, -1)]
        p, q = max(parts, key=lambda t: np.linalg.norm(t[0]) * np.linalg.norm(t[1]))
        size = np.sqrt(s[c] * np.linalg.norm(p) * np.linalg.norm(q))
        w[:, c], h[:, c] = size * p / np.linalg.norm(p), size * q / np.linalg.norm(q)
    return w, h


def test_singular_triplets_and_start(spark):
    x = table(1, 60, 18)
    left, right, values = factor.sparse_svd(cells_of(spark, x), 4)
    u, s, vt = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(values, s[:4], rtol=1e-10)
    for df, key, want in ((left, "i", u[:, :4]), (right, "j", vt[:4].T)):
        got = np.zeros(want.shape)
        for r in df.collect():
            got[r[key]] = list(r)[1:]
        assert np.abs(np.abs((got * want).sum(0)) - 1).max() < 1e-9
    w, h = factor.nndsvd(cells_of(spark, x), 4)
    want_w, want_h = start(x, 4)
    assert np.abs(dense(w, "i", "w", 60, 4) - want_w).max() < 1e-8 and np.abs(dense(h, "j", "h", 18, 4) - want_h).max() < 1e-8


def test_updates_from_the_start_and_the_stop_rule(spark):
    x = table(2, 40, 12)
    w, h, path = factor.nmf(cells_of(spark, x), 3, 6, init="nndsvd")
    a, b = start(x, 3)
    errors = []
    for _ in range(6):
        b *= (x.T @ a) / np.maximum(b @ a.T @ a, 1e-12)
        a *= (x @ b) / np.maximum(a @ b.T @ b, 1e-12)
        errors.append(((x - a @ b.T) ** 2).sum())
    assert np.allclose(path, errors, rtol=1e-6) and np.allclose(dense(w, "i", "w", 40, 3), a, atol=1e-5)
    steps = -np.diff(np.sqrt(errors))
    tol = float(np.sort(steps)[1:3].mean())  # a later step is the first below it
    stop = int(np.argmax(steps < tol)) + 1
    assert len(factor.nmf(cells_of(spark, x), 3, 6, init="nndsvd", tol=tol)[2]) == stop
    with pytest.raises(ValueError, match="init"):
        factor.nmf(cells_of(spark, x), 3, 6, init="random")


def test_few_columns_and_equal_rows(spark):
    x = np.outer(np.arange(1, 9), [1.0, 2.0, 0.0, 3.0])  # one singular pair, an empty column
    _, _, values = factor.sparse_svd(cells_of(spark, x), 3)
    assert np.allclose(values, [np.linalg.norm(x), 0, 0], atol=1e-6)
    with pytest.raises(ValueError, match="no cells"):
        factor.sparse_svd(spark.createDataFrame([], "i long, j long, value double"), 2)
