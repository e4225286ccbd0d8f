"""E5: many rows are taken out at a time, with the fits of one at a time."""

from __future__ import annotations

import time

import numpy as np
import pytest

from loamstat.operators import regress
from loamstat.operators.factor import elastic_descent, elastic_descents


@pytest.mark.parametrize(("alpha", "lam"), [(1.0, 0.0), (1.0, 0.2), (0.5, 0.1), (0.0, 0.3)])
def test_rows_left_out_equal_single_fits(spark, monkeypatch, alpha, lam):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 3))
    x[:, 2] = 4.0  # a constant predictor
    x[0] = 9.0  # alone in having another value there
    y = x[:, 0] - 0.4 * x[:, 1] + rng.normal(size=60)
    monkeypatch.setattr(regress, "LOO_CELLS", 16 * 7)  # several chunks a batch
    df = spark.createDataFrame([(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y, strict=True))], "row_id long, a double, b double, c double, y double")
    got = {r.row_id: r for r in regress.loo(df, ["a", "b", "c"], "y", alpha, lam, "row_id").collect()}
    assert len(got) == 60
    total = regress.sums_of(df, ["a", "b", "c"], "y")[0]
    for i in range(60):
        v = np.append(x[i], y[i])
        rest = total - regress.Sums(1.0, v, np.outer(v, v))
        b0, b = rest.fit(alpha, lam)
        assert np.isclose(got[i].error, v[-1] - b0 - v[:-1] @ b, atol=1e-9)
        assert np.isclose(got[i].train_ratio, rest.mse(b0, b) / rest.mse(*rest.fit(alpha, 0.0)), atol=1e-9)
        assert got[i].model == "".join("1" if abs(c) > 1e-5 else "0" for c in b)


def test_many_problems_take_little_time():
    """100,000 rows of one predictor took 4.9 s one at a time."""
    rng = np.random.default_rng(4)
    v = rng.normal(size=(100_000, 2))
    total = regress.Sums(float(len(v)), v.sum(0), v.T @ v)
    began = time.process_time()
    b0, b, mse, ols = regress._without_each(total, v, 1.0, 0.0)
    assert time.process_time() - began < 2 and b.shape == (100_000, 1) and (mse == ols).all()


def test_descents_stop_by_themselves():
    rng = np.random.default_rng(5)
    m = rng.normal(size=(50, 30, 4))
    q, c = np.einsum("mni,mnj->mij", m, m) / 30, rng.normal(size=(50, 4))
    q[3, 2] = q[3, :, 2] = 0.0
    for l1, l2 in ((0.0, 0.0), (0.3, 0.0), (0.1, 0.2)):
        assert np.allclose(elastic_descents(q, c, l1, l2), [elastic_descent(a, b, l1, l2) for a, b in zip(q, c, strict=True)], atol=1e-12)
