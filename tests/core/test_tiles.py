"""Permutations of rows in tiles of replicates."""

from __future__ import annotations

import numpy as np
import pytest

from loamstat.operators import resample


def columns(spark, x):
    return spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(x.T)], "vec_id long, v array<double>").repartition(5)


@pytest.mark.parametrize("independent", [False, True])
def test_tiles_change_nothing(spark, monkeypatch, independent):
    x = np.random.default_rng(31).normal(size=(3, 101))
    packed = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "feature_id long, v array<double>")
    want = resample.permutation_extremes(packed, 50, 25, independent=independent).toPandas().sort_values("rep")
    monkeypatch.setattr(resample, "TILE", 256 * 3 * 10)
    got = resample.row_permutation_extremes(columns(spark, x), 50, 25, independent=independent).toPandas().sort_values("rep")
    assert got.rep.tolist() == list(range(1, 26)) and np.allclose(got.min_p, want.min_p) and np.allclose(got.max_t, want.max_t)


def test_more_replicates_than_a_tile(spark):
    x = np.random.default_rng(32).normal(size=(2, 40))
    got = resample.row_permutation_extremes(columns(spark, x), 20, 40_000).toPandas()
    assert got.rep.nunique() == 40_000
    assert 0.08 < (got.min_p < 0.05).mean() < 0.115  # two nearly independent columns
