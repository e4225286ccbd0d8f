"""A29 by ranks: normal scores in one step, and no draw dealt by its chain or parameter."""

from __future__ import annotations

import statistics
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamstat.functions import special as s
from loamstat.operators import bayes


def test_normal_quantiles_equal_bisected_ones():
    p = np.concatenate([np.linspace(1e-9, 1 - 1e-9, 4001), 10.0 ** -np.arange(1, 300, 7), [0.075, 0.925]])
    got = s.norm_ppf(p)
    assert np.allclose(got, [statistics.NormalDist().inv_cdf(v) for v in p], rtol=1e-13, atol=1e-15)
    near = p > 1e-14
    assert np.allclose(got[near], s._bisect(s.norm_cdf, p[near], -40, 40), atol=1e-8)
    edge = np.array([0.0, 1.0, -1.0, 2.0, np.nan])
    assert np.array_equal(s.norm_ppf(edge), s._bisect(s.norm_cdf, edge, -40, 40), equal_nan=True)
    assert s.norm_ppf(0.5) == 0 and s.norm_ppf(0.975).shape == () and s.norm_ppf(np.ones((2, 3)) / 3).shape == (2, 3)


def test_a_million_scores_take_little_time():
    p = (np.arange(1_000_000) + 0.5) / 1_000_000
    began = time.process_time()
    s.norm_ppf(p)
    assert time.process_time() - began < 2


@pytest.mark.parametrize("rank", [False, True])
def test_no_draw_is_dealt_by_its_chain(spark, rank):
    draws = spark.range(4000).select((F.col("id") % 4).alias("chain"), F.col("id").alias("iter"), (F.col("id") % 3).alias("param"), (F.col("id") * 7919 % 1013).alias("value"))
    plan = bayes.rhat(draws, rank=rank)._jdf.queryExecution().sparkPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert any("BroadcastHashJoin [param" in j and "chain" in j for j in joins) and not any("SortMergeJoin" in j and "chain" in j for j in joins)
