"""Agreement of chains and predictions of coefficient samples against plain versions."""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loamstat.functions.ordered import mid_ranks
from loamstat.operators import bayes, joins


def plain_rhat(draws: pd.DataFrame, rank: bool) -> dict:
    out = {}
    for param, d in draws.groupby("param"):
        d = d.copy()
        if rank:
            d["value"] = [NormalDist().inv_cdf((r - 0.375) / (len(d) + 0.25)) for r in d.value.rank()]
        n, m, v = [], [], []
        for _, c in d.groupby("chain"):
            late = c.iter * 2 > c.iter.min() + c.iter.max()
            for half in (c[late].value, c[~late].value):
                n, m, v = [*n, len(half)], [*m, half.mean()], [*v, half.var()]
        n, w = np.mean(n), np.mean(v)
        out[param] = np.sqrt(((n - 1) / n * w + np.var(m, ddof=1)) / w)
    return out


@pytest.mark.parametrize("rank", [False, True])
def test_rhat_equals_the_plain_one(spark, rank):
    rng = np.random.default_rng(5)
    draws = pd.DataFrame([(c, i, p, float(v)) for p in "xyz" for c in range(3) for i, v in enumerate(np.round(rng.normal(size=60) + (c if p == "y" else 0), 1))], columns=["chain", "iter", "param", "value"])
    draws.loc[draws.param == "z", "value"] = np.where(rng.random((draws.param == "z").sum()) < 0.7, 1.0, 2.0)  # ties
    df = spark.createDataFrame(draws).repartition(4)
    with_null = df.unionByName(df.limit(1).withColumn("value", F.lit(None).cast("double")))
    got = {r.param: r.rhat for r in bayes.rhat(with_null, rank=rank).collect()}
    assert got == pytest.approx(plain_rhat(draws, rank), rel=1e-7)
    assert bayes.rhat(df.limit(0), rank=rank).collect() == []


def test_mid_ranks(spark):
    rng = np.random.default_rng(6)
    x = pd.DataFrame({"k": rng.integers(0, 4, 500), "v": rng.integers(0, 9, 500).astype(float)})
    x.loc[:200, "v"] = 3.0
    x["mid"], x["n"] = x.groupby("k").v.rank(), x.groupby("k").v.transform("size")
    got = mid_ranks(spark.createDataFrame(x[["k", "v"]]).repartition(3), "k", "v").toPandas()
    want = x.drop_duplicates().sort_values(["k", "v"])
    assert got.sort_values(["k", "v"])[["k", "v", "mid", "n"]].to_numpy().tolist() == want[["k", "v", "mid", "n"]].to_numpy().tolist()


@pytest.mark.parametrize("bound", [1, 7, 1_000_000])
def test_predictions_in_blocks(spark, monkeypatch, bound):
    monkeypatch.setattr(joins, "COEFFICIENTS", bound)
    rng = np.random.default_rng(7)
    x, b = rng.normal(size=(20, 3)), rng.normal(size=(6, 3))
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, x array<double>")
    coefs = spark.createDataFrame([(i // 2, [float(v) for v in r]) for i, r in enumerate(b)], "rep long, beta array<double>")
    got = joins.uncertainty_predict(rows, coefs, "id", F.col("x")).toPandas()
    want = sorted((i, j // 2, round(x[i] @ b[j], 9)) for i in range(20) for j in range(6))  # repeated numbers of samples count each
    assert sorted((r.id, r.rep, round(r.prediction, 9)) for r in got.itertuples()) == want
    none = joins.uncertainty_predict(rows, coefs.limit(0), "id", F.col("x"))
    assert none.columns == ["id", "rep", "prediction"] and none.count() == 0
