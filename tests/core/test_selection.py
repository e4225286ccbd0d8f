"""Exact quantiles by counted bits, and leader groups by pointer doubling, against plain versions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loamstat.functions import selection
from loamstat.operators import clean, joins, sensitivity


def test_bits_order_as_numbers():
    x = np.array([-np.inf, -1e300, -2.5, -5e-324, -0.0, 0.0, 5e-324, 1.0, 1e300, np.inf, np.nan])
    bits = selection.order_bits(x)
    assert (np.diff(bits.astype(object)) >= 0).all() and bits[4] == bits[5]
    assert np.array_equal(selection.from_bits(bits), x, equal_nan=True)


@pytest.mark.parametrize("tol", [0.0, 0.1, 1.0, 4000.0])
def test_first_beyond_is_the_smallest(tol):
    v = np.array([-4000.0, -0.3, 0.0, 0.1, 0.7, 12.34, 1e9, 1e300, -1e300])
    u = selection.first_beyond(v, tol)
    assert (u - v > tol).all() and not (np.nextafter(u, -np.inf) - v > tol).any()
    assert np.isnan(selection.first_beyond(np.array([np.inf]), tol)).all()


def test_quantiles_equal_percentile(spark):
    rng = np.random.default_rng(4)
    x = np.column_stack([rng.normal(size=3000), rng.integers(-3, 4, 3000), np.exp(rng.normal(size=3000) * 200), np.full(3000, 7.0)])
    x[:1000, 1] = 2  # a third of the rows are equal
    rows = [(*map(float, r), None if i % 3 else float(r[0]), None) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double, f double").repartition(5)
    probs = [0.0, 0.01, 0.25, 1 / 3, 0.5, 0.999, 1.0]
    want = df.agg(*[F.percentile(c, F.array(*[F.lit(p) for p in probs])).alias(c) for c in df.columns]).first()
    got = selection.quantiles(df, df.columns, probs)
    assert got["f"] == [None] * len(probs)
    for c in "abcde":
        assert got[c] == want[c], c
    assert selection.quantiles(df.limit(0), ["a"], [0.5]) == {"a": [None]}


def test_operators_take_exact_quantiles(spark):
    obs = spark.createDataFrame([(f, s, float(f * s)) for f in range(12) for s in range(5)], "feature_id int, sample_id int, value double")
    var = {f: np.var([f * s for s in range(5)], ddof=1) for f in range(12)}
    cut = np.quantile(list(var.values()), 0.4)
    kept = clean.variance_filter(obs, 0.4, "proportion").select("feature_id").distinct()
    assert {r.feature_id for r in kept.collect()} == {f for f, v in var.items() if v > cut}
    assert clean.variance_filter(obs.limit(0), 0.4, "proportion").count() == 0
    x = spark.createDataFrame([(float(i) ** 2,) for i in range(50)], "x double")
    grid = sorted(r.x for r in sensitivity.quantile_sample(x, ["x"], 10, "grid", steps=49).collect())
    assert np.allclose(grid, np.interp((np.arange(10) + 0.5) / 10 * 49, np.arange(50), np.arange(50.0) ** 2))


def greedy(pairs, tol):
    """The leader of every (group, value) by a pass in order."""
    out, group, lead = {}, object(), 0.0
    for g, v in sorted(set(pairs), key=lambda p: (p[0] is not None, p[0] or 0, p[1])):
        if g != group or v - lead > tol:
            group, lead = g, v
        out[g, v] = lead
    return out


@pytest.mark.parametrize("block", [3, 17, 1_000_000])
@pytest.mark.parametrize("by", [None, "k"])
def test_leaders_equal_the_pass(spark, by, block):
    rng = np.random.default_rng(block)
    v = np.round(np.concatenate([rng.normal(size=150) * 3, rng.random(150) * 0.5, np.full(100, 0.25), [1e6, -1e6, 1e6 + 1]]), 2)
    rows = [(i, None if i % 7 == 0 else i % 3, float(x)) for i, x in enumerate(v)]
    df = spark.createDataFrame([*rows, (9001, 1, None), (9002, 1, float("nan"))], "id long, k int, v double").repartition(4)
    want = greedy([(k if by else 0, x) for _, k, x in rows], 0.3)
    got = {r.id: r.leader for r in joins.leader_groups(df, "id", "v", 0.3, by, block).collect()}
    assert got == {i: want[k if by else 0, x] for i, k, x in rows} | {9001: None, 9002: None}


@pytest.mark.parametrize("rows", [1, 40, 10_000])
def test_small_groups_are_led_in_one_pass(spark, rows, monkeypatch):
    monkeypatch.setattr(joins, "LED_ROWS", rows)
    rng = np.random.default_rng(rows)
    pairs = [(None if g == 0 else int(g), float(np.round(x, 1))) for g, x in zip(rng.integers(0, 20, 500) ** 2 // 20, rng.normal(size=500) * 2, strict=True)]
    pairs.sort(key=lambda p: (p[0] is not None, p[0] or 0, p[1]))
    table = pa.table({"k": pa.array([g for g, _ in pairs], pa.int32()), "__v": pa.array([v for _, v in pairs])})
    got = pa.Table.from_batches(list(joins._led_rows("k", 0.5)(iter(table.to_batches(max_chunksize=7)))))
    want = greedy(pairs, 0.5)
    assert got.column("leader").to_pylist() == [want[p] for p in pairs]
    df = spark.createDataFrame([(i, g, v) for i, (g, v) in enumerate(pairs)], "id long, k int, v double")
    led = joins.leader_groups(df, "id", "v", 0.5, "k")
    assert "Join" not in led._jdf.queryExecution().optimizedPlan().toString()  # no values are ranked and joined back
    assert {r.id: r.leader for r in led.collect()} == {i: want[p] for i, p in enumerate(pairs)}


def test_leaders_of_nothing(spark):
    df = spark.createDataFrame([], "id long, v double")
    assert joins.leader_groups(df, "id", "v", 1.0).collect() == []
