"""Two levels of replicates and null correlations against NumPy."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamstat.functions.special import t_two_sided
from loamstat.operators import resample, two_level


def frame(spark, x):
    return spark.createDataFrame([(i * 3 + 1, [float(v) for v in row]) for i, row in enumerate(x)], "feature_id long, v array<double>").repartition(3)


def outer_sets(x, shift, n_x, outer, seed=1):
    pos = np.arange(x.shape[1])
    for rep in range(1, outer + 1):
        order = np.lexsort((pos, resample.keyed(np.array([rep]), pos, seed)[0]))
        yield rep, x[:, order] + shift[:, None] * (pos < n_x)


def t_of(x, ind):
    a, b = x[:, ind], x[:, ~ind]
    n, m = a.shape[1], b.shape[1]
    pooled = ((n - 1) * a.var(1, ddof=1) + (m - 1) * b.var(1, ddof=1)) / (n + m - 2)
    return (a.mean(1) - b.mean(1)) / np.sqrt(pooled * (1 / n + 1 / m))


def bh(p, alpha):
    order = np.argsort(p)
    ok = np.flatnonzero(p[order] <= alpha * np.arange(1, len(p) + 1) / len(p))
    out = np.zeros(len(p), bool)
    if len(ok):
        out[order[: ok[-1] + 1]] = True
    return out


def complete_linkage(d, t):
    """Merges the two nearest clusters, by their farthest members, while these are at most ``t`` apart."""
    groups = [[i] for i in range(len(d))]
    while True:
        pairs = [(max(d[a, b] for a in g for b in h), i, j) for i, g in enumerate(groups) for j, h in enumerate(groups) if i < j]
        height, i, j = min(pairs)
        if height > t:
            break
        groups[i] += groups.pop(j)
    out = np.zeros(len(d), int)
    for k, g in enumerate(groups):
        out[g] = k
    return out


def test_every_method_equals_its_plain_version(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(6, 24))
    x = np.vstack([base[i % 6] + rng.normal(size=24) * (0.02 if i % 3 else 1.0) for i in range(30)])
    shift = np.where(np.arange(30) % 5 == 0, 1.4, 0.0)
    packed = frame(spark, x)
    shifts = spark.createDataFrame([(i * 3 + 1, float(shift[i])) for i in range(30) if shift[i]], "feature_id long, shift double")
    inner, n_x, outer = 60, 10, 3
    got = {(r.method, r.rep): (r.fn, r.fp, r.rejections, r.n_effects, r.n_tests) for r in two_level.two_level_calibration(packed, n_x, outer, inner, shifts).collect()}
    assert {m for m, _ in got} == set(two_level.METHODS)
    effect = shift != 0
    for rep, d in outer_sets(x, shift, n_x, outer):
        first = np.arange(24) < n_x
        t = t_of(d, first)
        p = t_two_sided(t, np.full(30, 22.0))
        drawn = np.array([t_of(d, i.astype(bool)) for i in resample.shuffled_x(rep * inner + np.arange(inner), np.arange(24), n_x, 1 + 7919)])
        pooled = (np.abs(drawn).ravel()[None, :] >= np.abs(t)[:, None] - 1e-12).mean(1)
        r = np.corrcoef(d)
        m_eff = two_level.n_eff_of(np.linalg.eigvalsh(r), 30)
        label = complete_linkage(1 - r, 0.1)
        m_cluster = len(set(label))
        combine = {"min": np.min, "geometric": lambda v: np.exp(np.log(v).mean()), "harmonic": lambda v: len(v) / (1 / v).sum()}
        want = {
            "bonferroni": p * 30 <= 0.05,
            "fdr_bh": bh(p, 0.05),
            "bonf_spectral": p * m_eff < 0.05,
            "fdr_spectral": bh(p, 0.05 * 30 / m_eff),
            "bonf_cluster": p * m_cluster < 0.05,
            "fdr_cluster": bh(p, 0.05 * 30 / m_cluster),
            "westfall_young": np.abs(t) > np.sort(np.abs(drawn).max(1))[::-1][int(0.05 * inner)],
            "reiner_bh": bh(pooled, 0.05),
            "reiner_by": bh(pooled, 0.05 / (1 / np.arange(1, 31)).sum()),
        }
        for how, f in combine.items():
            want[f"combined_{how}"] = bh(np.array([f(p[label == label[i]]) for i in range(30)]), 0.05)
        for m, reject in want.items():
            assert got[m, rep] == ((~reject & effect).sum(), (reject & ~effect).sum(), reject.sum(), 6, 30), (m, rep)


def test_westfall_young_keeps_its_level_under_the_null(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(25, 20)) + rng.normal(size=20)
    got = two_level.two_level_calibration(frame(spark, x), 10, 120, 60, None, ("westfall_young",)).agg(F.avg((F.col("fp") > 0).cast("double")), F.count("*")).first()
    # at the fourth of 60 extremes: a level of 4 / 61, within three binomial deviations
    level = 4 / 61
    assert got[1] == 120 and abs(got[0] - level) < 3 * np.sqrt(level * (1 - level) / 120)
    with pytest.raises(ValueError, match="unknown"):
        two_level.two_level_calibration(frame(spark, x), 10, 1, 1, None, ("guess",))


@pytest.mark.parametrize(("m", "block", "rep_block"), [(7, 1000, 50), (23, 6, 4)])
def test_null_correlations_in_one_job(spark, m, block, rep_block):
    rng = np.random.default_rng(m)
    x = rng.normal(size=(m, 18))
    x[2] = 1.0  # constant
    packed, reps = frame(spark, x), 9
    got = two_level.null_correlations(packed, reps, 5, (0.025, 0.5, 0.975), block=block, rep_block=rep_block).orderBy("rep").collect()
    pos = np.arange(18)
    unit = two_level._unit_rows(x)
    for rep, row in enumerate(got):
        mixed = np.stack([unit[i, np.argsort(resample.keyed(np.array([rep]), pos, 5 + (i * 3 + 1) * 7919)[0], kind="stable")] for i in range(m)])
        r = np.sort((mixed @ mixed.T)[np.triu_indices(m, 1)])
        want = [r[int(np.ceil(q * len(r))) - 1] for q in (0.025, 0.5, 0.975)]
        assert row.rep == rep and np.allclose([row.q0, row.q1, row.q2], want, atol=2e-9)


def test_a_thousand_replicates_of_null_correlations(spark):
    x = np.random.default_rng(1).normal(size=(12, 20))
    got = two_level.null_correlations(frame(spark, x), 1_000).toPandas()
    assert sorted(got.rep) == list(range(1_000)) and (got.q0 < got.q1).all() and abs(got.q1.mean() - 0.43) < 0.05


def test_single_draws(spark):
    obs = spark.createDataFrame([(1, "a", f"s{i}", float(i)) for i in range(5)] + [(1, "b", f"u{i}", 10.0 * i) for i in range(4)], "feature_id long, grp string, sample_id string, value double")
    got = [r.effect for r in resample.sampled_effect(obs, "a", "b", 40).orderBy("rep").collect()]
    rep = np.arange(40)
    want = resample.keyed(rep, np.array([0]), 2)[:, 0] % 5 - 10.0 * (resample.keyed(rep, np.array([100_003]), 2)[:, 0] % 4)
    assert got == want.tolist()
