"""Operators without SQL against NumPy and plain Python, on small tables."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamstat.functions.special import t_two_sided
from loamstat.operators import cluster, correlate, factor, joins, multitest, regress, resample, sensitivity, stats

RNG = np.random.default_rng(7)


def vectors(spark, x, **more):
    rows = [(i, [float(v) for v in r], *(int(m[i]) for m in more.values())) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "vec_id long, v array<double>" + "".join(f", {m} long" for m in more))


@pytest.fixture(scope="module")
def cloud(spark):
    x = np.concatenate([RNG.normal(c, 1.0, (40, 5)) for c in (0.0, 4.0, -3.0)]) * np.array([1, 2, 0.5, 1, 3])
    return x, vectors(spark, x, label=np.repeat([0, 1, 2], 40))


def test_cross_products_over_many_partitions(spark, cloud):
    x, df = cloud
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("cross", "cross")
    n, s, q = factor.cross_products(df.repartition(200), F.col("v"))[0]
    assert len(jobs.getJobIdsForGroup("cross")) < 12  # not one a partition
    spark.sparkContext.setJobGroup("other", "other")
    assert n == 120 and np.allclose(s, x.sum(0)) and np.allclose(q, x.T @ x)
    per = factor.cross_products(df.repartition(50), F.col("v"), F.lit(2.0), "label")
    for g in range(3):
        own = x[g * 40 : g * 40 + 40]
        assert per[g][0] == 80 and np.allclose(per[g][2], 2 * own.T @ own)


def test_components_and_discriminants(cloud):
    x, df = cloud
    cov = np.cov(x.T)
    want, directions = np.linalg.eigh(cov)
    scored, values, vec = factor.pca(df, F.col("v"), 3)
    assert np.allclose(values, want[::-1][:3])
    assert np.allclose(np.abs(vec.T @ directions[:, ::-1][:, :3]), np.eye(3), atol=1e-6)
    got = np.array([r.scores for r in scored.orderBy("vec_id").collect()])
    assert np.allclose(got, (x - x.mean(0)) @ vec)
    latent, noise, w = factor.ppca(df, F.col("v"), 2)
    pop = np.linalg.eigvalsh(cov * 119 / 120)[::-1]
    assert noise == pytest.approx(pop[2:].mean()) and np.allclose(np.linalg.norm(w, axis=0) ** 2, pop[:2] - noise)
    z = np.array([r.latent for r in latent.orderBy("vec_id").collect()])
    assert np.allclose(z, (x - x.mean(0)) @ w @ np.linalg.inv(w.T @ w + noise * np.eye(2)))
    lda, _ = factor.lda(df, F.col("v"), "label", 1e-3, 2)
    truth = np.repeat([0, 1, 2], 40)
    assert np.mean([r.predicted == truth[r.vec_id] for r in lda.collect()]) > 0.97
    y = (truth == 1).astype(float)
    first = factor.pls(df, F.col("v"), F.array((F.col("label") == 1).cast("double")), 1)[:, 0]
    raw = (x - x.mean(0)).T @ (y - y.mean())
    assert abs(first @ raw / np.linalg.norm(raw)) == pytest.approx(1.0)
    full = factor.covariance(df, F.col("v"))[2]
    assert np.allclose(full, cov)


def test_sparse_loadings_without_penalty_are_components(cloud):
    x, df = cloud
    b = factor.sparse_pca(df, F.col("v"), 2, 1e-9)
    assert np.allclose(np.abs(b.T @ np.linalg.eigh(np.cov(x.T))[1][:, ::-1][:, :2]), np.eye(2), atol=1e-3)
    assert (factor.sparse_pca(df, F.col("v"), 2, 3.0, 1.0) == 0).any()


def test_robust_regression_is_centred(spark):
    x = RNG.normal(3, 1, (80, 2))
    y = x @ [2.0, -1.0] + 5 + RNG.standard_t(2, 80)
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y, strict=True)], "a double, b double, y double")
    z = x - x.mean(0)
    w = np.linalg.lstsq(z, y, rcond=None)[0]
    for _ in range(60):
        k = np.maximum(np.abs(y - z @ w), 1e-6) ** -1.0
        w = np.linalg.solve(z.T * k @ z, z.T * k @ y)
    assert np.allclose(factor.irls(df, ["a", "b"], "y", 1.0, 60), w, atol=1e-3)


def linkage_by_hand(d, t):
    groups = [[i] for i in range(len(d))]
    while True:
        pairs = [(max(d[a, b] for a in g for b in h), min(g + h), min(max(g), max(h)), i, j) for i, g in enumerate(groups) for j, h in enumerate(groups) if i < j]
        best = min(pairs, default=None)
        if best is None or best[0] > t:
            return {a: min(g) for g in groups for a in g}
        groups[best[3]] += groups.pop(best[4])


@pytest.mark.parametrize("task_nodes", [2000, 3])
def test_complete_linkage_in_a_task_and_in_rounds(spark, task_nodes):
    x = RNG.random((45, 2))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    t = 0.3
    edges = spark.createDataFrame([(i, j, float(d[i, j])) for i in range(45) for j in range(i + 1, 45) if d[i, j] <= t], "i long, j long, distance double")
    got = {r.node: r.cluster for r in correlate.complete_linkage(edges, t, task_nodes).collect()}
    want = linkage_by_hand(d, t)
    assert got == {i: want[i] for i in got} and all(want[i] == i for i in range(45) if i not in got)
    assert len(set(got.values())) > 4


def test_effective_numbers_of_tests(spark, monkeypatch):
    x = RNG.normal(size=(12, 30)) + RNG.normal(size=30) * 0.8
    packed = spark.createDataFrame([(i, [float(a) for a in r]) for i, r in enumerate(x)], "feature_id long, v array<double>")
    lam, m = np.linalg.eigvalsh(np.corrcoef(x)), 12
    want = {
        "nyholt": 1 + (m - 1) * (1 - lam.var(ddof=1) / m),
        "li": 1 + (m - 1) * (1 - lam.var() / m),
        "cheverud": m * (1 - (m - 1) * lam.var() / m**2),
        "bretherton": lam.sum() ** 2 / (lam**2).sum(),
        "galwey": np.sqrt(np.abs(lam)).sum() ** 2 / lam.sum(),
        "peluso": (np.sqrt(np.abs(lam)).sum() / np.log(lam.max())) ** 2 / (lam.sum() / lam.max() + np.sqrt(lam.max())),
        "li_ji": (lam >= 1).sum() + (lam - np.floor(lam)).sum(),
    }
    for name, value in want.items():
        assert correlate.n_eff_spectral(packed, name, 1000.0) == pytest.approx(value * 1000, abs=1.01), name
    monkeypatch.setattr(correlate, "MAX_COLUMNS", 5)  # more samples than a matrix may have: sums only
    for name in ("nyholt", "li", "cheverud", "bretherton"):
        assert correlate.n_eff_spectral(packed, name, 1000.0) == pytest.approx(want[name] * 1000, abs=1.01), name
    assert correlate.effective_levels(5) == pytest.approx((1 - 0.95**0.2, 0.01))


def test_spectral_embedding_matches_eigenvectors(spark):
    w = np.zeros((12, 12))
    for a in range(12):
        for b in range(a + 1, 12):
            if (a < 6) == (b < 6) or (a, b) == (5, 6):
                w[a, b] = w[b, a] = 0.2 + RNG.random()
    edges = spark.createDataFrame([(a, b, float(w[a, b])) for a in range(12) for b in range(a + 1, 12) if w[a, b]], "i long, j long, weight double")
    places, values = cluster.spectral_embedding(edges, 2, 25)
    d = w.sum(1)
    want, vectors_ = np.linalg.eigh(w / np.sqrt(np.outer(d, d)))
    assert np.allclose(values, want[::-1][:2], atol=1e-6)
    v = np.array([r.v for r in places.orderBy("id").collect()])
    assert np.allclose(np.abs(v.T @ vectors_[:, ::-1][:, :2]), np.eye(2), atol=1e-3)


def test_noisy_quantisation_repeats_on_the_means(spark):
    x = RNG.normal(size=(30, 3))
    df = vectors(spark, x)
    for rounds in (0, 1):
        want = x.copy()
        for _ in range(rounds + 1):
            near = np.argsort(np.linalg.norm(want[:, None] - want[None], axis=-1), axis=1)[:, :3]
            want = want[near].mean(1)
        got = np.array([r.v for r in cluster.noisy_vq(df, 3, 0.0, rounds).orderBy("vec_id").collect()])
        assert np.allclose(got, want)
    labels = spark.createDataFrame([(0, "a"), (1, "b"), (2, "b"), (3, "a"), (4, "b")], "vec_id long, label string")
    cells = spark.createDataFrame([(0, 1), (1, 1), (2, 1), (3, 2), (4, 2)], "vec_id long, cluster int")
    assert {r.cluster: r.label for r in cluster.quantised_labels(labels, cells, "label").collect()} == {1: "b", 2: "a"}


@pytest.mark.parametrize("metric", ["euclid", "cosine"])
def test_neighbours_by_cells(spark, metric):
    """All cells give the exact neighbours; a few give nine in ten of them on clustered rows, also where one cell is hot."""
    middle = RNG.normal(size=(12, 6)) * 4
    x = np.concatenate([middle[RNG.integers(0, 12, 300)] + RNG.normal(size=(300, 6)), middle[:1] + RNG.normal(size=(200, 6)) * 0.2])
    df = vectors(spark, x).withColumnRenamed("v", "embedding")
    exact = {(r.key, r["rank"]): r.neighbour for r in joins.knn(df, df, 5, metric, block=120).collect()}
    whole = {(r.key, r["rank"]): r.neighbour for r in joins.knn_by_cells(df, df, 5, 99, metric, block=60).collect()}
    assert whole == exact and len(exact) == 2500
    some = {(r.key, r.neighbour) for r in joins.knn_by_cells(df, df, 5, 6, metric, block=60).collect()}
    assert np.mean([(key, n) in some for (key, _), n in exact.items()]) > 0.9


def test_unit_rows_and_spherical_clusters(spark):
    x = np.array([[3.0, 4.0], [0.0, 0.0], [-1.0, 0.0], [30.0, 41.0], [-2.0, 0.1]])
    got = np.array([r.v for r in cluster.unit_rows(vectors(spark, x)).orderBy("vec_id").collect()])
    assert np.allclose(got, x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300))
    rows = cluster.spherical_kmeans(vectors(spark, x[[0, 2, 3, 4]]), 2, [(0, [1.0, 1.0]), (1, [-1.0, 0.0])])[0].orderBy("vec_id").collect()
    assert [r.cluster for r in rows] == [0, 1, 0, 1]


def test_fast_total_indices_match_fourier_sums(spark):
    base = spark.createDataFrame([(float(a), float(b), float(c)) for a, b, c in RNG.random((500, 3))], "a double, b double, c double")
    cols = ["a", "b", "c"]
    design = sensitivity.fast_design(base, cols, 513)
    y = F.col("a") + 2 * F.col("b") * F.col("c")
    got = sensitivity.fast_total_indices(design, cols, y).toPandas().set_index("factor")
    rows = design.toPandas().sort_values(["factor", "row_id"])
    for f, part in rows.groupby("factor"):
        out = (part.a + 2 * part.b * part.c).to_numpy()
        p = np.abs(np.fft.fft(out) / len(out)) ** 2
        high = (513 - 1) // 8
        v = out.var()
        assert got.s1[f] == pytest.approx(2 * p[[high, 2 * high, 3 * high, 4 * high]].sum() / v, rel=1e-6)
        assert got.dt[f] == pytest.approx(2 * p[1 : high // 2 + 1].sum() / v, rel=1e-6)
        assert got.st[f] == pytest.approx(1 - got.dt[f])
    assert got.st["b"] > got.s1["b"] + 0.01 and abs(got.st["a"] - got.s1["a"]) < 0.05


def test_two_stage_keeps_null_p_values_and_null_families(spark):
    tests = spark.createDataFrame([(1, "f", 1e-9), (2, "f", 1e-8), (3, "f", None), (4, None, 1e-9), (5, None, 0.9), (6, "g", None)], "id long, family string, p double")
    for method in ("bh", "bky"):
        got = {r.id: r.reject for r in multitest.two_stage(tests, ["family"], method).collect()}
        assert got[1] and got[2] and got[4] and got[3] is False and got[6] is False and len(got) == 6


def test_schweder_spjotvoll_sample(spark):
    tests = spark.createDataFrame([(float(p),) for p in RNG.random(2000)], "p double")
    whole = {(r.p, r.y) for r in multitest.spjotvoll(tests).collect()}
    some = [(r.p, r.y) for r in multitest.spjotvoll(tests, n_max=200).collect()]
    assert 120 < len(some) < 290 and set(some) <= whole


def test_dummy_coded_fits_match_least_squares(spark):
    g = RNG.choice(["a", "b", "c"], 60)
    y = RNG.normal(size=60) + (g == "b") * 2
    obs = spark.createDataFrame([(1, str(a), float(b)) for a, b in zip(g, y, strict=True)], "feature_id long, grp string, value double")
    got = stats.group_ols(stats.describe_groups(obs), "a").toPandas().set_index("term")
    x = np.stack([np.ones(60), g == "b", g == "c"], axis=1).astype(float)
    beta = np.linalg.solve(x.T @ x, x.T @ y)
    s2 = ((y - x @ beta) ** 2).sum() / 57
    se = np.sqrt(np.diag(np.linalg.inv(x.T @ x)) * s2)
    assert np.allclose(got.loc[["(intercept)", "b", "c"], ["beta", "se"]], np.stack([beta, se], axis=1))
    assert got.p["b"] < 1e-4 < got.p["c"]


def test_permuted_responses_keep_their_values(spark):
    x = RNG.normal(size=200)
    y = 3 * x + RNG.normal(size=200)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "row_id long, x double, y double")
    got = regress.coef_bootstrap(df, ["x"], "y", "permuted", 20).toPandas()
    assert len(got) == 20 and got.beta.abs().max() < 1.5 and got.beta.nunique() > 10
    again = regress.coef_bootstrap(df.repartition(7), ["x"], "y", "permuted", 20).toPandas()
    assert np.allclose(got.sort_values("rep").beta, again.sort_values("rep").beta)


def test_cross_validation_marks_the_best_alpha(spark):
    x = RNG.normal(size=(90, 2))
    y = x[:, 0] + RNG.normal(size=90)
    df = spark.createDataFrame([(i, float(a), float(b), float(c)) for i, ((a, b), c) in enumerate(zip(x, y, strict=True))], "row_id long, a double, b double, y double")
    got = regress.cv_lambda(df, ["a", "b"], "y", [0.2, 0.6, 1.0], 5).toPandas()
    assert got.best.sum() == 1 and got.mse[got.best].iloc[0] == got.mse.min()


def test_group_permutations_follow_sample_names(spark):
    """A feature that lacks samples keeps the others in the order of a full one."""
    rows = [(f, f"s{i}", "ab"[i % 2], float(i)) for f in (1, 2) for i in range(24) if f == 1 or i % 5]
    obs = spark.createDataFrame(rows, "feature_id long, sample_id string, grp string, value double")
    pairs = spark.createDataFrame([("a-b", "a", "b")], "contrast string, grp_x string, grp_y string")
    got = resample.group_permutation(obs, pairs, 30).toPandas()
    assert got.groupby("feature_id").size().to_dict() == {1: 30, 2: 30} and got.p.between(0, 1).all()
    orders = {}
    for f in (1, 2):
        own = sorted((g, s, v) for k, s, g, v in rows if k == f)
        side, value = np.array([g for g, _, _ in own]), np.array([v for _, _, v in own])
        ident = np.array([zlib.crc32(s.encode()) for _, s, _ in own])
        for rep in range(1, 31):
            at = np.argsort(resample.keyed(np.array([rep]), ident, 1)[0], kind="stable")
            orders[f, rep] = [own[i][1] for i in at]
            a, b = value[at][side == "a"], value[at][side == "b"]
            va, vb = a.var(ddof=1) / len(a), b.var(ddof=1) / len(b)
            dof = (va + vb) ** 2 / (va**2 / (len(a) - 1) + vb**2 / (len(b) - 1))
            want = t_two_sided(np.array([(a.mean() - b.mean()) / np.sqrt(va + vb)]), np.array([dof]))[0]
            assert abs(got[(got.feature_id == f) & (got.rep == rep)].p.iloc[0] - want) < 1e-9
    for rep in range(1, 31):
        short = set(orders[2, rep])
        assert [s for s in orders[1, rep] if s in short] == orders[2, rep] and len(short) < 24
    assert len({tuple(orders[1, rep]) for rep in range(1, 31)}) == 30


def test_sums_over_many_partitions(spark):
    """More partitions than two rounds of 128 would leave to one task at once."""
    rows = spark.range(0, 2_000, 1, 700).select(F.array((F.col("id") % 7).cast("double"), F.lit(1.0)).alias("x"))
    n, s, q = factor.cross_products(rows, F.col("x"))[0]
    x = np.array([[i % 7, 1.0] for i in range(2_000)])
    assert n == 2_000 and np.allclose(s, x.sum(0)) and np.allclose(q, x.T @ x)


def test_replicate_keys_are_a_bijection_and_no_rotation():
    keys = resample.keyed(np.arange(40), np.arange(200), 3)
    assert all(len(set(row)) == 200 for row in keys) and keys.max() < resample.MOD
    orders = np.argsort(keys, axis=1)
    after = [dict(zip(o, np.roll(o, -1), strict=True)) for o in orders]
    shared = sum(after[0][i] == after[1][i] for i in range(200))
    assert shared < 20  # in a rotation all but one would be the same
