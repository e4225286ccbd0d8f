"""Properties and hand-made tables for the library's operators."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamstat.functions.ordered import cumulative_count, global_rank, suffix_min
from loamstat.functions.special import t_two_sided
from loamstat.functions.stemmer import stem
from loamstat.operators import bayes, clean, cluster, correlate, factor, joins, multitest, pairs, ranks, regress, resample, sensitivity, stats, text
from loamstat.sources import tables


@pytest.fixture(scope="module")
def obs(spark):
    rng = np.random.default_rng(0)
    rows = [(f, f"s{g}{i}", g, float(rng.normal(f % 3 * (g == "A"), 1 + (g == "B"))), int(rng.integers(0, 3)) * 8) for f in range(40) for g in "AB" for i in range(8)]
    return spark.createDataFrame(rows, "feature_id long, sample_id string, grp string, value double, gap_status int").cache()


def pair_tests(obs, equal):
    return stats.ttest(stats.pairwise_contrasts(stats.describe_groups(obs), obs.sparkSession.createDataFrame([("A-B", "A", "B")], "contrast string, grp_x string, grp_y string")), equal)


def test_welch_equals_pooled_for_equal_sizes(obs):
    a, b = (pair_tests(obs, e).toPandas().sort_values("feature_id") for e in (False, True))
    assert np.allclose(a.t, b.t) and (a.dof <= b.dof + 1e-9).all()
    assert np.allclose(a.p, t_two_sided(a.t, a.dof))


def test_adjusted_p_by_hand_and_nesting(spark, obs):
    p = [0.01, 0.04, 0.03, 0.005, 0.55, None, 0.03]
    t = spark.createDataFrame([(i, "f", v) for i, v in enumerate(p)], "feature_id long, fam string, p double")
    known = sorted(v for v in p if v is not None)
    m = len(known)
    bh = {v: min(1, min(q * m / max(k + 1 for k, x in enumerate(known) if x == q) for q in known if q >= v)) for v in known}
    holm = {v: min(1, max((m - known.index(q)) * q for q in known if q <= v)) for v in known}
    for family in (None, ["fam"]):
        got = {r.feature_id: r for r in multitest.adjust(t, "fdr_bh", family).collect()}
        hol = {r.feature_id: r for r in multitest.adjust(t, "holm", family).collect()}
        for i, v in enumerate(p):
            if v is None:
                assert got[i].p_fdr_bh is None and not got[i].reject
            else:
                assert got[i].p_fdr_bh == pytest.approx(bh[v]) and hol[i].p_holm == pytest.approx(holm[v])
    tests = pair_tests(obs, False)
    sets = {k: {r.feature_id for r in multitest.adjust(tests, k).where("reject").collect()} for k in multitest.METHODS}
    assert sets["bonferroni"] <= sets["holm"] <= sets["fdr_bh"] and sets["fdr_by"] <= sets["fdr_bh"]


def test_ordered_primitives_do_not_depend_on_partitions(spark):
    rng = np.random.default_rng(3)
    v = rng.integers(0, 50, 500)
    df = spark.createDataFrame([(i, int(x)) for i, x in enumerate(v)], "id long, v long")
    want = {int(i): k + 1 for k, i in enumerate(sorted(range(500), key=lambda i: (v[i], i)))}
    for parts in (1, 7):
        got = {r.id: r.rank for r in global_rank(df.repartition(parts), [F.col("v"), F.col("id")], parts=parts).collect()}
        assert got == want
        low = {r.id: r.m for r in suffix_min(df, F.col("v"), -F.col("id"), "m", parts).collect()}
        assert all(low[i] == min(-j for j in range(500) if v[j] >= v[i]) for i in range(0, 500, 17))
        upto = {r.id: r.c for r in cumulative_count(df, F.col("v"), F.col("id") % 2 == 0, "c", parts).collect()}
        assert all(upto[i] == sum(1 for j in range(0, 500, 2) if v[j] <= v[i]) for i in range(0, 500, 17))


def test_band_joins_match_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.random((150, 2)) * 10)] + [(200, 1.0, 1.0), (201, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "feature_id long, mass double, rtime double")
    want = {(i, j) for i, a, b in rows for j, c, d in rows if i < j and abs(a - c) <= 0.4 and abs(b - d) <= 0.7}
    assert {(r.i, r.j) for r in joins.masstime_duplicates(df, 0.4, 0.7).collect()} == want
    assert {(r.i, r.j) for r in joins.masstime_duplicates(df, 0.0, 0.0).collect()} == {(200, 201)}


def test_value_duplicates_match_brute_force(spark):
    rng = np.random.default_rng(6)
    x = rng.integers(0, 3, (30, 12))
    x[7] = x[3]
    x[9] = np.where(rng.random(12) < 0.2, 9, x[4])
    df = spark.createDataFrame([(i, s, int(x[i, s])) for i in range(30) for s in range(12)], "feature_id long, sample_id int, value int")
    for tol in (0.5, 0.75, 1.0):
        want = {(i, j): (x[i] == x[j]).mean() for i in range(30) for j in range(i + 1, 30) if (x[i] == x[j]).mean() >= tol}
        assert {(r.i, r.j): r.similarity for r in joins.value_duplicates(df, tol).collect()} == pytest.approx(want)


def test_leader_groups(spark):
    v = [0.0, 0.5, 0.9, 1.4, 3.0, 3.1, 10.0]
    df = spark.createDataFrame(list(enumerate(v)), "id long, v double")
    want = {0: 0.0, 1: 0.0, 2: 0.0, 3: 1.4, 4: 3.0, 5: 3.0, 6: 10.0}
    assert {r.id: r.leader for r in joins.leader_groups(df, "id", "v", 1.0).collect()} == want


def test_blocked_correlation_and_linkage_match_numpy(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(4, 30))
    x = np.vstack([base[i % 4] + 0.3 * rng.normal(size=30) for i in range(20)])
    packed = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "feature_id long, v array<double>")
    c = np.corrcoef(x)
    got = {(r.i, r.j): r.r for r in correlate.pearson_edges(packed, block=7).collect()}
    assert len(got) == 190 and all(v == pytest.approx(c[k]) for k, v in got.items())
    edges = correlate.correlation_distance(packed, 0.5)
    clusters = {r.node: r.cluster for r in correlate.complete_linkage(edges, 0.4).collect()}
    groups: dict = {}
    for n, g in clusters.items():
        groups.setdefault(g, []).append(n)
    assert all(1 - c[a, b] <= 0.4 + 1e-9 for g in groups.values() for a in g for b in g)
    heads = sorted(groups)
    for i, a in enumerate(heads):  # nothing is left to merge
        for b in heads[i + 1 :]:
            assert max(1 - c[u, w] for u in groups[a] for w in groups[b]) > 0.4
    lam = np.linalg.eigvalsh(c)
    assert correlate.n_eff_spectral(packed, "bretherton") == int(lam.sum() ** 2 / (lam**2).sum())
    assert correlate.n_eff_spectral(packed, "galwey") == int(np.sqrt(np.clip(lam, 0, None)).sum() ** 2 / lam.sum())


def test_permutation_thresholds_under_a_null(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(30, 20))
    packed = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "feature_id long, v array<double>")
    row = resample.mwsl(packed, 10, 0.05, 2000).first()
    assert 0.05 / 30 * 0.6 < row.mwsl < 0.05 / 30 * 2 and row.lo <= row.mwsl <= row.hi
    one = resample.permutation_extremes(packed.repartition(5), 10, 50).toPandas().sort_values("rep")
    two = resample.permutation_extremes(packed.coalesce(1), 10, 50, rep_block=7).toPandas().sort_values("rep")
    assert np.allclose(one.min_p, two.min_p) and np.allclose(one.max_t, two.max_t)


def test_elastic_net_meets_optimality(spark):
    rng = np.random.default_rng(10)
    x = rng.normal(size=(400, 4)) * [1, 5, 0.2, 2] + [3, 0, 1, -2]
    y = x @ [1.0, 0.0, 4.0, -0.5] + rng.normal(size=400) + 7
    df = spark.createDataFrame([(i, float(t), *map(float, r)) for i, (r, t) in enumerate(zip(x, y, strict=True))], "row_id long, y double, a double, b double, c double, d double")
    names = ["a", "b", "c", "d"]
    path = {(r.lam, r.variable): r.beta for r in regress.elastic_net_path(df, names, "y", [1.0], [0.0, 0.2]).collect()}
    ols = np.linalg.lstsq(np.column_stack([np.ones(400), x]), y, rcond=None)[0]
    assert np.allclose([path[0.0, n] for n in ["(intercept)", *names]], ols, atol=1e-6)
    b = np.array([path[0.2, n] for n in names])
    sd = x.std(0)
    score = ((x - x.mean(0)) / sd).T @ (y - y.mean() - (x - x.mean(0)) @ b) / 400
    assert all(abs(s - 0.2 * np.sign(v)) < 1e-6 if v else abs(s) <= 0.2 + 1e-6 for s, v in zip(score, b, strict=True))
    cv = regress.cv_lambda(df, names, "y", [1.0], 5).first()
    assert cv.lambda_1se >= cv.lambda_min and cv.mse < 1.5


def test_components_against_numpy(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(300, 5)) @ rng.normal(size=(5, 5)) + 1e4
    df = spark.createDataFrame([(i, int(i % 3), r.tolist()) for i, r in enumerate(x)], "vec_id long, label int, v array<double>").repartition(4)
    scored, values, vectors = factor.pca(df, F.col("v"), 2)
    cov = np.cov(x.T)
    assert np.allclose(values, np.linalg.eigvalsh(cov)[::-1][:2], rtol=1e-8)
    got = np.array([r.scores for r in scored.orderBy("vec_id").collect()])
    assert np.allclose(np.abs(got), np.abs((x - x.mean(0)) @ vectors), atol=1e-5)
    s, shrink = factor.ledoit_wolf(df, F.col("v"))
    assert 0 <= shrink <= 1 and np.trace(s) == pytest.approx(np.trace(cov) * 299 / 300)


def test_lloyd_and_nmi(spark):
    rng = np.random.default_rng(12)
    x = np.vstack([rng.normal(c, 0.1, (30, 2)) for c in ((0, 0), (5, 0), (0, 5))])
    df = spark.createDataFrame([(i, i // 30, r.tolist()) for i, r in enumerate(x)], "vec_id long, label int, v array<double>")
    start = [(k, x[k * 30].tolist()) for k in range(3)]
    for dist, rep in (("euclid", "mean"), ("manhattan", "median")):
        got, _ = cluster.k_representatives(df, 3, start, dist, rep, 5)
        assert stats.nmi(got, "label", "cluster").first()["nmi"] == pytest.approx(1)
    assert stats.nmi(df.withColumn("one", F.lit(1)), "label", "one").first()["nmi"] == 0


def test_rank_rule_and_spread(spark):
    df = spark.createDataFrame([("a", "m", 0.5), ("b", "m", -0.5), ("c", "m", 0.1), ("d", "m", 0.0)], "variable string, method string, value double")
    top = {r.variable: r["rank"] for r in ranks.rank_abs(df, ["method"]).collect()}
    low = {r.variable: r["rank"] for r in ranks.rank_abs(df, ["method"], ties="min", scale=True).collect()}
    assert top == {"a": 2, "b": 2, "c": 3, "d": 4} and low == {"a": 0, "b": 0, "c": 2, "d": 3}
    five = spark.createDataFrame([("a", r) for r in (3, 3, 3, 3, 4)], "variable string, rank long")
    # Fixed value: a published result
    assert ranks.rank_spread(five, ["variable"]).first().rank_sd == pytest.approx(0.447213595499958)


def test_tail_dependence_overlapping_runs_match_windows(spark):
    rng = np.random.default_rng(13)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.random((900, 2)))]
    df = spark.createDataFrame(rows, "feature_id long, p1 double, p2 double")
    got = {r.position: (r.share, r.half_width) for r in ranks.tail_dependence(df, "p1", "p2", 0.3, 0.8, 20).collect()}
    ordered = sorted(rows, key=lambda r: r[2])[:720]
    assert len(got) == 701
    for at in (1, 350, 701):
        w = ordered[at - 1 : at + 19]
        assert got[at] == pytest.approx((np.mean([r[1] < 0.3 for r in w]), (w[-1][2] - w[0][2]) / 2))


def test_posteriors(spark):
    y = spark.createDataFrame([("g", v) for v in (0, 1, 1, 0, 0, 0)], "g string, y int")
    row = bayes.beta_posterior(y, ["g"], "y", 2, 10, 0.9, 0.2).first()
    assert row["mean"] == pytest.approx(4 / 18) and row.lo < 4 / 18 < row.hi and 0 < row.below < 1
    m = spark.createDataFrame([("g", v) for v in (13.357, 14.928, 14.896, 14.820)], "g string, v double")
    post = bayes.mean_posterior(m, ["g"], "v").first()
    x = np.array([13.357, 14.928, 14.896, 14.820])
    half = 3.182446305 * x.std(ddof=1) / 2
    assert (post.lo, post.hi) == pytest.approx((x.mean() - half, x.mean() + half), rel=1e-8)
    arms = spark.createDataFrame([("t", 674, 39, 680, 22)], "k string, n1 long, y1 long, n2 long, y2 long")
    odds = bayes.odds_ratio_posterior(arms, "k", draws=20_000).first()
    assert 0.5 < odds["mean"] < 0.65 and odds.lo < odds["mean"] < odds.hi
    draws = spark.createDataFrame([(float(v), float(w)) for v, w in ((1, 0), (2, 0), (3, -1000))], "v double, lw double")
    s = bayes.importance_summary(draws, "lw", ["v"]).first()
    assert s.v == pytest.approx(1.5) and s.ess == pytest.approx(2)


def test_sobol_of_a_linear_model(spark):
    cols = ["a", "b"]
    one, two = (sensitivity.unit_sample(spark, 20_000, cols, s) for s in (1, 2))
    got = {r.factor: r for r in sensitivity.sobol_indices(one, two, cols, lambda x: 2 * x[0] + x[1]).collect()}
    assert got["a"].s1 == pytest.approx(0.8, abs=0.03) and got["b"].st == pytest.approx(0.2, abs=0.03)


def test_tokens_stems_and_tfidf(spark):
    docs = spark.createDataFrame([(1, "The _cats_ ran: 3 don't! naïve"), (2, None), (3, "cats cats dogs")], "doc_id long, text string")
    t = text.tokenize(docs, text.TokenOptions(("the",), 1))
    assert {r.doc_id: r.tokens for r in t.collect()} == {1: ["cats", "ran", "don"], 2: [], 3: ["cats", "cats", "dogs"]}
    flagged = text.tokenize(docs, text.TokenOptions((), 0, "flag")).where("doc_id = 1").first().tokens
    assert "numflag" in flagged
    assert {r.doc_id: r.tokens for r in text.stem_tokens(t).collect()}[3] == ["cat", "cat", "dog"]
    w = text.tfidf(text.ngram_counts(t, 1, 2)).toPandas()
    assert np.allclose(w.groupby("doc_id").weight.apply(lambda v: (v**2).sum()), 1)
    assert "cats cats" in set(w.term)


@pytest.mark.parametrize(("word", "want"), [("consistency", "consist"), ("knightly", "knight"), ("generalizations", "general"), ("hopping", "hop"), ("hoping", "hope"), ("skies", "sky"), ("ties", "tie"), ("happy", "happi"), ("say", "say"), ("relational", "relat"), ("proceed", "proceed"), ("by", "by")])
def test_stemmer(word, want):
    assert stem(word) == want


def test_pair_preparation_round_trip(spark):
    p = spark.createDataFrame([(1, "Élan vital!", "Go on."), (2, "go", "Go on, on.")], "pair_id long, a string, b string")
    n = p.select("pair_id", pairs.normalize_sentence(F.col("a")).alias("src"), pairs.normalize_sentence(F.col("b")).alias("tgt"))
    assert sorted(map(tuple, n.collect())) == [(1, "elan vital !", "go on ."), (2, "go", "go on on .")]
    v = pairs.build_vocab(n, "tgt")
    assert {r.word: (r["index"], r["count"]) for r in v.collect()} == {"go": (2, 2), "on": (3, 3), ".": (4, 2)}
    e = pairs.encode(n, v, "tgt")
    assert {r.pair_id: r.ids for r in e.collect()} == {1: [2, 3, 4, 1], 2: [2, 3, 3, 4, 1]}
    assert {r.pair_id: r.text for r in pairs.decode(e, v).collect()} == {1: "go on .", 2: "go on on ."}
    both = e.withColumnRenamed("ids", "tgt_ids").withColumn("src_ids", F.slice("tgt_ids", 1, 2))
    b = pairs.pad_batches(both, 2).toPandas()
    assert set(b.tgt_padded.map(len)) == {6} and sorted(b["mask"].map(sum)) == [5, 6]


def test_cleaning_rules(spark, obs):
    assert clean.fill_gaps(spark.createDataFrame([(1, None)], "a int, gap_status int")).first().gap_status == 0
    with pytest.raises(Exception, match="NaN"):
        clean.check_values(spark.createDataFrame([(float("nan"),)], "value double")).collect()
    c = obs.sparkSession.createDataFrame([("A-B", "A", "B")], "contrast string, grp_x string, grp_y string")
    rel = clean.reliability(obs, c, 0.9, (0,)).toPandas()
    assert len(rel) == 40 and (rel.gaps1 <= 8).all()
    assert clean.standardize(spark.createDataFrame([(1.0, 5.0), (1.0, 7.0)], "a double, b double"), ["a", "b"])[0].select(F.sum("a"), F.sum("b")).first() == (0.0, 0.0)


def test_sources_round_trip(spark, tmp_path):
    head = [["", "", "", "", "", "", "", ""] + g + [""] * 8 for g in (["x", "x", "y", "y"], [""] * 4, ["f1", "f2", "f3", "f4"])]
    rows = [[f"n{i}", "", "1.5", "", f"{100 + i}.25", "3.5", "", ""] + [str(i + k) for k in range(4)] + ["m"] * 4 + ["0", "8", "", "64"] for i in range(3)]
    (tmp_path / "m.csv").write_text("\n".join(";".join(r) for r in head + rows) + "\n")
    features, samples = tables.read_feature_matrix(spark, str(tmp_path / "m.csv"), 3, 8, 4)
    long = clean.melt_matrix(features.withColumn("feature_id", F.col("m0")), samples, [f"a{i}" for i in range(4)], [f"g{i}" for i in range(4)], ["feature_id"])
    got = {(r.feature_id, r.sample_id): (r.grp, r.value, r.gap_status) for r in long.collect()}
    assert len(got) == 12 and got["n2", "a3"] == ("y", 5.0, 64) and got["n0", "a2"] == ("y", 2.0, None)
    tests = spark.createDataFrame([(1, "A-B", 0.01, 2.0), (2, "A-B", 0.001, -3.0), (3, "A-B", 0.2, 9.0)], "feature_id long, contrast string, p_fdr_by double, fc double")
    tables.write_tests(tests, str(tmp_path / "out"), fc_min=1.0)
    back = tables.read_delimited(spark, str(tmp_path / "out"), ";", "feature_id long, contrast string, p_fdr_by double, fc double")
    assert [r.feature_id for r in back.collect()] == [2, 1]
    tables.write_by_source(tests.withColumn("source", F.col("contrast")), str(tmp_path / "by"), ids="feature_id")
    assert (tmp_path / "by" / "source=A-B").exists()
    (tmp_path / "p.txt").write_text("go\tva\nbroken line\nhi\tsalut\n")
    assert [(r.src, r.tgt) for r in tables.read_pairs(spark, str(tmp_path / "p.txt")).collect()] == [("va", "go"), ("salut", "hi")]
    assert tables.read_tagged(spark, [str(tmp_path / "m.csv")], "a string, b string", header=False).select("source").distinct().count() == 1


def test_buckshot_takes_the_square_root_sample_at_every_size(spark, monkeypatch):
    rng = np.random.default_rng(21)
    x = rng.normal(size=(90, 3))
    d0 = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    groups = [[i] for i in range(90)]
    while len(groups) > 7:
        gaps = {(a, b): d0[np.ix_(groups[a], groups[b])].mean() for a in range(len(groups)) for b in range(a)}
        a, b = min(gaps, key=gaps.get)
        groups[b] += groups.pop(a)
    got = cluster.average_groups(x, 7)
    assert {frozenset(np.flatnonzero(got == g)) for g in np.unique(got)} == set(map(frozenset, groups))
    asked = []
    few = spark.createDataFrame([(i, [float(i)]) for i in range(20)], "node long, v array<double>")
    monkeypatch.setattr(cluster, "keyed_rows", lambda df, n, key, seed: asked.append(n) or few)
    assert len(cluster.buckshot_init(spark.range(600_000), 8)) == 8
    assert asked == [int(np.sqrt(8 * 600_000))]


def test_nonnegative_factors_take_every_customer(spark, monkeypatch):
    from loamstat.plans import models

    seen = []
    monkeypatch.setattr(models.factor, "nmf", lambda cells, rank, n_iter: (seen.append(cells), None, [0.0]))
    models.nonnegative_factors(spark, "/root/testdata/sf0.001")
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    assert seen[0].select("i").distinct().count() == orders.select("o_custkey").distinct().count() > 50


@pytest.mark.parametrize("independent", [False, True])
def test_row_permutations_equal_packed_ones(spark, independent):
    """Rows in any order and partitioning give the extremes of the packed columns."""
    x = np.random.default_rng(22).normal(size=(3, 211)) + 5
    packed = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "feature_id long, v array<double>")
    rows = spark.createDataFrame([(i * 3 - 100, c.tolist()) for i, c in enumerate(x.T)], "vec_id long, v array<double>").repartition(7)
    want = resample.permutation_extremes(packed, 105, 40, independent=independent).toPandas().sort_values("rep")
    got = resample.row_permutation_extremes(rows, 105, 40, independent=independent, rep_block=9).toPandas().sort_values("rep")
    assert got.rep.tolist() == want.rep.tolist() and np.allclose(got.min_p, want.min_p) and np.allclose(got.max_t, want.max_t)
    edges = {(r.i, r.j): r.r for r in correlate.column_edges(rows).collect()}
    assert all(np.isclose(edges[r.i, r.j], r.r) for r in correlate.pearson_edges(packed).collect()) and len(edges) == 3


def test_column_queries_pack_no_samples(spark, monkeypatch):
    """No query over the dimensions puts all vectors into one row."""
    from loamstat.plans import models

    monkeypatch.setattr(models, "dimensions", None)
    for name in ("correlation_tests", "correlation_intervals", "effective_tests", "permutation_extremes", "significance_level", "significance_level_independent", "westfall_young"):
        assert models.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
