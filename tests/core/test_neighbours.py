"""The two-level index against exact neighbours; average linkage in rounds against the driver's."""

from __future__ import annotations

import numpy as np
import pytest

from loamstat.operators import cluster, joins


def frame(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, v array<double>").repartition(3)


def clustered(seed, n, d, groups):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(groups, d))[rng.integers(0, groups, n)] * 2 + rng.normal(size=(n, d))


@pytest.mark.parametrize("metric", ["euclid", "cosine"])
def test_all_cells_give_exact_neighbours(spark, metric):
    x = clustered(1, 400, 6, 9)
    df = frame(spark, x)
    few = df.where("vec_id % 20 = 0")
    exact = joins.knn(few, df, 5, metric, vec="v").orderBy("key", "rank").collect()
    every = joins.knn_two_level(few, df, 5, (1000, 1000), metric, vec="v").orderBy("key", "rank").collect()
    assert [(r.key, r.neighbour) for r in exact] == [(r.key, r.neighbour) for r in every]


def test_recall_and_work(spark):
    x = clustered(2, 3_000, 12, 25)
    x[:700] = x[0]  # a hot cell of equal rows
    df = frame(spark, x)
    few = df.where("vec_id % 20 = 0 and vec_id >= 700")
    exact = joins.knn(few, df, 5, vec="v").toPandas()
    near = joins.knn_two_level(few, df, 5, vec="v", block=200).toPandas()
    got = exact.merge(near, on=["key", "neighbour"])
    assert len(got) >= 0.9 * len(exact)


def test_recall_on_the_given_vectors(spark):
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    few = e.where("vec_id % 20 = 0")
    exact, near = joins.knn(few, e, 5).toPandas(), joins.knn_two_level(few, e, 5).toPandas()
    assert len(exact.merge(near, on=["key", "neighbour"])) >= 0.9 * len(exact)


def test_an_empty_index(spark):
    df = frame(spark, np.zeros((3, 2)))
    assert joins.knn_two_level(df, df.where("vec_id < 0"), 2, vec="v").count() == 0


@pytest.mark.parametrize(("n", "k"), [(60, 5), (7, 7), (3, 5), (40, 1)])
def test_average_linkage_in_rounds(spark, n, k):
    x = clustered(n, n, 4, 6)
    df = frame(spark, x)
    rows = df.selectExpr("vec_id AS node", "v")
    got = {r.node: r.cluster for r in cluster.average_linkage(cluster._pair_distances(rows, 16), rows.select("node"), k).collect()}
    want = cluster.average_groups(x, k)
    first = {}
    for i, g in enumerate(want):
        first.setdefault(g, i)
    assert got == {i: first[g] for i, g in enumerate(want)}


def test_buckshot_centres_are_members(spark):
    x = clustered(4, 300, 3, 4)
    centres = cluster.buckshot_init(frame(spark, x), 4)
    assert len(centres) == 4 and all(np.abs(x - np.array(c)).sum(1).min() < 1e-12 for _, c in centres)


def test_graph_and_quantisation_on_the_index(spark):
    x = clustered(6, 150, 4, 5)
    df = frame(spark, x)
    pairs = lambda g: {(r.i, r.j): round(r.weight, 9) for r in g.collect()}
    assert pairs(cluster.similarity_graph(df, "rbf", 0.5, 4)) == pairs(cluster.similarity_graph(df, "rbf", 0.5, 4, recall=1.0))
    a = {r.vec_id: r.v for r in cluster.noisy_vq(df, 3, 0.1).collect()}
    b = {r.vec_id: r.v for r in cluster.noisy_vq(df, 3, 0.1, recall=1.0).collect()}
    assert a.keys() == b.keys() and all(np.allclose(a[i], b[i]) for i in a)


def brute(x, names, queries, k, metric):
    """``{query: neighbours}`` by exact differences; ties go to the smaller key."""
    out = {}
    for q in queries:
        if metric == "cosine":
            u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
            d = 1 - (u * u[q]).sum(1)
        else:
            d = np.sqrt(((x - x[q]) ** 2).sum(1))
        order = [j for j in np.lexsort((names, d)) if j != q and np.isfinite(d[j])]
        out[int(names[q])] = [int(names[j]) for j in order[:k]]
    return out


@pytest.mark.parametrize("metric", ["euclid", "cosine"])
@pytest.mark.parametrize("block", [70, None])
def test_equal_rows_tie_exactly(spark, metric, block, monkeypatch):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 17)) + 30  # far from 0, so products lose digits
    x[5], x[6:140] = x[5] * 1e3, x[3]  # an outlier, many copies
    x[200:220] = x[190] + 1e-9 * rng.normal(size=(20, 17))
    df = frame(spark, x)
    want = brute(x, np.arange(300), range(300), 7, metric)
    near = joins.knn(df, df, 7, metric, vec="v", block=block).orderBy("key", "rank").collect()
    few = joins.knn(df.where("vec_id % 3 = 0"), df, 7, metric, vec="v", block=block).orderBy("key", "rank").collect()
    copies = {3, *range(6, 140)}
    for got, asked in ((near, range(300)), (few, range(0, 300, 3))):
        found = {}
        for r in got:
            found.setdefault(r.key, []).append(r.neighbour)
        assert found.keys() == set(asked)
        assert all(found[q] == want[q] for q in asked if metric == "euclid" or q in copies)


def test_few_pairs_are_held(monkeypatch):
    monkeypatch.setattr(joins, "NEAR_PAIRS", 50)
    monkeypatch.setattr(joins, "SEEDS", 8)
    rng = np.random.default_rng(9)
    x = np.round(rng.normal(size=(90, 3)), 1)
    x[40] = np.nan
    own, names = np.arange(50), np.arange(50, 90)
    rows, columns = (b.to_pandas() for b in joins._met(own, x[:50], names, x[50:], 4, "euclid", True))
    for got, a, b in ((rows, own, names), (columns, names, own)):
        d = np.sqrt(((x[a][:, None] - x[b][None]) ** 2).sum(2))
        want = [(int(a[i]), int(b[j])) for i in range(len(a)) for j in np.lexsort((b, d[i]))[:4] if np.isfinite(d[i, j])]
        assert list(zip(got.key, got.neighbour, strict=True)) == want


def test_graph_finds_neighbours_once(spark):
    df = frame(spark, clustered(7, 60, 4, 3))
    plan = cluster.laplacian(cluster.similarity_graph(df, "rbf", 0.5, 4))._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroups" not in plan
