"""Joins and searches that make many rows of few: the work is dealt, whatever the tables' size."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from loamstat.operators import joins


@pytest.mark.parametrize(("dm", "dt"), [(1.0, 2.5), (0.0, 2.5), (1.0, 0.0)])
def test_band_pairs_are_dealt_and_complete(spark, dm, dt):
    rng = np.random.default_rng(3)
    rows = [(int(k), float(m), float(t)) for k, m, t in zip(rng.permutation(300), rng.integers(-5, 5, 300), rng.integers(-400, 400, 300) / 10, strict=True)]
    out = joins.masstime_duplicates(spark.createDataFrame(rows, "feature_id long, mass double, rtime double"), dm, dt)
    want = sorted((a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and abs(a[1] - b[1]) <= dm and abs(a[2] - b[2]) <= dt)
    assert sorted((r["i"], r["j"]) for r in out.collect()) == want
    if dm and dt:  # keys are whole numbers
        assert out.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("k", [1, 3])
def test_a_task_keeps_nearest_rows_a_few_queries_at_a_time(monkeypatch, k):
    monkeypatch.setattr(joins, "HELD", 90)
    rng = np.random.default_rng(5)
    v = rng.integers(0, 3, (40, 2)).astype(float)  # many ties
    pdf = pd.DataFrame({"key": np.r_[np.arange(40), np.arange(40)], "v": [*v, *v], "q": np.repeat([True, False], 40)})
    got = joins._nearest(k, "euclid")(pdf)
    for key, part in got.groupby("key"):
        d = np.sqrt(((v - v[key]) ** 2).sum(1))
        want = sorted((x, j) for j, x in enumerate(d) if j != key)[:k]
        assert list(part.neighbour) == [j for _, j in want] and np.allclose(part.distance, [x for x, _ in want])


def test_all_cells_copy_no_query_into_cells(spark, monkeypatch):
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(rng.normal(size=(200, 3)))], "vec_id long, v array<double>")
    index = joins.two_level_index(df, vec="v")
    monkeypatch.setattr(joins, "_to_second_level", lambda *a: pytest.fail("a query is copied into every cell"))
    assert joins.search_index(index, df, 2, (1 << 20, 1 << 20), vec="v").count() == 400


@pytest.mark.parametrize("tol", [0.5, 0.75, 1.0])
def test_few_values_are_compared_block_by_block(spark, monkeypatch, tol):
    """Pairs that share a rare cell aren't made where that is nearly all of them; missing cells equal nothing."""
    monkeypatch.setattr(joins, "HELD", 3000)
    monkeypatch.setattr(joins, "dealt_block", lambda n: 25)
    rng = np.random.default_rng(7)
    x = rng.integers(-1, 2, (90, 8))
    lost = rng.random(x.shape) < 0.1
    lost[:, 0] = False
    lost[3] = False
    rows = [(i, s, None if rng.random() < 0.5 else int(x[i, s])) if lost[i, s] else (i, s, int(x[i, s])) for i in range(90) for s in range(8) if not lost[i, s] or rng.random() < 0.5]
    have = {(i, s): v for i, s, v in rows if v is not None}
    n = max(sum(1 for r in rows if r[0] == i) for i in range(90))
    same = lambda i, j: sum((i, s) in have and (j, s) in have and have[i, s] == have[j, s] for s in range(8))
    want = {(i, j): same(i, j) / n for i in range(90) for j in range(i + 1, 90) if same(i, j) >= tol * n}
    called = []
    whole = joins._equal_cells
    monkeypatch.setattr(joins, "_equal_cells", lambda *a: called.append(1) or whole(*a))
    out = joins.value_duplicates(spark.createDataFrame(rows, "feature_id long, sample_id int, value int"), tol)
    assert {(r.i, r.j): r.similarity for r in out.collect()} == pytest.approx(want) and called


@pytest.mark.parametrize(("dm", "dt"), [(1.0, 2.5), (0.0, 2.5), (1.0, 0.0), (0.0, 0.0)])
def test_few_places_meet_with_lists_of_keys(spark, dm, dt):
    """Rows of one place are joined as one; pairs are those of the rows, a key in two places included."""
    rng = np.random.default_rng(9)
    rows = [(int(k), float(m), float(t)) for k, m, t in zip(rng.permutation(500), rng.integers(-2, 2, 500), rng.integers(-8, 8, 500) / 2, strict=True)] + [(3, 0.0, 0.5), (3, 1.0, 0.5)]
    df = spark.createDataFrame(rows, "feature_id long, mass double, rtime double")
    out = joins.masstime_duplicates(df, dm, dt)
    assert "keys_r" in out._jdf.queryExecution().toString() and "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    want = sorted((a[0], b[0], abs(a[1] - b[1]), abs(a[2] - b[2])) for a in rows for b in rows if a[0] < b[0] and abs(a[1] - b[1]) <= dm and abs(a[2] - b[2]) <= dt)
    assert sorted(map(tuple, out.collect())) == want
