"""All pairs block by block: few copies of a row, tiles that cover all pairs once."""

from __future__ import annotations

import numpy as np
import pytest

from loamstat.functions import blocks
from loamstat.operators import cluster, correlate, two_level


def test_copies_of_a_row_are_few():
    """615,000 rows of 64 numbers (6 GB of input) were copied 616 times in blocks of 1000."""
    assert -(-615_000 // blocks.block_rows(615_000, 64)) <= 31
    # two blocks of wide rows still fit a task, and no block is smaller than before
    assert blocks.block_rows(10**6, 1280) == blocks.LEAST and blocks.block_rows(10**6, 10**5) == blocks.LEAST
    assert blocks.block_rows(300, 64) * 64 <= 2 * blocks.BLOCK_NUMBERS


def test_tiles_meet_every_pair_once():
    seen = np.zeros((700, 5000), int)
    for x, y in blocks.tiles(*seen.shape, False):
        seen[x, y] += 1
    assert (seen == 1).all()
    seen = np.zeros((5000, 5000), int)
    for x, y in blocks.tiles(*seen.shape, True):
        seen[x, y] += 1
    assert seen.max() == 1 and (seen[np.triu_indices(5000, 1)] == 1).all() and seen.sum() < seen.size * 0.8


@pytest.mark.parametrize("block", [None, 40])
def test_pairs_equal_numpy(spark, block):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(333, 5)).astype(np.float32).astype(float)
    x[5] = 1.0  # constant
    label = [None if i % 50 == 0 else i % 3 for i in range(len(x))]
    df = spark.createDataFrame([(i * 3, v.tolist(), c) for i, (v, c) in enumerate(zip(x, label, strict=True))], "vec_id long, v array<double>, label int")
    i, j = np.triu_indices(len(x), 1)
    r = np.nan_to_num(np.array([np.corrcoef(x[a], x[b])[0, 1] if 5 not in (a, b) else 0.0 for a, b in zip(i, j, strict=True)]))
    got = {(e.i // 3, e.j // 3): e.r for e in correlate.pearson_edges(df, key="vec_id", min_r=0.3, block=block).collect()}
    assert got.keys() == {(int(a), int(b)) for a, b, c in zip(i, j, r, strict=True) if c >= 0.3}
    assert all(abs(got[a, b] - c) < 1e-9 for a, b, c in zip(i, j, r, strict=True) if c >= 0.3)

    d = np.sqrt(((x[i] - x[j]) ** 2).sum(1))
    want: dict = {}
    for a, b, s in zip(i, j, np.minimum((d / 4 * 8).astype(int), 7), strict=True):
        k = (label[a] is not None and label[a] == label[b], int(s))
        want[k] = want.get(k, 0) + 1
    assert {(e.within, e.bin): e.n for e in cluster.class_distances(df, "label", 8, 4.0, block=block).collect()} == want


def test_replicates_meet_inside_themselves(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(2, 90, 6))
    df = spark.createDataFrame([(r, i, x[r, i].tolist()) for r in range(2) for i in range(90)], "rep long, feature_id long, v array<double>")
    got = {(e.rep, e.i, e.j) for e in two_level.replicate_edges(df, 0.5, block=20).collect()}
    c = [np.corrcoef(m) for m in x]
    assert got == {(r, i, j) for r in range(2) for i in range(90) for j in range(i + 1, 90) if c[r][i, j] >= 0.5}
