"""Permutation and bootstrap work over packed features.

A replicate's labels come from an arithmetic key of (replicate, sample), so
any partitioning and any engine repeats them.  Tasks hold a block of features
times a block of replicates; only a minimum or maximum per replicate leaves
them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamstat.functions.ordered import cumulative_count, global_rank
from loamstat.functions.special import t_two_sided
from loamstat.functions.sums import PART, added, parts
from loamstat.functions.work import materialize
from loamstat.operators.factor import covariance

MOD = 2_147_483_647


def keyed(rep: np.ndarray, ident: np.ndarray, seed: int) -> np.ndarray:
    """Portable key of (replicate, id): the fifth power, modulo a prime, of a sum of multiples of both.

    The power is a bijection (5 doesn't divide MOD - 1) and not linear: keys of another replicate are not the
    same ones moved on, which would only rotate one fixed order of the ids.
    """
    x = (rep.astype(np.int64)[:, None] * 1_103_515_245 + ident.astype(np.int64)[None, :] * 12_345 + seed) % MOD
    x2 = x * x % MOD
    return x2 * x2 % MOD * x % MOD


def shuffled_x(reps: np.ndarray, samples: np.ndarray, n_x: int, seed: int) -> np.ndarray:
    """Indicator (reps x samples) of the samples that a replicate puts in group X."""
    key = keyed(reps, samples, seed)
    order = np.lexsort((np.broadcast_to(samples, key.shape), key), axis=1)
    out = np.zeros(key.shape)
    np.put_along_axis(out, order[:, :n_x], 1.0, axis=1)
    return out


def block_t(x: np.ndarray, ind: np.ndarray, equal_var: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """t and degrees of freedom for all (replicate, feature) of a block, by matrix products."""
    return sums_t(ind @ x.T, ind @ (x * x).T, x.sum(1), (x * x).sum(1), x.shape[1], ind.sum(axis=1, keepdims=True), equal_var)


def sums_t(sx: np.ndarray, qx: np.ndarray, s: np.ndarray, q: np.ndarray, n: float, nx: np.ndarray | float, equal_var: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """t and degrees of freedom from the sums and squares of group X (replicates x features) and of all samples (features)."""
    ny = n - nx
    sy, qy = s[None, :] - sx, q[None, :] - qx
    vx, vy = np.maximum(qx - sx * sx / nx, 0) / (nx - 1), np.maximum(qy - sy * sy / ny, 0) / (ny - 1)
    if equal_var:
        dof = np.broadcast_to(n - 2.0, sx.shape)
        se = ((nx - 1) * vx + (ny - 1) * vy) / (n - 2) * (1 / nx + 1 / ny)
    else:
        a, b = vx / nx, vy / ny
        se = a + b
        dof = se * se / np.maximum(a * a / (nx - 1) + b * b / (ny - 1), 1e-300)
    with np.errstate(divide="ignore", invalid="ignore"):
        t = np.where(se > 0, (sx / nx - sy / ny) / np.sqrt(se), 0.0)
    return t, np.maximum(dof, 1e-3)


def permutation_extremes(packed: DataFrame, n_x: int, reps: int, seed: int = 1, equal_var: bool = False, rep_block: int = 500, key: str = "feature_id", independent: bool = False) -> DataFrame:
    """R1-R3's core: ``(rep, min_p, max_t)`` over all features; the first ``n_x`` samples are group X.

    Every task takes a partition of features and walks the replicates in
    blocks; the per-replicate extremes are then aggregated.  Replicate 0 is
    the identity.  ``independent`` gives every feature a shuffle of its own (R2).
    """

    def walk(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            if pdf.empty:
                continue
            x = np.stack(pdf.v.to_numpy())
            x = x - x.mean(axis=1, keepdims=True)  # t doesn't change; the sums keep their digits
            samples = np.arange(x.shape[1])
            for at in range(1, reps + 1, rep_block):
                own = np.arange(at, min(reps + 1, at + rep_block))
                if independent:
                    low, top = np.ones(len(own)), np.zeros(len(own))
                    for row, name in zip(x, pdf[key], strict=True):
                        t, dof = block_t(row[None, :], shuffled_x(own, samples, n_x, seed + int(name) * 7919), equal_var)
                        low, top = np.minimum(low, t_two_sided(t, dof)[:, 0]), np.maximum(top, np.abs(t)[:, 0])
                else:
                    t, dof = block_t(x, shuffled_x(own, samples, n_x, seed), equal_var)
                    low, top = t_two_sided(t, dof).min(axis=1), np.abs(t).max(axis=1)
                yield pd.DataFrame({"rep": own, "min_p": low, "max_t": top})

    part = packed.select(key, "v").mapInPandas(walk, "rep long, min_p double, max_t double")
    return part.groupBy("rep").agg(F.min("min_p").alias("min_p"), F.max("max_t").alias("max_t"))


def _added(df: DataFrame, step, shapes: list[tuple[int, ...]], dtype: type) -> list[np.ndarray]:  # noqa: ANN001
    """Arrays that ``step(pos, x)`` yields for a batch of rows, added within every partition and then by tasks over all."""

    def partial(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for pdf in pdfs:
            for at in range(0, len(pdf), 1000):
                few = pdf.iloc[at : at + 1000]
                got = step(few.pos.to_numpy(), np.stack(few.v.to_numpy()).astype(float))
                total = got if total is None else [a + b for a, b in zip(total, got, strict=True)]
        for k, whole in enumerate(total or []):
            flat = whole.ravel().astype(float)
            yield parts((k, i, flat[i : i + _PIECE]) for i in range(0, len(flat), _PIECE))

    got = added(df.select("pos", "v").mapInPandas(partial, PART))
    out = []
    for k, shape in enumerate(shapes):
        flat = np.zeros(int(np.prod(shape)))
        for (g, i), v in got.items():
            if g == k:
                flat[i : i + len(v)] = v
        out.append(flat.reshape(shape).astype(dtype))
    return out


#: Counts or sums that replicates of one tile may take: 64 MB, of which a task holds three at most.
TILE = 1 << 23
#: Numbers in one row of a partial array.
_PIECE = 1 << 16


def row_permutation_extremes(vectors: DataFrame, n_x: int, reps: int, seed: int = 1, equal_var: bool = False, independent: bool = False, key: str = "vec_id", rep_block: int = 200) -> DataFrame:
    """``permutation_extremes`` of the columns of ``(key, v array)``, with rows as samples in the order of ``key``.

    A replicate's keys differ (they are a bijection of the row's rank modulo a prime), so its group
    X is the rows with keys up to the n_x-th smallest.  That key is found by four rounds of counts,
    eight bits each, that partitions add up; then the group's sums are added up the same way.
    Replicates come in tiles whose counts and sums take ``TILE`` numbers at most (one replicate at
    least), in a task as on the driver, which keeps two numbers a replicate.
    """
    rows = materialize(global_rank(vectors.select(key, "v"), [F.col(key), F.col("v")], "pos").select((F.col("pos") - 1).alias("pos"), "v"), "rows")
    n, mean, _ = covariance(rows, F.col("v"))
    m = len(mean)
    seeds = [seed + f * 7919 for f in range(m)] if independent else [seed]
    tile = max(1, TILE // max(256 * len(seeds), 2 * m))
    out = []
    for first in range(1, reps + 1, tile):
        rep = np.arange(first, min(reps + 1, first + tile))
        t, dof = _tile_t(rows, n, mean, n_x, rep, seeds, equal_var, rep_block)
        low, top = t_two_sided(t, dof).min(axis=1), np.abs(t).max(axis=1)
        out += [(int(r), float(a), float(b)) for r, a, b in zip(rep, low, top, strict=True)]
    return vectors.sparkSession.createDataFrame(out, "rep long, min_p double, max_t double")


def _tile_t(rows: DataFrame, n: int, mean: np.ndarray, n_x: int, rep: np.ndarray, seeds: list[int], equal_var: bool, rep_block: int) -> tuple[np.ndarray, np.ndarray]:
    """t and its degrees of freedom of all columns under the replicates ``rep``; one seed is shared by the columns."""
    m, reps, independent = len(mean), len(rep), len(seeds) > 1
    blocks = [slice(a, min(a + rep_block, reps)) for a in range(0, reps, rep_block)]
    edge = np.zeros((len(seeds), reps), np.int64)  # bits found of the n_x-th smallest key
    left = np.full((len(seeds), reps), n_x)  # its rank among the keys with these bits
    for shift in (24, 16, 8, 0):

        def count(pos: np.ndarray, _x: np.ndarray, shift: int = shift, edge: np.ndarray = edge) -> list[np.ndarray]:
            out = np.zeros((len(seeds), reps, 256), np.int64)
            for i, own in enumerate(seeds):
                for b in blocks:
                    k = keyed(rep[b], pos, own)
                    at, col = np.nonzero(k >> (shift + 8) == edge[i, b][:, None])
                    slots = at * 256 + ((k[at, col] >> shift) & 255)
                    out[i, b] = np.bincount(slots, minlength=(b.stop - b.start) * 256).reshape(-1, 256)
            return [out]

        up = np.cumsum(_added(rows, count, [(len(seeds), reps, 256)], np.int64)[0], axis=2)
        digit = (up < left[:, :, None]).sum(axis=2)
        left = left - np.where(digit > 0, np.take_along_axis(up, np.maximum(digit - 1, 0)[:, :, None], 2)[:, :, 0], 0)
        edge = edge * 256 + digit

    def add(pos: np.ndarray, x: np.ndarray) -> list[np.ndarray]:
        x = x - mean
        sx, qx = np.zeros((reps, m)), np.zeros((reps, m))
        for i, own in enumerate(seeds):
            side = slice(i, i + 1) if independent else slice(None)
            for b in blocks:
                ind = (keyed(rep[b], pos, own) <= edge[i, b][:, None]).astype(float)
                sx[b, side], qx[b, side] = ind @ x[:, side], ind @ (x[:, side] ** 2)
        return [sx, qx, x.sum(0), (x * x).sum(0)]

    return sums_t(*_added(rows, add, [(reps, m), (reps, m), (m,), (m,)], np.float64), n, float(n_x), equal_var)


def mwsl(packed: DataFrame, n_x: int, alpha: float = 0.05, reps: int = 1000, seed: int = 1, independent: bool = False) -> DataFrame:
    """Metabolome-wide significance level: the ``int(alpha * K)``-th (0-based) smallest minimum p,
    its 95 % order-statistic interval, ENT = alpha / level and R = ENT / M."""
    return level_of(permutation_extremes(packed, n_x, reps, seed, independent=independent), packed.count(), alpha, reps)


def level_of(ext: DataFrame, m: int, alpha: float, reps: int) -> DataFrame:
    """R1, R2 from the extremes of ``reps`` replicates over m features."""
    ranked = ext.withColumn("k", F.row_number().over(Window.orderBy("min_p", "rep")) - 1)  # one row per replicate
    spread = 1.96 * np.sqrt(reps * alpha * (1 - alpha))
    at = [int(alpha * reps), max(0, int(alpha * reps - spread)), min(reps - 1, int(alpha * reps + spread))]
    pick = ranked.agg(*[F.max(F.when(F.col("k") == k, F.col("min_p"))).alias(n) for k, n in zip(at, ("mwsl", "lo", "hi"), strict=True)])
    return pick.withColumns({"ent": alpha / F.col("mwsl"), "r": alpha / F.col("mwsl") / m})


def westfall_young(packed: DataFrame, n_x: int, reps: int, alpha: float = 0.05, seed: int = 1, equal_var: bool = True) -> DataFrame:
    """Thresholds for the minimum p and the maximum |t|: the ``int(alpha * n)``-th of the sorted extremes."""
    return thresholds_of(permutation_extremes(packed, n_x, reps, seed, equal_var), alpha, reps)


def thresholds_of(ext: DataFrame, alpha: float, reps: int) -> DataFrame:
    """R3 from the extremes of ``reps`` replicates."""
    both = ext.withColumns({"kp": F.row_number().over(Window.orderBy("min_p", "rep")) - 1, "kt": F.row_number().over(Window.orderBy(F.col("max_t").desc(), "rep")) - 1})
    k = int(alpha * reps)
    return both.agg(F.max(F.when(F.col("kp") == k, F.col("min_p"))).alias("p_threshold"), F.max(F.when(F.col("kt") == k, F.col("max_t"))).alias("t_threshold"))


def reiner_adjust(tests: DataFrame, resampled: DataFrame, key: list[str]) -> DataFrame:
    """Share of pooled resampled |t| at or above each observed |t|; one merged cumulative count, no cross join."""
    pool = resampled.select(F.abs("t").alias("__t"), F.lit(1).alias("__drawn"), *[F.lit(None).cast(dict(tests.dtypes)[k]).alias(k) for k in key])
    seen = tests.select(F.abs("t").alias("__t"), F.lit(0).alias("__drawn"), *key)
    merged = cumulative_count(pool.unionByName(seen).withColumn("__neg", -F.col("__t")), F.col("__neg"), F.col("__drawn") == 1, "__above")
    n = resampled.count()
    return tests.join(merged.where("__drawn = 0").select(*key, (F.col("__above") / n).alias("p_resampled")), key)


def bootstrap_effect(obs: DataFrame, x: str, y: str, reps: int, seed: int = 1, replace: bool = True, share: float = 1.0) -> DataFrame:
    """``(feature_id, rep, effect)``: difference of resampled group means.

    Each feature's two groups are ordered arrays; a draw is an arithmetic key of (replicate, position).
    """
    per = obs.where(F.col("grp").isin(x, y)).groupBy("feature_id", "grp").agg(F.array_sort(F.collect_list(F.struct("sample_id", "value"))).alias("s"))
    vec = lambda g, n: per.where(F.col("grp") == g).select("feature_id", F.col("s.value").alias(n))

    def draw(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rep = np.arange(reps)
        for pdf in pdfs:
            out = []
            for f, a, b in zip(pdf.feature_id, pdf.a, pdf.b, strict=True):
                means = []
                for side, v in enumerate((np.asarray(a), np.asarray(b))):
                    take = max(1, int(round(share * len(v))))
                    keys = keyed(rep, np.arange(len(v) if not replace else take) + side * 100_003, seed + int(f))
                    means.append(v[keys % len(v)].mean(1) if replace else v[np.argsort(keys, axis=1, kind="stable")[:, :take]].mean(1))
                out.append(pd.DataFrame({"feature_id": f, "rep": rep, "effect": means[0] - means[1]}))
            if out:
                yield pd.concat(out)

    return vec(x, "a").join(vec(y, "b"), "feature_id").mapInPandas(draw, "feature_id long, rep long, effect double")


def group_permutation(obs: DataFrame, contrasts: DataFrame, reps: int, seed: int = 1, shifts: DataFrame | None = None) -> DataFrame:
    """Labels of all groups permuted inside each feature; ``(rep, contrast, feature_id, p)`` of every test.

    A shuffled order of samples takes the group sizes in turn.  Its keys come from the replicate and the
    sample's name, so features share an order also where they lack some samples.
    ``shifts`` (feature_id, grp, shift) are known effects added after the permutation.
    """
    groups = [r["grp"] for r in obs.select("grp").distinct().orderBy("grp").collect()]  # a handful of groups
    pairs = [(r["contrast"], r["grp_x"], r["grp_y"]) for r in contrasts.collect()]
    ident = F.crc32(F.col("sample_id").cast("string").cast("binary")).alias("ident")
    packed = obs.groupBy("feature_id").agg(F.array_sort(F.collect_list(F.struct("grp", "sample_id", "value", ident))).alias("s"))
    per = packed.select("feature_id", F.col("s.grp").alias("g"), F.col("s.value").alias("v"), F.col("s.ident").alias("ident"))
    if shifts is None:
        per = per.withColumn("shift", F.lit(None).cast("map<string,double>"))
    else:
        known = shifts.groupBy("feature_id").agg(F.map_from_entries(F.collect_list(F.struct("grp", F.col("shift").cast("double")))).alias("shift"))
        per = per.join(known, "feature_id", "left")

    def walk(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rep = np.arange(1, reps + 1)
        for pdf in pdfs:
            for f, g, v, ident, more in zip(pdf.feature_id, pdf.g, pdf["v"], pdf["ident"], pdf["shift"], strict=True):
                v, g = np.asarray(v, float), np.asarray(g)
                mixed = v[np.argsort(keyed(rep, np.asarray(ident), seed), axis=1, kind="stable")]
                if more is not None:
                    more = dict(more)
                    mixed = mixed + np.array([more.get(x, 0.0) for x in g])[None, :]
                part = {}
                for name in groups:
                    own = mixed[:, g == name]
                    part[name] = (own.shape[1], own.mean(1), own.var(1, ddof=1)) if own.shape[1] > 1 else None
                for contrast, x, y in pairs:
                    if part.get(x) and part.get(y):
                        (nx, mx, vx), (ny, my, vy) = part[x], part[y]
                        a, b = vx / nx, vy / ny
                        se = np.maximum(a + b, 1e-300)
                        dof = se * se / np.maximum(a * a / (nx - 1) + b * b / (ny - 1), 1e-300)
                        yield pd.DataFrame({"rep": rep, "contrast": contrast, "feature_id": f, "p": t_two_sided((mx - my) / np.sqrt(se), dof)})

    return per.mapInPandas(walk, "rep long, contrast string, feature_id long, p double")


def sampled_effect(obs: DataFrame, x: str, y: str, reps: int, seed: int = 1) -> DataFrame:
    """``(feature_id, rep, effect)``: the difference of one value drawn from each group."""
    return bootstrap_effect(obs, x, y, reps, seed, replace=True, share=0.0)
