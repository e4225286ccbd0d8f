"""Components, factorisations and discriminants from distributed cross-products.

Sums over rows are distributed: every partition makes its d x d matrix (d the
number of columns) and tasks add them up.  The d x d algebra that follows runs
on the driver, which gets one such matrix (134 MB at ``MAX_COLUMNS``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamstat.functions.sums import PART, added, parts
from loamstat.functions.work import materialize

#: Columns up to which a d x d matrix may come to the driver.
MAX_COLUMNS = 4096


def cross_products(df: DataFrame, x: Column, weight: Column | None = None, by: str | None = None) -> dict:
    """``{group: (n, sum x, x'x)}`` of an array column: one job, partial matrices added up in tasks.

    ``by`` is a column with few groups (classes, folds, replicates of a bootstrap).
    The driver gets one d x d matrix a group.
    """
    cols = [x.alias("x"), (weight if weight is not None else F.lit(1.0)).cast("double").alias("w"), (F.col(by) if by else F.lit(0)).cast("long").alias("g")]

    def partial(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for pdf in pdfs:
            for g, part in pdf.groupby("g"):
                m, w = np.stack(part.x.to_numpy()).astype(float), part.w.to_numpy()
                if m.shape[1] > MAX_COLUMNS:
                    raise ValueError("too many columns for a driver-side solve")
                wm = m * w[:, None]
                n, s, q = held.get(g, (0.0, 0.0, 0.0))
                held[g] = (n + w.sum(), s + wm.sum(0), q + wm.T @ m)
        for g, (n, s, q) in held.items():
            yield parts([(g, -1, np.append(s, n)), *((g, i, row) for i, row in enumerate(q))])

    got = added(df.select(*cols).where(F.col("x").isNotNull()).mapInPandas(partial, PART))
    out: dict = {}
    for g in sorted({g for g, _ in got}):
        s = got[g, -1]
        out[g] = (float(s[-1]), s[:-1], np.stack([got[g, i] for i in range(len(s) - 1)]))
    return out


def covariance(df: DataFrame, x: Column) -> tuple[float, np.ndarray, np.ndarray]:
    """n, mean and sample covariance.  A shift by the first row's values keeps the digits."""
    first = df.select(x.alias("x")).first()
    if first is None:
        raise ValueError("no rows")
    shift = np.array(first["x"], float)
    moved = F.zip_with(x, F.array(*[F.lit(float(v)) for v in shift]), lambda a, b: a - b)
    n, s, q = cross_products(df, moved)[0]
    return n, s / n + shift, (q - np.outer(s, s) / n) / (n - 1)


def signed(vectors: np.ndarray) -> np.ndarray:
    """Eigenvectors as columns with their largest entry positive."""
    at = np.abs(vectors).argmax(axis=0)
    return vectors * np.where(vectors[at, range(vectors.shape[1])] < 0, -1.0, 1.0)


def _top(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    values, vectors = np.linalg.eigh(matrix)
    order = np.argsort(values)[::-1][:k]
    return values[order], signed(vectors[:, order])


def project(x: Column, mean: np.ndarray, directions: np.ndarray) -> Column:
    """Scores ``(x - mean) @ directions`` as an array column, in built-in functions."""
    centred = F.zip_with(x, F.array(*[F.lit(float(v)) for v in mean]), lambda a, b: a - b)
    dot = lambda d: F.aggregate(F.zip_with(centred, F.array(*[F.lit(float(v)) for v in d]), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return F.array(*[dot(d) for d in directions.T])


def pca(df: DataFrame, x: Column, k: int) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """L1: rows with ``scores``, eigenvalues, directions (columns)."""
    _, mean, cov = covariance(df, x)
    values, vectors = _top(cov, k)
    return df.withColumn("scores", project(x, mean, vectors)), values, vectors


def bootstrap_pca(df: DataFrame, x: Column, k: int, reps: int, key: str, seed: int = 1) -> list[tuple[np.ndarray, np.ndarray]]:
    """L1: eigenvalues and directions of Poisson(1) bootstrap replicates, signs aligned with the full sample's."""
    full = _top(covariance(df, x)[2], k)[1]
    reps_col = F.explode(F.sequence(F.lit(0), F.lit(reps - 1)))
    u = (F.pmod(F.xxhash64(F.col(key), F.col("rep"), F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    cdf, p, total = [], np.exp(-1.0), 0.0
    for i in range(8):
        total += p
        cdf.append(total)
        p /= i + 1
    weight = sum((F.when(u > c, 1).otherwise(0) for c in cdf[1:]), F.when(u > cdf[0], 1).otherwise(0))
    drawn = df.select(F.col(key), x.alias("__x")).withColumn("rep", reps_col).withColumn("__w", weight).where("__w > 0")
    out = []
    for _, (n, s, q) in sorted(cross_products(drawn, F.col("__x"), F.col("__w"), "rep").items()):
        values, vectors = _top((q - np.outer(s, s) / n) / (n - 1), k)
        out.append((values, vectors * np.where((vectors * full).sum(0) < 0, -1.0, 1.0)))
    return out


def ppca(df: DataFrame, x: Column, q: int) -> tuple[DataFrame, float, np.ndarray]:
    """L2: probabilistic PCA: rows with the latent's posterior mean ``latent``, noise variance, loadings."""
    n, mean, cov = covariance(df, x)
    cov = cov * (n - 1) / n
    values, vectors = _top(cov, len(cov))
    noise = float(values[q:].mean()) if q < len(values) else 0.0
    w = vectors[:, :q] * np.sqrt(np.maximum(values[:q] - noise, 0))
    inner = np.linalg.inv(w.T @ w + noise * np.eye(q))
    return df.withColumn("latent", project(x, mean, w @ inner)), noise, w


def _soft(v: np.ndarray | float, t: float) -> np.ndarray:
    return np.sign(v) * np.maximum(np.abs(v) - t, 0)


def elastic_descent(q: np.ndarray, c: np.ndarray, l1: float, l2: float, start: np.ndarray | None = None, rounds: int = 2000, tol: float = 1e-10) -> np.ndarray:
    """Coordinate descent for 1/2 b'Qb - c'b + l1 |b|_1 + l2/2 |b|^2."""
    b = np.zeros(len(c)) if start is None else start.copy()
    for _ in range(rounds):
        most = 0.0
        for j in range(len(c)):
            if q[j, j] + l2 <= 0:
                continue
            new = _soft(c[j] - q[j] @ b + q[j, j] * b[j], l1) / (q[j, j] + l2)
            most = max(most, abs(new - b[j]))
            b[j] = new
        if most < tol:
            break
    return b


def elastic_descents(q: np.ndarray, c: np.ndarray, l1: float, l2: float, rounds: int = 2000, tol: float = 1e-10) -> np.ndarray:
    """``elastic_descent`` of many problems at once, ``q`` (m, d, d) and ``c`` (m, d); each stops by itself."""
    b = np.zeros(c.shape)
    left = np.arange(len(c))  # the problems that still move
    for _ in range(rounds):
        qs, cs, now = q[left], c[left], b[left]
        most = np.zeros(len(left))
        for j in range(c.shape[1]):
            size = qs[:, j, j] + l2
            some = size > 0
            new = _soft(cs[:, j] - (qs[:, j] * now).sum(1) + qs[:, j, j] * now[:, j], l1) / np.where(some, size, 1.0)
            new = np.where(some, new, now[:, j])
            most = np.fmax(most, np.abs(new - now[:, j]))
            now[:, j] = new
        b[left] = now
        left = left[most >= tol]
        if not len(left):
            break
    return b


def sparse_pca(df: DataFrame, x: Column, k: int, alpha: float, l1_ratio: float = 0.5, rounds: int = 100) -> np.ndarray:
    """L3: sparse loadings by alternating elastic net and SVD on the covariance."""
    cov = covariance(df, x)[2]
    a = _top(cov, k)[1]
    b = a.copy()
    for _ in range(rounds):
        old = b.copy()
        for j in range(k):
            b[:, j] = elastic_descent(cov, cov @ a[:, j], alpha * l1_ratio, alpha * (1 - l1_ratio), b[:, j])
        u, _, vt = np.linalg.svd(cov @ b, full_matrices=False)
        a = u @ vt
        if np.abs(b - old).max() < 1e-8:
            break
    norm = np.linalg.norm(b, axis=0)
    return b / np.where(norm > 0, norm, 1)


def irls(df: DataFrame, x: list[str], y: str, p: float = 1.0, max_iter: int = 30, tol: float = 1e-8) -> np.ndarray:
    """L4: Lp regression by reweighted least squares on centred predictors, without an intercept; one aggregation an iteration."""
    d = len(x)
    n, s, _ = cross_products(df, F.array(*[F.col(c).cast("double") for c in x]))[0]
    centred = [F.col(c).cast("double") - float(m) for c, m in zip(x, s / n, strict=True)]
    row = F.array(*centred, F.col(y).cast("double"))
    _, _, q = cross_products(df, row)[0]
    beta = np.linalg.lstsq(q[:d, :d], q[:d, d], rcond=None)[0]
    for _ in range(max_iter):
        fit = sum((c * float(b) for c, b in zip(centred, beta, strict=True)), F.lit(0.0))
        weight = F.pow(F.greatest(F.abs(F.col(y) - fit), F.lit(1e-6)), F.lit(p - 2.0))
        _, _, q = cross_products(df, row, weight)[0]
        new = np.linalg.lstsq(q[:d, :d], q[:d, d], rcond=None)[0]
        done = np.abs(new - beta).max() < tol
        beta = new
        if done:
            break
    return beta


def factorize(cells: DataFrame, rank: int, reg: float = 0.1, n_iter: int = 10, nonnegative: bool = False, seed: int = 1):  # noqa: ANN201
    """Matrix factorisation of observed cells ``(i, j, value)`` with an L2 penalty (alternating least squares)."""
    from pyspark.ml.recommendation import ALS

    return ALS(rank=rank, regParam=reg, maxIter=n_iter, userCol="i", itemCol="j", ratingCol="value", nonnegative=nonnegative, seed=seed, coldStartStrategy="drop").fit(cells)


def cv_factorization(cells: DataFrame, rank: int, holdout: float = 0.1, reg: float = 0.01, seed: int = 1) -> DataFrame:
    """Mean squared error on training and held-out cells: ``(held_out, mse, n)``; cells are held out by key."""
    marked = cells.withColumn("held_out", F.pmod(F.xxhash64("i", "j", F.lit(seed)), F.lit(10_000)) < int(holdout * 10_000))
    model = factorize(marked.where("not held_out"), rank, reg, seed=seed)
    return model.transform(marked).groupBy("held_out").agg(F.avg((F.col("value") - F.col("prediction")) ** 2).alias("mse"), F.count(F.lit(1)).alias("n"))


def _power(cells: DataFrame, side: str, other: str, names: list[str], factor: DataFrame) -> DataFrame:
    """``(side, x0..)``: the cells' matrix (or its transpose) times a tall factor."""
    return cells.join(factor, other).groupBy(side).agg(*[F.sum(F.col("value") * F.col(n)).alias(n) for n in names])


def sparse_svd(cells: DataFrame, rank: int, n_iter: int = 40, more: int = 4, seed: int = 1, tol: float = 1e-13) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """Leading singular triplets of a sparse table ``(i, j, value)`` by two-sided block iteration.

    Returns ``(i, x0..)``, ``(j, x0..)`` and the singular values.  A round is two joins of the cells with a tall
    factor; only (rank + more) x (rank + more) cross-products reach the driver.  Rounds end when the values
    change by less than ``tol`` of the largest (vectors are then right to about its root), or after ``n_iter``.
    """
    base = materialize(cells.select("i", "j", F.col("value").cast("double").alias("value")), "svd-cells")
    wide = min(rank + more, base.select("i").distinct().count(), base.select("j").distinct().count())
    if wide < 1:
        raise ValueError("no cells")
    names = [f"x{c}" for c in range(wide)]
    start = lambda c: (F.pmod(F.xxhash64("j", F.lit(seed), F.lit(c)), F.lit(1 << 40)) + 0.5) / float(1 << 39) - 1
    right = base.select("j").distinct().select("j", *[start(c).alias(n) for c, n in enumerate(names)])

    def turned(df: DataFrame, key: str, m: np.ndarray) -> DataFrame:
        return df.select(key, *[sum((F.col(a) * float(m[r, c]) for r, a in enumerate(names)), F.lit(0.0)).alias(n) for c, n in enumerate(names)])

    def gram(df: DataFrame) -> np.ndarray:
        return cross_products(df, F.array(*names))[0][2]

    def basis(df: DataFrame, key: str) -> DataFrame:
        """Orthonormal columns: twice by the square root of the Gram matrix, which keeps their digits."""
        for _ in range(2):
            values, vectors = np.linalg.eigh(gram(df))
            keep = values > values.max() * 1e-14
            scale = np.where(keep, 1 / np.sqrt(np.where(keep, values, 1.0)), 0.0)
            df = materialize(turned(df, key, (vectors * scale)[:, ::-1]), "basis")
        return df

    before = np.zeros(wide)
    for _ in range(n_iter):
        right = basis(right, "j")
        left = materialize(_power(base, "i", "j", names, right), "left")
        values, vectors = np.linalg.eigh(gram(left))  # left = A right, so its Gram matrix is right' A' A right
        values = np.sqrt(np.maximum(values[::-1], 0))
        if np.abs(values[:rank] - before[:rank]).max() <= tol * max(values[0], 1e-300):
            break
        before = values
        right = materialize(_power(base, "j", "i", names, left), "right")
    turn = vectors[:, ::-1]
    inverse = np.where(values > values[0] * 1e-12, 1 / np.maximum(values, 1e-300), 0.0)
    kept = names[:rank]
    return turned(left, "i", turn * inverse).select("i", *kept), turned(right, "j", turn).select("j", *kept), values[:rank]


def nndsvd(cells: DataFrame, rank: int, n_iter: int = 40, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """The non-negative double SVD start: ``(i, k, w)`` and ``(j, k, h)``.

    Of each pair of singular vectors the heavier of the two sign parts is taken, the first pair by size.
    Only 4 norms a component reach the driver.
    """
    left, right, values = sparse_svd(cells, rank, n_iter, seed=seed)
    names = left.columns[1:]

    def norms(df: DataFrame) -> list[tuple[float, float]]:
        part = lambda n, sign: F.sqrt(F.sum(F.greatest(sign * F.col(n), F.lit(0.0)) ** 2))
        row = df.agg(*[part(n, sign) for n in names for sign in (1, -1)]).first()
        return list(zip(row[::2], row[1::2], strict=True))

    def spread(df: DataFrame, key: str, scale: list[Column], name: str) -> DataFrame:
        each = F.array(*[F.struct(F.lit(c).alias("k"), x.alias(name)) for c, x in enumerate(scale)])
        return df.select(key, F.explode(each).alias("e")).select(key, "e.*")

    w, h = [], []
    for c, (n, (up, un), (vp, vn)) in enumerate(zip(names, norms(left), norms(right), strict=True)):
        if c == 0:
            pair = [F.abs(F.col(n)) * float(np.sqrt(values[0]))] * 2
        else:
            sign, nu, nv = (1, up, vp) if up * vp >= un * vn else (-1, un, vn)
            size = float(np.sqrt(values[c] * nu * nv))
            pair = [F.greatest(sign * F.col(n), F.lit(0.0)) * (size / m if m else 0.0) for m in (nu, nv)]
        w.append(pair[0])
        h.append(pair[1])
    return spread(left, "i", w, "w"), spread(right, "j", h, "h")


def nmf(cells: DataFrame, rank: int, n_iter: int = 10, seed: int = 1, init: str = "keyed", tol: float | None = None) -> tuple[DataFrame, DataFrame, list[float]]:
    """Non-negative factors ``(i, k, w)`` and ``(j, k, h)`` of cells (i, j, value) by multiplicative updates.

    Absent cells are 0.  ``init`` is ``keyed`` (uniform numbers by key) or ``nndsvd``.  Each update joins the
    cells with one factor and broadcasts a rank x rank Gram matrix.  Returns the squared-error path too; rounds
    end when the error (its root) falls by less than ``tol``, and that round's error is left out of the path.
    """
    if init not in ("keyed", "nndsvd"):
        raise ValueError("init must be keyed or nndsvd")
    base = materialize(cells.select("i", "j", F.col("value").cast("double").alias("value")).where("value > 0"), "cells")
    if init == "nndsvd":
        w, h = (materialize(f, "start") for f in nndsvd(base, rank, seed=seed))
        rank = max(w.agg(F.max("k")).first()[0] or 0, 0) + 1
    else:
        ks = F.explode(F.sequence(F.lit(0), F.lit(rank - 1)))
        u = lambda a: (F.pmod(F.xxhash64(F.col(a), F.col("k"), F.lit(seed)), F.lit(1 << 40)) + 1) / float(1 << 40)
        w = base.select("i").distinct().withColumn("k", ks).withColumn("w", u("i"))
        h = base.select("j").distinct().withColumn("k", ks).withColumn("h", u("j"))
    square = base.agg(F.sum(F.col("value") ** 2)).first()[0] or 0.0
    path: list[float] = []

    def gram(f: DataFrame, side: str, v: str) -> np.ndarray:
        packed = f.groupBy(side).agg(F.array_sort(F.collect_list(F.struct("k", v))).alias("s")).select(F.col(f"s.{v}").alias("x"))
        return cross_products(packed, F.col("x"))[0][2]

    def update(f: DataFrame, side: str, v: str, other: DataFrame, oside: str, ov: str) -> DataFrame:
        g = gram(other, oside, ov)
        top = base.join(other, oside).groupBy(side, "k").agg(F.sum(F.col("value") * F.col(ov)).alias("top"))
        table = f.sparkSession.createDataFrame([(a, b, float(g[a, b])) for a in range(rank) for b in range(rank)], "k int, k2 int, g double")
        low = f.join(F.broadcast(table), "k").groupBy(side, F.col("k2").alias("k")).agg(F.sum(F.col(v) * F.col("g")).alias("low"))
        return materialize(f.join(top, [side, "k"]).join(low, [side, "k"]).select(side, "k", (F.col(v) * F.col("top") / F.greatest("low", F.lit(1e-12))).alias(v)), "factor")

    for _ in range(n_iter):
        h = update(h, "j", "h", w, "i", "w")
        w = update(w, "i", "w", h, "j", "h")
        cross = base.join(w, "i").join(h, ["j", "k"]).agg(F.sum(F.col("value") * F.col("w") * F.col("h"))).first()[0] or 0.0
        error = float(square - 2 * cross + (gram(w, "i", "w") * gram(h, "j", "h")).sum())
        if tol is not None and path and np.sqrt(max(path[-1], 0)) - np.sqrt(max(error, 0)) < tol:
            break
        path.append(error)
    return w, h, path


def lsi(df: DataFrame, x: Column, names: list[str], k: int) -> DataFrame:
    """Truncated SVD (no centring): ``(component, name, weight)`` and its singular value."""
    q = cross_products(df, x)[0][2]
    values, vectors = _top(q, k)
    rows = [(c, names[i], float(vectors[i, c]), float(np.sqrt(max(values[c], 0)))) for c in range(k) for i in range(len(names))]
    return df.sparkSession.createDataFrame(rows, "component int, name string, weight double, singular double")


def top_latents(components: DataFrame, n: int) -> DataFrame:
    """The n names heaviest in size per component."""
    order = Window.partitionBy("component").orderBy(F.abs("weight").desc(), "name")
    return components.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def lda(df: DataFrame, x: Column, label: str, delta: float = 1e-3, k: int = 2) -> tuple[DataFrame, np.ndarray]:
    """Linear discriminant with ridge ``delta``: rows with ``scores`` and the nearest centroid's class ``predicted``; directions."""
    per = cross_products(df, x, by=label)
    n, s = sum(v[0] for v in per.values()), sum(v[1] for v in per.values())
    within = sum(q - np.outer(si, si) / ni for ni, si, q in per.values())
    grand = s / n
    between = sum(ni * np.outer(si / ni - grand, si / ni - grand) for ni, si, _ in per.values())
    values, vectors = np.linalg.eigh(within + delta * np.eye(len(grand)))
    half = vectors / np.sqrt(values)
    directions = signed(half @ _top(half.T @ between @ half, k)[1])
    scored = df.withColumn("scores", project(x, grand, directions))
    centres = {g: (si / ni - grand) @ directions for g, (ni, si, _) in per.items()}
    near = []
    for g, c in sorted(centres.items()):
        d = sum(((F.col("scores")[i] - float(v)) ** 2 for i, v in enumerate(c)), F.lit(0.0))
        near.append(F.struct(d.alias("d"), F.lit(int(g)).alias("g")))
    return scored.withColumn("predicted", F.array_min(F.array(*near))["g"]), directions


def pls(df: DataFrame, x: Column, y: Column, k: int) -> np.ndarray:
    """Partial-least-squares directions by deflating the cross-covariance."""
    both = F.concat(x, y)
    d = len(df.select(x.alias("x")).first()["x"])
    cov = covariance(df, both)[2]
    cxx, cxy = cov[:d, :d].copy(), cov[:d, d:].copy()
    out = []
    for _ in range(k):
        w = signed(np.linalg.svd(cxy, full_matrices=False)[0][:, :1])[:, 0]
        p = cxx @ w / (w @ cxx @ w)
        cxy = cxy - np.outer(p, w @ cxy)
        cxx = cxx - np.outer(p, w @ cxx)
        out.append(w)
    return np.stack(out, axis=1)


def ledoit_wolf(df: DataFrame, x: Column) -> tuple[np.ndarray, float]:
    """Shrunk covariance and its shrinkage, from the cross-products and the sum of |x - mean|^4."""
    n, mean, cov = covariance(df, x)
    s = cov * (n - 1) / n
    d = len(s)
    centred = F.zip_with(x, F.array(*[F.lit(float(v)) for v in mean]), lambda a, b: a - b)
    norm2 = F.aggregate(F.transform(centred, lambda v: v * v), F.lit(0.0), lambda a, v: a + v)
    fourth = df.agg(F.sum(norm2 * norm2)).first()[0]
    mu = np.trace(s) / d
    d2 = ((s - mu * np.eye(d)) ** 2).sum() / d
    b2 = min((fourth / n - (s**2).sum()) / n / d, d2)
    shrink = 0.0 if d2 == 0 else b2 / d2
    return (1 - shrink) * s + shrink * mu * np.eye(d), float(shrink)
