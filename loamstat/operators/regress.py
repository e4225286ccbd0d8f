"""Elastic-net paths, cross-validation, stability selection and coefficient bootstraps.

One pass gives the cross-products; every fit after it is coordinate descent on
a d x d matrix.  The objective is 1/(2n) |y - X b|^2 + lam (alpha |b|_1 +
(1 - alpha)/2 |b|^2) with standardised predictors and a centred target.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamstat.functions.blocks import matrix
from loamstat.functions.ordered import global_rank
from loamstat.functions.work import materialize
from loamstat.operators.factor import cross_products, elastic_descent, elastic_descents

COEFS = "alpha double, lam double, variable string, beta double"


def _row(x: list[str], y: str):  # noqa: ANN202
    return F.array(*[F.col(c).cast("double") for c in [*x, y]])


class Sums:
    """n, sums and cross-products of predictors and target; sums of disjoint row sets add and subtract."""

    def __init__(self, n: float, s: np.ndarray, q: np.ndarray) -> None:
        self.n, self.s, self.q = n, s, q

    def __sub__(self, other: Sums) -> Sums:
        return Sums(self.n - other.n, self.s - other.s, self.q - other.q)

    def standard(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Correlation-scale Q and c, predictor sds, target sd (population)."""
        mean = self.s / self.n
        cov = self.q / self.n - np.outer(mean, mean)
        sd = np.sqrt(np.maximum(np.diag(cov), 0))
        safe = np.where(sd > 1e-12, sd, 1.0)
        d = len(sd) - 1
        return cov[:d, :d] / np.outer(safe[:d], safe[:d]), cov[:d, d] / safe[:d], safe[:d], float(sd[d])

    def fit(self, alpha: float, lam: float, start: np.ndarray | None = None) -> tuple[float, np.ndarray]:
        """Intercept and coefficients on the original scale."""
        q, c, sd, _ = self.standard()
        b = elastic_descent(q, c, lam * alpha, lam * (1 - alpha), start) / sd
        mean = self.s / self.n
        return float(mean[-1] - mean[:-1] @ b), b

    def mse(self, intercept: float, b: np.ndarray) -> float:
        """Mean squared error of a fit on these rows."""
        v = np.append(-b, 1.0)
        return float((v @ self.q @ v - 2 * intercept * (self.s @ v) + self.n * intercept**2) / self.n)


def sums_of(df: DataFrame, x: list[str], y: str, by: str | None = None) -> dict[int, Sums]:
    return {g: Sums(*v) for g, v in cross_products(df, _row(x, y), by=by).items()}


def elastic_net_path(df: DataFrame, x: list[str], y: str, alphas: list[float], lambdas: list[float]) -> DataFrame:
    """Coefficients over an (alpha, lambda) grid; one pass over the rows."""
    sums = sums_of(df, x, y)[0]
    rows = []
    for a in alphas:
        for lam in sorted(lambdas, reverse=True):
            b0, b = sums.fit(a, lam)
            rows += [(a, lam, "(intercept)", b0)] + [(a, lam, n, float(v)) for n, v in zip(x, b, strict=True)]
    return df.sparkSession.createDataFrame(rows, COEFS)


def lambda_grid(sums: Sums, alpha: float, count: int = 30, ratio: float = 1e-3) -> list[float]:
    """From the smallest lambda that selects nothing, down a log scale."""
    top = float(np.abs(sums.standard()[1]).max()) / max(alpha, 1e-3)
    return list(np.exp(np.linspace(np.log(top), np.log(top * ratio), count)))


def cv_lambda(df: DataFrame, x: list[str], y: str, alphas: list[float], folds: int = 10, key: str = "row_id", lambdas: list[float] | None = None, fold: Column | None = None) -> DataFrame:
    """Per alpha ``lambda_min``, ``lambda_1se``, their errors and whether the alpha is ``best``; folds by a keyed hash, or ``fold``.

    One pass: each fold's sums; a training set is the total less its fold.
    """
    marked = df.withColumn("__fold", F.pmod(F.xxhash64(key), F.lit(folds)) if fold is None else fold)
    per = sums_of(marked, x, y, "__fold")
    total = Sums(sum(s.n for s in per.values()), sum(s.s for s in per.values()), sum(s.q for s in per.values()))
    rows = []
    for a in alphas:
        grid = lambdas or lambda_grid(total, a)
        errors = np.array([[s.mse(*(total - s).fit(a, lam)) for lam in grid] for s in per.values()])
        mean, se = errors.mean(0), errors.std(0, ddof=1) / np.sqrt(len(errors))
        best = int(mean.argmin())
        wide = max(lam for lam, m in zip(grid, mean, strict=True) if m <= mean[best] + se[best])
        rows.append((float(a), float(grid[best]), float(wide), float(mean[best]), float(se[best])))
    least = min(r[3] for r in rows)
    first = next(i for i, r in enumerate(rows) if r[3] == least)
    rows = [(*r, i == first) for i, r in enumerate(rows)]
    return df.sparkSession.createDataFrame(rows, "alpha double, lambda_min double, lambda_1se double, mse double, se double, best boolean")


def sigma_normalized(df: DataFrame, coefs: DataFrame, x: list[str], y: str) -> DataFrame:
    """Importance (beta sd x / sd y)^2 and its rank per (alpha, lambda)."""
    from loamstat.operators.ranks import rank_abs

    row = df.agg(*[F.stddev_samp(c).alias(c) for c in [*x, y]]).first()
    table = df.sparkSession.createDataFrame([(c, float(row[c]) / float(row[y])) for c in x], "variable string, ratio double")
    out = coefs.join(F.broadcast(table), "variable").withColumn("value", (F.col("beta") * F.col("ratio")) ** 2)  # one row per predictor
    return rank_abs(out, ["alpha", "lam"]).select("alpha", "lam", "variable", F.col("value").alias("importance"), "rank")


def sparse_coef(coefs: DataFrame, tol: float = 1e-5) -> DataFrame:
    """Non-zero coefficients, without the intercept."""
    return coefs.where((F.abs("beta") > tol) & (F.col("variable") != "(intercept)"))


def sparse_predict(df: DataFrame, coefs: dict[str, float], intercept: float = 0.0) -> DataFrame:
    """``prediction`` from named coefficients; unused columns aren't read."""
    return df.withColumn("prediction", sum((F.col(c) * float(b) for c, b in coefs.items()), F.lit(float(intercept))))


def sparsify_input(df: DataFrame, coefs: dict[str, float], keep: tuple[str, ...] = ()) -> DataFrame:
    """Only the columns with a coefficient."""
    return df.select(*keep, *coefs)


def loo(df: DataFrame, x: list[str], y: str, alpha: float, lam: float, key: str) -> DataFrame:
    """E5: leave-one-out for one (alpha, lambda): ``key, error, train_ratio, model``.

    The total sums (d x d) go to every task; rows are taken out and their fits solved there, many at a time.
    ``train_ratio`` is the training error over that of least squares, ``model`` the selected set as bits.
    """
    total = sums_of(df, x, y)[0]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = matrix(pa.Table.from_batches([batch]))
            step = max(1, LOO_CELLS // rows.shape[1] ** 2) if len(rows) else 1
            for at in range(0, len(rows), step):
                v = rows[at : at + step]
                b0, b, mse, ols = _without_each(total, v, alpha, lam)
                ratio = np.divide(mse, ols, out=np.ones_like(mse), where=ols > 0)
                sets, which = np.unique(np.abs(b) > 1e-5, axis=0, return_inverse=True)
                bits = np.array(["".join("1" if c else "0" for c in row) for row in sets], object)[which.ravel()]
                error = v[:, -1] - b0 - (v[:, :-1] * b).sum(1)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(v)), *map(pa.array, (error, ratio, bits))], names=["k", "error", "train_ratio", "model"])

    out = df.select(F.col(key).cast("long").alias("k"), _row(x, y).alias("v")).mapInArrow(each, "k long, error double, train_ratio double, model string")
    return out.withColumnRenamed("k", key)


#: Numbers of the cross-products, a matrix a row, that a task holds at a time (32 MB).
LOO_CELLS = 4_000_000


def _without_each(total: Sums, v: np.ndarray, alpha: float, lam: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For every row of ``v`` the fit of all others: intercept, coefficients, its training error and that of ``lam`` 0."""
    d, n = v.shape[1] - 1, total.n - 1.0
    s, q = total.s - v, total.q - v[:, :, None] * v[:, None, :]
    mean = s / n
    cov = q / n - mean[:, :, None] * mean[:, None, :]
    sd = np.sqrt(np.maximum(np.diagonal(cov, axis1=1, axis2=2), 0))
    safe = np.where(sd > 1e-12, sd, 1.0)[:, :d]
    scaled, c = cov[:, :d, :d] / (safe[:, :, None] * safe[:, None, :]), cov[:, :d, d] / safe

    def fit(penalty: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        b = elastic_descents(scaled, c, penalty * alpha, penalty * (1 - alpha)) / safe
        b0 = mean[:, -1] - (mean[:, :-1] * b).sum(1)
        w = np.column_stack([-b, np.ones(len(b))])
        return b0, b, (np.einsum("mi,mij,mj->m", w, q, w) - 2 * b0 * (s * w).sum(1) + n * b0**2) / n

    b0, b, mse = fit(lam)
    return b0, b, mse, mse if lam == 0 else fit(0.0)[2]


def loo_summary(errors: DataFrame) -> DataFrame:
    """E5: moments of the errors."""
    return errors.agg(F.avg("error").alias("mean"), F.stddev_samp("error").alias("sd"), F.skewness("error").alias("skewness"), F.avg(F.col("error") ** 2).alias("mse"))


def _uniform(key: str, seed: int):  # noqa: ANN202
    return (F.pmod(F.xxhash64(F.col(key), F.col("rep"), F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def stability_selection(df: DataFrame, x: list[str], y: str, lambdas: list[float], share: float = 0.5, n_boot: int = 50, alpha: float = 1.0, key: str = "row_id", seed: int = 1, residuals: bool = False) -> DataFrame:
    """Share of replicates that select each variable, per lambda.

    A replicate takes a keyed share of rows, or (``residuals``) flips the sign of the least-squares
    residuals by key.  Replicate sums are per-group cross-products; fits are d x d.
    """
    reps = df.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))))
    if residuals:
        b0, b = sums_of(df, x, y)[0].fit(alpha, 0.0)
        fit = sum((F.col(c) * float(v) for c, v in zip(x, b, strict=True)), F.lit(b0))
        reps = reps.withColumn(y, fit + (F.col(y) - fit) * F.when(_uniform(key, seed) < 0.5, 1.0).otherwise(-1.0))
    else:
        reps = reps.where(_uniform(key, seed) < share)
    hits = {(lam, c): 0 for lam in lambdas for c in x}
    per = sums_of(reps, x, y, "rep")
    for s in per.values():
        for lam in lambdas:
            for c, v in zip(x, s.fit(alpha, lam)[1], strict=True):
                hits[lam, c] += abs(v) > 1e-5
    return df.sparkSession.createDataFrame([(float(lam), c, float(n / len(per))) for (lam, c), n in hits.items()], "lam double, variable string, probability double")


def model_frequencies(models: DataFrame) -> DataFrame:
    """Share of each selected set ``model``."""
    return models.groupBy("model").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(models.agg(F.count(F.lit(1)).alias("t")))).select("model", "n", (F.col("n") / F.col("t")).alias("share"))


def selection_entropy(probs: DataFrame, by: str = "lam") -> DataFrame:
    """-sum p ln p of the inclusion probabilities."""
    p = F.col("probability")
    return probs.groupBy(by).agg((-F.sum(F.when(p > 0, p * F.ln(p)).otherwise(0.0))).alias("entropy"))


def coef_bootstrap(df: DataFrame, x: list[str], y: str, kind: str = "residual", n_boot: int = 100, alpha: float = 1.0, lam: float = 0.0, key: str = "row_id", seed: int = 1, column: str | None = None) -> DataFrame:
    """``(rep, variable, beta)`` under resampled residuals signs (``residual``), a keyed rotation of the
    response (``permuted``) or one column replaced by keyed draws in its range (``column``)."""
    total = sums_of(df, x, y)[0]
    reps = df.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))))
    if kind == "residual":
        b0, b = total.fit(alpha, lam)
        fit = sum((F.col(c) * float(v) for c, v in zip(x, b, strict=True)), F.lit(b0))
        reps = reps.withColumn(y, fit + (F.col(y) - fit) * F.when(_uniform(key, seed) < 0.5, 1.0).otherwise(-1.0))
    elif kind == "permuted":
        # the response moves along a permutation of all rows' ranks that differs by replicate
        ranked = materialize(global_rank(df.withColumn("__h", F.xxhash64(F.col(key), F.lit(seed))), [F.col("__h"), F.col(key)], "__at"), "ranked")
        n = ranked.count()
        step = next(k for k in range(int(n * 0.618) | 1, 2 * n + 3, 2) if math.gcd(k, n) == 1) if n else 1
        moved = F.pmod(F.col("__at") * step + F.pmod(F.xxhash64("rep", F.lit(seed)), F.lit(max(n, 1))), F.lit(max(n, 1))) + 1
        response = ranked.select(F.col("__at").alias("__to"), F.col(y).alias("__y"))
        spread = ranked.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1)))).withColumn("__to", moved)
        reps = spread.join(response, "__to").withColumn(y, F.col("__y")).drop("__y", "__to", "__at", "__h")
    else:
        row = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi")).first()
        reps = reps.withColumn(column, F.lit(float(row["lo"])) + _uniform(key, seed) * float(row["hi"] - row["lo"]))
    rows = [(int(r), c, float(v)) for r, s in sums_of(reps, x, y, "rep").items() for c, v in zip(x, s.fit(alpha, lam)[1], strict=True)]
    return df.sparkSession.createDataFrame(rows, "rep long, variable string, beta double")


def coef_ranges(coefs: DataFrame, by: list[str] = ["variable"]) -> DataFrame:  # noqa: B006
    """5, 50 and 95 % points and the mean, which is 0 where both outer points are."""
    q = coefs.groupBy(*by).agg(F.percentile("beta", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95))).alias("q"), F.avg("beta").alias("m"))
    zero = (F.col("q")[0] == 0) & (F.col("q")[2] == 0)
    return q.select(*by, F.col("q")[0].alias("p05"), F.col("q")[1].alias("p50"), F.col("q")[2].alias("p95"), F.when(zero, F.lit(0.0)).otherwise(F.col("m")).alias("mean"))


def fix_confidence(preds: DataFrame, key: str, p: float = 0.9) -> DataFrame:
    """Central interval of each row's predictions."""
    lo, hi = (1 - p) / 2, (1 + p) / 2
    return preds.groupBy(key).agg(F.percentile("prediction", F.lit(lo)).alias("lo"), F.avg("prediction").alias("mean"), F.percentile("prediction", F.lit(hi)).alias("hi"))
