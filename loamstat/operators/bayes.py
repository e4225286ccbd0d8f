"""Conjugate posteriors and summaries of draws, per group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamstat.functions.ordered import mid_ranks
from loamstat.functions.special import beta_ppf_col, betainc_col, t_ppf_col
from loamstat.functions.work import materialize
from loamstat.operators.factor import cross_products


def beta_posterior(df: DataFrame, by: list[str], outcome: str, a: float = 1.0, b: float = 1.0, prob: float = 0.9, pi0: float = 0.5) -> DataFrame:
    """Beta-binomial posterior of a 0/1 outcome per group: mean, central interval, P(pi < pi0)."""
    per = df.groupBy(*by).agg(F.sum(F.col(outcome).cast("long")).alias("y"), F.count(outcome).alias("n"))
    pa, pb = F.col("y") + F.lit(a), F.col("n") - F.col("y") + F.lit(b)
    tail = (1 - prob) / 2
    return per.withColumns(
        {
            "mean": pa / (pa + pb),
            "lo": beta_ppf_col(F.lit(tail), pa, pb),
            "hi": beta_ppf_col(F.lit(1 - tail), pa, pb),
            "below": betainc_col(pa, pb, F.lit(float(pi0))),
        }
    )


def mean_posterior(df: DataFrame, by: list[str], value: str, prob: float = 0.95) -> DataFrame:
    """Posterior t interval of the mean and predictive interval of a new value, per group of 2 or more."""
    per = df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd")).where("n > 1")
    q = t_ppf_col(F.lit((1 + prob) / 2), F.col("n") - 1)
    half, wide = F.col("q") * F.col("sd") / F.sqrt("n"), F.col("q") * F.col("sd") * F.sqrt(1 + 1 / F.col("n"))
    return per.withColumn("q", q).withColumns({"lo": F.col("mean") - half, "hi": F.col("mean") + half, "pred_lo": F.col("mean") - wide, "pred_hi": F.col("mean") + wide}).drop("q")


def _draws(counts: DataFrame, key: str, cols: list[str], draws: int, seed: int, make) -> DataFrame:  # noqa: ANN001
    """``(key, draw)`` from a generator keyed by (seed, key, block); a block is a row, so draws spread over tasks."""
    block = 10_000
    blocks = counts.select(key, *cols, F.explode(F.sequence(F.lit(0), F.lit((draws - 1) // block))).alias("block")).repartition(key, "block")

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            for r in pdf.itertuples(index=False):
                n = min(block, draws - r.block * block)
                rng = np.random.Generator(np.random.PCG64([seed, hash_text(str(getattr(r, key))), r.block]))
                yield pd.DataFrame({key: getattr(r, key), "draw": make(rng, r, n)})

    return blocks.mapInPandas(run, f"{key} {dict(counts.dtypes)[key]}, draw double")


def hash_text(s: str) -> int:
    """A stable hash, unlike ``hash``."""
    import zlib

    return zlib.crc32(s.encode())


def _summary(draws: DataFrame, key: str, prob: float) -> DataFrame:
    lo, hi = (1 - prob) / 2, (1 + prob) / 2
    return draws.groupBy(key).agg(F.avg("draw").alias("mean"), F.percentile("draw", F.lit(lo)).alias("lo"), F.percentile("draw", F.lit(hi)).alias("hi"))


def mean_diff_posterior(pairs: DataFrame, key: str, prob: float = 0.95, draws: int = 10_000, seed: int = 1) -> DataFrame:
    """Difference of two group means by draws; ``pairs`` has n, mean and sd of both sides (``_x``, ``_y``)."""

    def make(rng: np.random.Generator, r, n: int) -> np.ndarray:  # noqa: ANN001
        x = r.mean_x + rng.standard_t(r.n_x - 1, n) * r.sd_x / np.sqrt(r.n_x)
        return x - r.mean_y - rng.standard_t(r.n_y - 1, n) * r.sd_y / np.sqrt(r.n_y)

    return _summary(_draws(pairs, key, ["n_x", "mean_x", "sd_x", "n_y", "mean_y", "sd_y"], draws, seed, make), key, prob)


def odds_ratio_posterior(counts: DataFrame, key: str, prior: tuple[float, float] = (1.0, 1.0), prob: float = 0.95, draws: int = 10_000, seed: int = 1) -> DataFrame:
    """Odds ratio p2/(1-p2) over p1/(1-p1) of two arms (n1, y1, n2, y2): mean and interval."""
    a, b = prior

    def make(rng: np.random.Generator, r, n: int) -> np.ndarray:  # noqa: ANN001
        p1, p2 = rng.beta(r.y1 + a, r.n1 - r.y1 + b, n), rng.beta(r.y2 + a, r.n2 - r.y2 + b, n)
        return p2 / (1 - p2) / (p1 / (1 - p1))

    return _summary(_draws(counts, key, ["n1", "y1", "n2", "y2"], draws, seed, make), key, prob)


def bayes_rule(df: DataFrame, group: str, attr: str, prior: DataFrame | None = None) -> DataFrame:
    """P(group | attribute) from counts; ``prior`` is (group, prior), by default the observed shares."""
    cell = df.groupBy(group, attr).agg(F.count(F.lit(1)).alias("n"))
    like = cell.withColumn("likelihood", F.col("n") / F.sum("n").over(Window.partitionBy(group)))
    if prior is None:
        total = cell.groupBy(group).agg(F.sum("n").alias("g"))
        prior = total.withColumn("prior", F.col("g") / F.sum("g").over(Window.partitionBy())).select(group, "prior")  # one row per group
    joint = like.join(prior, group).withColumn("joint", F.col("likelihood") * F.col("prior"))
    return joint.withColumn("posterior", F.col("joint") / F.sum("joint").over(Window.partitionBy(attr))).select(group, attr, "likelihood", "prior", "posterior")


def importance_summary(draws: DataFrame, log_w: str, values: list[str], by: list[str] | None = None) -> DataFrame:
    """Importance-weighted means and effective sample size 1 / sum w^2; weights are max-shifted."""
    keys = by or []
    top = draws.groupBy(*keys).agg(F.max(log_w).alias("__m"))
    shifted = draws.join(top, keys) if keys else draws.crossJoin(F.broadcast(top))  # one row
    w = F.exp(F.col(log_w) - F.col("__m"))
    one = shifted.withColumn("__w", w).groupBy(*keys).agg(*[(F.sum(F.col("__w") * F.col(v)) / F.sum("__w")).alias(v) for v in values], (F.sum("__w") ** 2 / F.sum(F.col("__w") ** 2)).alias("ess"))
    return one


def importance_resample(draws: DataFrame, log_w: str, n: int, key: str, seed: int = 1) -> DataFrame:
    """N rows without replacement, with odds by weight (keyed Gumbel top-n)."""
    u = (F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return draws.withColumn("__g", F.col(log_w) - F.ln(-F.ln(u))).orderBy(F.col("__g").desc(), key).limit(n).drop("__g")


def rhat(draws: DataFrame, warmup: int = 0, rank: bool = False) -> DataFrame:
    """Split R-hat per parameter of ``(chain, iter, param, value)``; ``rank`` normalises by average ranks first.

    A chain's ends come from an aggregate and ranks from range partitions, so no chain or parameter is
    one task's.  Draws without a value, parameter or chain are left out.
    """
    kept = draws.where(F.col("iter") >= warmup).select("chain", "iter", "param", "value").dropna(subset=["chain", "param", "value"])
    # a row a chain: as a work table its size is known, so a small one is broadcast and no draw is dealt by its chain
    ends = materialize(kept.groupBy("param", "chain").agg((F.min("iter") + F.max("iter")).alias("__ends")), "ends")
    halves = kept.join(ends, ["param", "chain"]).select("param", "chain", (F.col("iter") * 2 > F.col("__ends")).cast("int").alias("half"), "value")
    if rank:
        from loamstat.functions.special import norm_ppf_col

        scores = mid_ranks(kept, "param", "value").withColumn("__u", (F.col("mid") - 0.375) / (F.col("n") + 0.25))
        scores = scores.select("param", "value", norm_ppf_col(F.col("__u")).alias("__z"))
        halves = halves.join(scores, ["param", "value"]).withColumn("value", F.col("__z"))
    per = halves.groupBy("param", "chain", "half").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("m"), F.var_samp("value").alias("v"))
    one = per.groupBy("param").agg(F.avg("n").alias("n"), F.avg("v").alias("w"), F.var_samp("m").alias("bn"))
    return one.select("param", F.sqrt(((F.col("n") - 1) / F.col("n") * F.col("w") + F.col("bn")) / F.col("w")).alias("rhat"))


def bayes_linreg(df: DataFrame, x: list[str], y: str, prior_mean: np.ndarray, prior_cov: np.ndarray, sigma2: float) -> tuple[np.ndarray, np.ndarray]:
    """Posterior mean and covariance of linear-regression weights, from x'x and x'y."""
    q = cross_products(df, F.array(*[F.col(c).cast("double") for c in [*x, y]]))[0][2]
    d = len(x)
    inv = np.linalg.inv(prior_cov)
    cov = np.linalg.inv(inv + q[:d, :d] / sigma2)
    return cov @ (inv @ prior_mean + q[:d, d] / sigma2), cov


def mlppd(df: DataFrame, y: Column, mu: Column, var: Column) -> DataFrame:
    """Mean log predictive density of normal predictions."""
    return df.agg(F.avg(-0.5 * F.ln(2 * F.pi() * var) - (y - mu) ** 2 / (2 * var)).alias("mlppd"))
