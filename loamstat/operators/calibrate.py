"""Calibration of corrections by permuted and spiked data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamstat.functions.work import materialize
from loamstat.operators import multitest, stats
from loamstat.operators.ranks import topk
from loamstat.operators.resample import group_permutation

METHODS = ("uncorrected", "bonferroni", "holm", "fdr_bh", "fdr_by", "bh_2step", "bky_2step")


def decide(tests: DataFrame, method: str, alpha: float = 0.05, family: list[str] = ["rep"]) -> DataFrame:  # noqa: B006
    """``reject`` by a method's name, each replicate a family."""
    if method == "uncorrected":
        return tests.withColumn("reject", F.col("p") < alpha)
    if method in ("bh_2step", "bky_2step"):
        return multitest.two_stage(tests, family, method.split("_")[0], alpha).select(*tests.columns, "reject")
    return multitest.adjust(tests, method, family, alpha=alpha).select(*tests.columns, "reject")


def calibrate(tests: DataFrame, truth: DataFrame | None, methods: tuple[str, ...] = METHODS, alpha: float = 0.05) -> DataFrame:
    """``(method, rep, fn, fp, rejections, n_effects, n_tests)`` of tests ``(rep, contrast, feature_id, p)``.

    ``truth`` is (feature_id, contrast, effect); None is the complete null.
    """
    known = truth if truth is not None else tests.select("feature_id", "contrast").distinct().withColumn("effect", F.lit(False))
    out = []
    for m in methods:
        c = stats.confusion(decide(tests, m, alpha), known, ["feature_id", "contrast"], ["rep"])
        out.append(c.select(F.lit(m).alias("method"), "rep", "fn", "fp", (F.col("tp") + F.col("fp")).alias("rejections"), (F.col("tp") + F.col("fn")).alias("n_effects"), (F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")).alias("n_tests")))
    return stats.combine_results(*out)


def null_calibration(obs: DataFrame, contrasts: DataFrame, reps: int, filters: Callable[[DataFrame], DataFrame] | None = None, methods: tuple[str, ...] = METHODS, keep_k: int | None = None, alpha: float = 0.05, seed: int = 1) -> tuple[DataFrame, DataFrame | None]:
    """False discoveries per method under permuted labels, and the ``keep_k`` smallest p of each replicate.

    ``filters`` (label-free) is applied before: it sees the same values in every replicate.
    """
    tests = materialize(group_permutation(filters(obs) if filters else obs, contrasts, reps, seed), "null")
    least = topk(tests, "p", keep_k, True, ["rep"], "feature_id") if keep_k else None
    return calibrate(tests, None, methods, alpha), least


def spike_in_calibration(obs: DataFrame, contrasts: DataFrame, shifts: DataFrame, reps: int, methods: tuple[str, ...] = METHODS, alpha: float = 0.05, seed: int = 1) -> DataFrame:
    """The same after known shifts ``(feature_id, grp, shift)`` are added; a test has an effect where its sides' shifts differ."""
    tests = materialize(group_permutation(obs, contrasts, reps, seed, shifts), "spiked")
    side = lambda n: shifts.select("feature_id", F.col("grp").alias(f"grp_{n}"), F.col("shift").alias(f"s_{n}"))
    every = tests.select("feature_id", "contrast").distinct().join(F.broadcast(contrasts), "contrast")  # a handful of contrasts
    both = every.join(side("x"), ["feature_id", "grp_x"], "left").join(side("y"), ["feature_id", "grp_y"], "left")
    truth = both.select("feature_id", "contrast", (F.coalesce("s_x", F.lit(0.0)) != F.coalesce("s_y", F.lit(0.0))).alias("effect"))
    return calibrate(tests, truth, methods, alpha)
