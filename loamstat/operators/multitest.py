"""Multiple testing.  ``family`` names one set of tests; m is its size.

Families of any number and size go by ranks over range partitions of (family,
p), so no task sees all of a large one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamstat.functions.ordered import ranged
from loamstat.functions.work import materialize

METHODS = ("bonferroni", "holm", "fdr_bh", "fdr_by")


def _harmonic(m: Column) -> Column:
    """Sum of 1/i up to m: direct up to 64, then its expansion (error under 1e-14)."""
    direct = F.aggregate(F.sequence(F.lit(1), F.least(m, F.lit(64)).cast("int")), F.lit(0.0), lambda a, i: a + 1.0 / i)
    x = m.cast("double")
    wide = F.ln(x) + 0.5772156649015329 + 1 / (2 * x) - 1 / (12 * x * x) + 1 / (120 * x**4)
    return F.when(m <= 64, direct).otherwise(wide)


def adjust(tests: DataFrame, method: str, family: list[str] | None = None, p: str = "p", alpha: float = 0.05, key: list[str] | None = None) -> DataFrame:
    """M1-M3: adds ``p_<method>`` and ``reject``; rows with a null p stay out of m and get nulls.

    ``family=None`` is one family.  Families may have any size and null names.
    """
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    name, family = f"p_{method}", family or []
    tests = materialize(tests, "tests")  # counted, ranked and returned: computed once
    adjusted = _adjusted(tests.where(F.col(p).isNotNull()), method, family, p, name)
    out = _join(tests, adjusted, [*family, p], "left")
    return out.withColumn("reject", F.coalesce(F.col(name) < alpha if method == "bonferroni" else F.col(name) <= alpha, F.lit(False)))


def _join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """``left`` with the further columns of ``right``; null keys are equal."""
    a, b = left.alias("a"), right.alias("b")
    met = F.lit(True)
    for c in on:
        met = met & F.col(f"a.`{c}`").eqNullSafe(F.col(f"b.`{c}`"))
    return a.join(b, met, how).select("a.*", *[F.col(f"b.`{c}`") for c in right.columns if c not in on])


def _ranked(tests: DataFrame, family: list[str], p: str) -> DataFrame:
    """Distinct p-values of every family: ``__n`` tests, ``__last`` rank of the last of them, ``__m`` tests in the family.

    Families and values together are range-partitioned, so neither a large family nor its ties meet in one
    task; what crosses ranges are counts, one row for each family in each range.
    """
    counts = ranged(tests.groupBy(*family, p).agg(F.count(F.lit(1)).alias("__n")), *[F.col(f) for f in family], F.col(p))
    part = ["__range", *family]
    whole = Window.partitionBy(*family)
    totals = counts.groupBy(*part).agg(F.sum("__n").alias("__t"))
    before = totals.select(*part, F.coalesce(F.sum("__t").over(_earlier(family)), F.lit(0)).alias("__before"), F.sum("__t").over(whole).alias("__m"))
    here = F.sum("__n").over(Window.partitionBy(*part).orderBy(p))
    return _join(counts, before, part).withColumn("__last", F.col("__before") + here).drop("__before")


def _earlier(family: list[str]):  # noqa: ANN202
    return Window.partitionBy(*family).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)


def _adjusted(tests: DataFrame, method: str, family: list[str], p: str, name: str) -> DataFrame:
    """``(family, p, name)`` for every distinct p-value of a family."""
    if method == "bonferroni":
        counts = tests.groupBy(*family, p).agg(F.count(F.lit(1)).alias("__n"))
        totals = counts.groupBy(*family).agg(F.sum("__n").alias("__m"))
        return _join(counts, totals, family).select(*family, p, F.least(F.lit(1.0), F.col(p) * F.col("__m")).alias(name))
    ranked = _ranked(tests, family, p)
    part = ["__range", *family]
    if method == "holm":
        # of tied values the first rank counts: the largest multiplier among them
        ranked = ranked.withColumn("__s", (F.col("__m") - F.col("__last") + F.col("__n")) * F.col(p))
        others = ranked.groupBy(*part).agg(F.max("__s").alias("__t")).select(*part, F.max("__t").over(_earlier(family)).alias("__o"))
        best = F.greatest(F.max("__s").over(Window.partitionBy(*part).orderBy(p)), F.col("__o"))
    else:
        c = _harmonic(F.col("__m")) if method == "fdr_by" else F.lit(1.0)
        ranked = ranked.withColumn("__s", F.col(p) * F.col("__m") * c / F.col("__last"))
        later = Window.partitionBy(*family).orderBy("__range").rowsBetween(1, Window.unboundedFollowing)
        others = ranked.groupBy(*part).agg(F.min("__s").alias("__t")).select(*part, F.min("__t").over(later).alias("__o"))
        best = F.least(F.min("__s").over(Window.partitionBy(*part).orderBy(F.col(p).desc())), F.col("__o"))
    return _join(ranked, others, part).select(*family, p, F.least(F.lit(1.0), best).alias(name))


def alpha_levels(tests: DataFrame, alpha: float = 0.05, family: list[str] | None = None) -> DataFrame:
    """M4: Bonferroni and Sidak levels per family."""
    return tests.groupBy(*(family or [])).agg(F.count("p").alias("m")).withColumns({"bonferroni": alpha / F.col("m"), "sidak": 1 - F.pow(F.lit(1 - alpha), 1 / F.col("m"))})


def m0_bh(tests: DataFrame, family: list[str], p: str = "p") -> DataFrame:
    """M5: estimate of the number of true nulls per family: with m0(k) = (m + 1 - k) / (1 - p_(k)),
    the first m0(k) above its predecessor, at most m; m if none rises."""
    part = ["__range", *family]
    null = lambda rank: F.when(F.col(p) < 1, (F.col("__m") + 1 - rank) / (1 - F.col(p))).otherwise(F.lit(float("inf")))
    # m0(k) falls among tied values, so it can only rise from the last of a value to the first of the next
    ranked = _ranked(tests.where(F.col(p).isNotNull()), family, p).withColumn("__k", F.col("__last") - F.col("__n") + 1)
    ranked = ranked.withColumns({"__first": null(F.col("__k")), "__end": null(F.col("__last"))})
    ends = ranked.groupBy(*part).agg(F.max_by("__end", p).alias("__t"))
    ends = ends.select(*part, F.lag("__t").over(Window.partitionBy(*family).orderBy("__range")).alias("__o"))
    walk = _join(ranked, ends, part)
    before = F.coalesce(F.lag("__end").over(Window.partitionBy(*part).orderBy(p)), F.col("__o"))
    walk = walk.withColumn("__rises", F.col("__first") > before)
    est = walk.groupBy(*family).agg(F.max("__m").alias("m"), F.min(F.when(F.col("__rises"), F.struct("__k", "__first")))["__first"].alias("est"))
    return est.select(*family, "m", F.least(F.coalesce(F.ceil("est").cast("long"), F.col("m")), F.col("m")).alias("m0"))


def m0_bky(tests: DataFrame, family: list[str], alpha: float = 0.05, p: str = "p") -> DataFrame:
    """M6: m minus the rejections of Benjamini-Hochberg at alpha / (1 + alpha)."""
    first = adjust(tests, "fdr_bh", family, p, alpha / (1 + alpha))
    return first.groupBy(*family).agg(F.count(p).alias("m"), (F.count(p) - F.sum(F.col("reject").cast("long"))).alias("m0"))


def two_stage(tests: DataFrame, family: list[str], method: str = "bh", alpha: float = 0.05, p: str = "p") -> DataFrame:
    """M5, M6: Benjamini-Hochberg at a level adjusted by the estimated m0; adds ``reject``.

    No estimated null (m0 = 0) rejects everything that has a p-value.
    """
    est = m0_bh(tests, family, p) if method == "bh" else m0_bky(tests, family, alpha, p)
    level = alpha if method == "bh" else alpha / (1 + alpha)
    plain = _join(adjust(tests, "fdr_bh", family, p).drop("reject"), est, family, "left")
    scaled = F.col("p_fdr_bh") * F.col("m0") / F.col("m")
    return plain.withColumn("reject", F.coalesce(F.col(p).isNotNull() & ((F.col("m0") == 0) | (scaled <= level)), F.lit(False)))


def adjust_effective(tests: DataFrame, m_eff: float, method: str = "bonferroni", alpha: float = 0.05, p: str = "p") -> DataFrame:
    """M9: reject with an effective number of tests in place of m."""
    if method == "bonferroni":
        return tests.withColumn("reject", F.col(p) * m_eff < alpha)
    m = tests.where(F.col(p).isNotNull()).count()
    return adjust(tests, "fdr_bh", None, p, alpha * m / m_eff)


def boundary(tests: DataFrame, family: list[str], p: str = "p") -> DataFrame:
    """Largest rejected and smallest kept p per family."""
    return tests.groupBy(*family).agg(F.max(F.when(F.col("reject"), F.col(p))).alias("last_rejected"), F.min(F.when(~F.col("reject"), F.col(p))).alias("first_kept"))


def spjotvoll(tests: DataFrame, p: str = "p", n_max: int | None = None, seed: int = 1) -> DataFrame:
    """Points (1 - p, share of p-values above p), one per test, or for a seeded sample of some ``n_max`` of them."""
    counts = tests.groupBy(F.col(p).alias("p")).agg(F.count(F.lit(1)).alias("c"))
    frozen = ranged(counts, F.col("p"))
    per = frozen.groupBy("__range").agg(F.sum("c").alias("t"))
    before = per.select("__range", F.coalesce(F.sum("t").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("b"))
    total = counts.agg(F.sum("c").alias("m"))
    upto = F.sum("c").over(Window.partitionBy("__range").orderBy("p"))
    out = frozen.withColumn("u", upto).join(F.broadcast(before), "__range").crossJoin(F.broadcast(total))  # one row
    points = out.select("p", (1 - F.col("p")).alias("x"), ((F.col("m") - F.col("u") - F.col("b")) / F.col("m")).alias("y"))
    shown = tests.select(F.col(p).alias("p"))
    if n_max is not None:
        shown = shown.sample(min(1.0, n_max / max(tests.count(), 1)), seed)
    return shown.join(points, "p")
