"""Group aggregates and tests per feature.

All tests work on sufficient statistics per (feature, group): raw rows are
shuffled once, with map-side partial aggregation, and never multiplied by the
number of contrasts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamstat.functions.special import f_p_col, studentized_range_col, t_p_col


def describe_groups(obs: DataFrame, by: list[str] = ["feature_id", "grp"], value: str = "value", medians: bool = False) -> DataFrame:  # noqa: B006
    """A1: n, mean, sample variance, minimum and maximum (and exact median) per group."""
    aggs = [
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.var_samp(value).alias("var"), F.min(value).alias("lo"), F.max(value).alias("hi"),
    ]
    if medians:
        aggs.append(F.percentile(value, F.lit(0.5)).alias("median"))
    return obs.groupBy(*by).agg(*aggs)


def describe_levels(obs: DataFrame, value: str = "value") -> DataFrame:
    """A1 over grouping sets: per (feature, group), per feature and overall; ``level`` tells which."""
    grouped = obs.cube("feature_id", "grp").agg(
        F.grouping_id().alias("level"), F.count(value).alias("n"), F.avg(value).alias("mean"), F.var_pop(value).alias("var_pop"), F.var_samp(value).alias("var_samp")
    )
    return grouped.where("level in (0, 1, 3)")


def contrast_table(groups: DataFrame) -> DataFrame:
    """All ordered pairs x < y of a small table of group names."""
    a, b = groups.select(F.col("grp").alias("grp_x")), groups.select(F.col("grp").alias("grp_y"))
    return a.join(b, F.col("grp_x") < F.col("grp_y")).select(F.concat_ws("-", "grp_x", "grp_y").alias("contrast"), "grp_x", "grp_y")


def pairwise_contrasts(stats: DataFrame, contrasts: DataFrame) -> DataFrame:
    """Both sides' aggregates per (feature, contrast); columns get suffixes ``_x`` and ``_y``."""
    cols = [c for c in stats.columns if c not in ("feature_id", "grp")]
    side = lambda s: stats.select("feature_id", F.col("grp").alias(f"grp_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in cols])
    return side("x").join(F.broadcast(contrasts), "grp_x").join(side("y"), ["feature_id", "grp_y"])


def fold_change(pairs: DataFrame) -> DataFrame:
    """A2: difference of means, and of medians where they are there."""
    out = pairs.withColumn("fc", F.col("mean_x") - F.col("mean_y"))
    return out.withColumn("median_fc", F.col("median_x") - F.col("median_y")) if "median_x" in pairs.columns else out


def min_margin(pairs: DataFrame) -> DataFrame:
    """A3: distance between the groups' ranges, 0 where they overlap."""
    return pairs.withColumn("min_margin", F.greatest(F.col("lo_x") - F.col("hi_y"), F.col("lo_y") - F.col("hi_x"), F.lit(0.0)))


def kth_margin(obs: DataFrame, contrasts: DataFrame, k: int, relative: bool = False) -> DataFrame:
    """A4: the margin after dropping the k lowest and k highest values of each group; not clipped at 0."""
    up = F.row_number().over(Window.partitionBy("feature_id", "grp").orderBy("value", "sample_id"))
    down = F.row_number().over(Window.partitionBy("feature_id", "grp").orderBy(F.col("value").desc(), F.col("sample_id").desc()))
    per = (
        obs.select("feature_id", "grp", "value", up.alias("up"), down.alias("down"))
        .groupBy("feature_id", "grp")
        .agg(F.min(F.when(F.col("up") == k + 1, F.col("value"))).alias("lo"), F.max(F.when(F.col("down") == k + 1, F.col("value"))).alias("hi"), F.avg("value").alias("mean"))
    )
    margin = F.greatest(F.col("lo_x") - F.col("hi_y"), F.col("lo_y") - F.col("hi_x"))
    if relative:
        margin = margin / F.abs(F.col("mean_x") - F.col("mean_y"))
    return pairwise_contrasts(per, contrasts).select("feature_id", "contrast", margin.alias("kth_margin"))


def ttest(pairs: DataFrame, equal_var: bool = False) -> DataFrame:
    """A5: two-sample t-test from (n, mean, var) of both sides: ``t, dof, p``.

    A side of one value, or no variance at all, gives nulls.
    """
    nx, ny, vx, vy = F.col("n_x"), F.col("n_y"), F.col("var_x"), F.col("var_y")
    if equal_var:
        dof = (nx + ny - 2).cast("double")
        se2 = ((nx - 1) * vx + (ny - 1) * vy) / dof * (1 / nx + 1 / ny)
    else:
        a, b = vx / nx, vy / ny
        se2 = a + b
        dof = F.when(se2 > 0, se2 * se2 / (a * a / (nx - 1) + b * b / (ny - 1)))
    ok = (nx > 1) & (ny > 1) & (se2 > 0)
    t = F.when(ok, (F.col("mean_x") - F.col("mean_y")) / F.sqrt(se2))
    out = pairs.withColumns({"t": t, "dof": F.when(ok, dof)})
    return out.withColumn("p", t_p_col(F.col("t"), F.col("dof")))


def anova(obs: DataFrame, by: str = "feature_id", grp: str = "grp", value: str = "value") -> DataFrame:
    """One-way ANOVA per feature: ``f, d1, d2, p``."""
    per = obs.groupBy(by, grp).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.var_samp(value).alias("v"))
    tot = per.groupBy(by).agg(
        F.count(F.lit(1)).alias("k"),
        F.sum("n").alias("n"),
        (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("grand"),
        F.sum(F.col("n") * F.col("m") * F.col("m")).alias("q"),
        F.sum((F.col("n") - 1) * F.coalesce("v", F.lit(0.0))).alias("within"),
    )
    between = F.col("q") - F.col("n") * F.col("grand") * F.col("grand")
    d1, d2 = (F.col("k") - 1).cast("double"), (F.col("n") - F.col("k")).cast("double")
    out = tot.select(by, d1.alias("d1"), d2.alias("d2"), F.when((d1 > 0) & (d2 > 0) & (F.col("within") > 0), (between / d1) / (F.col("within") / d2)).alias("f"))
    return out.withColumn("p", f_p_col(F.col("f"), F.col("d1"), F.col("d2")))


def welch_anova(obs: DataFrame, by: str = "feature_id", grp: str = "grp", value: str = "value") -> DataFrame:
    """Welch's ANOVA per feature: ``f, d1, d2, p``; groups need two values and some variance."""
    per = obs.groupBy(by, grp).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.var_samp(value).alias("v")).where("n > 1 and v > 0")
    per = per.withColumn("w", F.col("n") / F.col("v"))
    w = Window.partitionBy(by)
    per = per.withColumns({"ws": F.sum("w").over(w), "gm": F.sum(F.col("w") * F.col("m")).over(w) / F.sum("w").over(w)})
    tot = per.groupBy(by).agg(
        F.count(F.lit(1)).cast("double").alias("k"),
        F.sum(F.col("w") * (F.col("m") - F.col("gm")) ** 2).alias("num"),
        F.sum((1 - F.col("w") / F.col("ws")) ** 2 / (F.col("n") - 1)).alias("lam"),
    ).where("k > 1")
    k, lam = F.col("k"), F.col("lam")
    f = (F.col("num") / (k - 1)) / (1 + 2 * (k - 2) / (k * k - 1) * lam)
    out = tot.select(by, f.alias("f"), (k - 1).alias("d1"), ((k * k - 1) / (3 * lam)).alias("d2"))
    return out.withColumn("p", f_p_col(F.col("f"), F.col("d1"), F.col("d2")))


def games_howell(pairs: DataFrame, k: int) -> DataFrame:
    """Pairwise Games-Howell over ``k`` groups: ``diff, se, t, dof, p``."""
    a, b = F.col("var_x") / F.col("n_x"), F.col("var_y") / F.col("n_y")
    out = pairs.withColumns(
        {
            "diff": F.col("mean_x") - F.col("mean_y"),
            "se": F.sqrt((a + b) / 2),
            "dof": (a + b) ** 2 / (a * a / (F.col("n_x") - 1) + b * b / (F.col("n_y") - 1)),
        }
    ).withColumn("t", F.abs("diff") / F.col("se"))
    return out.withColumn("p", studentized_range_col(F.col("t"), k, F.col("dof")))


def group_contrasts(stats: DataFrame, weights: DataFrame) -> DataFrame:
    """Contrasts C * beta of the group-mean model; ``weights`` is (contrast, grp, weight)."""
    return stats.join(F.broadcast(weights), "grp").groupBy("feature_id", "contrast").agg(F.sum(F.col("weight") * F.col("mean")).alias("effect"))


def group_ols(stats: DataFrame, base: str) -> DataFrame:
    """Least squares of the value on dummy-coded groups per feature, group ``base`` left out.

    ``(feature_id, term, beta, se, t, p)``; ``term`` is ``(intercept)`` or a
    group.  From the groups' sizes, means and variances: the estimates are
    differences of means, their errors share one residual variance.  Features without the
    base group or without residual degrees of freedom have no rows.
    """
    part = stats.select("feature_id", "grp", "n", "mean", F.coalesce("var", F.lit(0.0)).alias("var"))
    whole = part.groupBy("feature_id").agg(
        (F.sum("n") - F.count(F.lit(1))).alias("dof"),
        F.sum((F.col("n") - 1) * F.col("var")).alias("rss"),
        F.max(F.when(F.col("grp") == base, F.col("mean"))).alias("mean_0"),
        F.max(F.when(F.col("grp") == base, F.col("n"))).alias("n_0"),
    ).where("dof > 0 and n_0 is not null")
    own = F.col("grp") == base
    out = part.join(whole, "feature_id").select(
        "feature_id",
        F.when(own, F.lit("(intercept)")).otherwise(F.col("grp")).alias("term"),
        F.when(own, F.col("mean_0")).otherwise(F.col("mean") - F.col("mean_0")).alias("beta"),
        F.sqrt(F.col("rss") / F.col("dof") * (1 / F.col("n_0") + F.when(own, 0.0).otherwise(1 / F.col("n")))).alias("se"),
        "dof",
    )
    out = out.withColumn("t", F.when(F.col("se") > 0, F.col("beta") / F.col("se")))
    return out.withColumn("p", t_p_col(F.col("t"), F.col("dof").cast("double"))).drop("dof")


def histogram(df: DataFrame, col: str, bins: int, by: list[str] | None = None, lo: float | None = None, hi: float | None = None) -> DataFrame:
    """Counts in equal bins over [lo, hi] (by default the observed range); ``hi`` falls in the last bin."""
    if lo is None or hi is None:
        row = df.agg(F.min(col).alias("lo"), F.max(col).alias("hi")).first()
        lo, hi = row["lo"], row["hi"]
    x = F.col(col).cast("double")
    width = (hi - lo) / bins
    slot = F.when(x == hi, F.lit(bins - 1)).otherwise(F.floor((x - lo) / width)) if width else F.lit(0)
    return df.where(x.between(lo, hi)).groupBy(*(by or []), slot.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def discovery_summary(tests: DataFrame, alpha: float = 0.05, fc_min: float = 1.0, margin_min: float = 0.0) -> DataFrame:
    """Discoveries per contrast and in total (null contrast): by p, by each correction that is there, and by effect."""
    flag = lambda c: F.sum((c).cast("long"))
    counts = {"uncorrected": F.col("p") < alpha}
    counts |= {name: F.col(name) < alpha for name in ("p_bonferroni", "p_holm", "p_fdr_bh", "p_fdr_by") if name in tests.columns}
    aggs = [F.coalesce(flag(c), F.lit(0)).alias(n) for n, c in counts.items()]
    return tests.rollup("contrast").agg(
        F.count(F.lit(1)).alias("tests"),
        *aggs,
        F.count_distinct(F.when(F.col("p") < alpha, F.col("feature_id"))).alias("features"),
        F.coalesce(flag(F.abs("fc") >= fc_min), F.lit(0)).alias("large_fc"),
        F.coalesce(flag(F.col("min_margin") > margin_min), F.lit(0)).alias("with_margin"),
    )


def confusion(tests: DataFrame, truth: DataFrame, on: list[str], by: list[str] | None = None) -> DataFrame:
    """TP, FP, TN, FN and power of ``reject`` against ``truth.effect``; missing truth is no effect."""
    joined = tests.join(truth, on, "left").withColumn("__e", F.coalesce("effect", F.lit(False)))
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    r, e = F.col("reject"), F.col("__e")
    out = joined.groupBy(*(by or [])).agg(n(r & e).alias("tp"), n(r & ~e).alias("fp"), n(~r & ~e).alias("tn"), n(~r & e).alias("fn"))
    return out.withColumn("power", F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(F.lit(0.0)))


def experiment_measures(results: DataFrame, by: list[str] = ["method"]) -> DataFrame:  # noqa: B006
    """Averages over replicates of ``(method, rep, fn, fp, rejections, n_effects, n_tests)``.

    Ratios with an empty denominator are 0.
    """
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    fp, fn, r, e, m = (F.col(c) for c in ("fp", "fn", "rejections", "n_effects", "n_tests"))
    tp, nulls = e - fn, m - e
    fdp = ratio(fp, r)
    return results.groupBy(*by).agg(
        F.avg(ratio(tp, e)).alias("sensitivity"),
        F.avg(ratio(nulls - fp, nulls)).alias("specificity"),
        F.avg(fdp).alias("fdr"),
        F.var_pop(fdp).alias("fdp_var"),
        F.avg((fp > 0).cast("double")).alias("fwer"),
        F.avg((tp > 0).cast("double")).alias("any_power"),
        F.avg(ratio(tp + nulls - fp, m)).alias("accuracy"),
        F.avg(ratio(r, m)).alias("rejection_ratio"),
    )


def combine_results(*frames: DataFrame) -> DataFrame:
    """Stack the results of several runs by column name."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def accuracy(pred: DataFrame, label: str = "label", guess: str = "predicted") -> DataFrame:
    """Accuracy per class and overall (null class)."""
    return pred.rollup(label).agg(F.avg((F.col(guess) == F.col(label)).cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def nmi(df: DataFrame, a: str, b: str, average: str = "arithmetic") -> DataFrame:
    """Normalised mutual information of two labelings, one row ``nmi``; 1 if both are constant.

    The contingency table is aggregated first; what follows has one row per pair of labels.
    """
    cell = df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    na, nb = F.sum("n").over(Window.partitionBy("a")), F.sum("n").over(Window.partitionBy("b"))
    full = cell.withColumns({"na": na, "nb": nb})
    total = cell.agg(F.sum("n").alias("t"))
    full = full.crossJoin(F.broadcast(total))  # one row
    p = F.col("n") / F.col("t")
    mi = F.sum(p * F.ln(F.col("n") * F.col("t") / (F.col("na") * F.col("nb"))))
    ha, hb = -F.sum(p * F.ln(F.col("na") / F.col("t"))), -F.sum(p * F.ln(F.col("nb") / F.col("t")))
    one = full.agg(mi.alias("mi"), ha.alias("ha"), hb.alias("hb"))
    mean = (F.col("ha") + F.col("hb")) / 2 if average == "arithmetic" else F.sqrt(F.col("ha") * F.col("hb"))
    return one.select(F.when(mean > 0, F.col("mi") / mean).otherwise(F.lit(1.0)).alias("nmi"))


def combine_pvalues(tests: DataFrame, cluster: str = "cluster", method: str = "min", p: str = "p") -> DataFrame:
    """Combined p per cluster, back to its members as ``p_combined``: min, geometric or harmonic mean."""
    w = Window.partitionBy(cluster)
    how: dict[str, Column] = {
        "min": F.min(p).over(w),
        "geometric": F.exp(F.avg(F.ln(p)).over(w)),
        "harmonic": F.count(p).over(w) / F.sum(1 / F.col(p)).over(w),
    }
    return tests.withColumn("p_combined", how[method])


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Spearman correlation of two columns (average ranks on ties), one row ``rho``.

    Ranks come from the counts of the distinct values, range-partitioned.
    """
    from loamstat.functions.ordered import ranged

    def ranks(col: str) -> DataFrame:
        counts = df.groupBy(F.col(col).alias("v")).agg(F.count(F.lit(1)).alias("c"))
        frozen = ranged(counts, F.col("v"))
        per = frozen.groupBy("__range").agg(F.sum("c").alias("t"))
        before = per.select("__range", F.coalesce(F.sum("t").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("b"))
        upto = F.sum("c").over(Window.partitionBy("__range").orderBy("v"))
        return frozen.withColumn("u", upto).join(F.broadcast(before), "__range").select(F.col("v").alias(col), (F.col("u") + F.col("b") - (F.col("c") - 1) / 2).alias(f"r_{col}"))

    both = df.select(x, y).join(ranks(x), x).join(ranks(y), y)
    return both.agg(F.corr(f"r_{x}", f"r_{y}").alias("rho"))
