"""Queries over cleaning, group tests and multiple testing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamstat.operators import clean, multitest, stats
from loamstat.plans.tables import event_observations, flag_contrasts, part_observations, read

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):  # noqa: ANN201
    """Register a query under its function's name, with its SQL twin."""

    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


_OBS = """obs AS (
  SELECT l_partkey AS feature_id, concat_ws('-', l_orderkey, l_linenumber) AS sample_id, l_returnflag AS grp,
    log2(l_extendedprice) AS value, CAST(trunc(l_discount * 100) AS INTEGER) AS gap_status FROM lineitem
)"""
_PAIRS = """pairs AS (SELECT * FROM (VALUES ('A-N', 'A', 'N'), ('A-R', 'A', 'R'), ('N-R', 'N', 'R')) v(contrast, grp_x, grp_y))"""

#: Two-sided p of Student's t by Simpson's rule on the arctangent scale.
_P_OF_T = """greatest(0.0, 1 - 2 * exp(lgamma((dof + 1) / 2) - lgamma(dof / 2)) / sqrt(pi()) * (atan(abs(t) / sqrt(dof)) / 400 / 3 *
  list_sum(list_transform(range(0, 401), lambda i: (CASE WHEN i = 0 OR i = 400 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) *
    pow(cos(atan(abs(t) / sqrt(dof)) * i / 400), dof - 1)))))"""

_TESTS = f"""{_OBS}, {_PAIRS}, stats AS (
  SELECT feature_id, grp, count(*) AS n, avg(value) AS mean, var_samp(value) AS var, min(value) AS lo, max(value) AS hi, median(value) AS med
  FROM obs GROUP BY ALL
), spread AS (SELECT feature_id FROM obs GROUP BY 1 HAVING var_samp(value) > 0.5), sides AS (
  SELECT x.feature_id, contrast, x.n AS n1, y.n AS n2, x.mean - y.mean AS fc, x.med - y.med AS median_fc,
    greatest(x.lo - y.hi, y.lo - x.hi, 0) AS min_margin, x.var / x.n AS a, y.var / y.n AS b
  FROM pairs JOIN stats x ON x.grp = grp_x JOIN stats y ON y.grp = grp_y AND y.feature_id = x.feature_id
  WHERE x.feature_id IN (SELECT feature_id FROM spread) AND x.n > 1 AND y.n > 1
), tests AS (
  SELECT *, fc / sqrt(a + b) AS t, (a + b) * (a + b) / (a * a / (n1 - 1) + b * b / (n2 - 1)) AS dof FROM sides WHERE a + b > 0
), p AS (SELECT *, {_P_OF_T} AS p FROM tests)"""


def part_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean, filter by variance, aggregate once, contrast and t-test."""
    obs = clean.log2_values(clean.fill_gaps(part_observations(spark, sf_dir)))
    per = stats.describe_groups(obs, medians=True)
    # a feature's variance from its groups' sizes, means and variances: no second pass over raw rows
    total = F.sum("n")
    between = F.sum(F.col("n") * F.col("mean") ** 2) - F.sum(F.col("n") * F.col("mean")) ** 2 / total
    within = F.sum((F.col("n") - 1) * F.coalesce("var", F.lit(0.0)))
    spread = per.groupBy("feature_id").agg(((within + between) / (total - 1)).alias("v")).where("v > 0.5").select("feature_id")
    pairs = stats.pairwise_contrasts(clean.get_features(per, spread), flag_contrasts(spark))
    return stats.ttest(stats.min_margin(stats.fold_change(pairs))).where("p is not null")


@query(f"""WITH {_TESTS}, ranked AS (SELECT *, count(*) OVER () AS m, rank() OVER (ORDER BY p) + count(*) OVER (PARTITION BY p) - 1 AS r FROM p),
h AS (SELECT sum(1.0 / i) AS c FROM range(1, (SELECT count(*) FROM p) + 1) s(i))
SELECT feature_id, contrast, n1, n2, round(t, 6) + 0 AS t, round(dof, 4) AS dof, round(fc, 6) + 0 AS fc, round(median_fc, 6) + 0 AS median_fc,
  round(min_margin, 6) AS min_margin, round(p, 7) AS p, round(least(1, min(p * m * c / r) OVER (ORDER BY r DESC)), 6) AS p_fdr_by FROM ranked, h""")
def feature_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: F1, F2, F8, J5, A2, A3, A5, M3 (Benjamini-Yekutieli over one large family)."""
    tests = multitest.adjust(part_tests(spark, sf_dir), "fdr_by")
    z = lambda c, d: (F.round(c, d) + 0.0).alias(c)
    return tests.select(
        "feature_id", "contrast", F.col("n_x").alias("n1"), F.col("n_y").alias("n2"), z("t", 6), z("dof", 4), z("fc", 6), z("median_fc", 6), z("min_margin", 6), z("p", 7), z("p_fdr_by", 6)
    )


@query(f"""WITH {_TESTS}, r AS (SELECT *, count(*) OVER () AS m, rank() OVER (ORDER BY p) + count(*) OVER (PARTITION BY p) - 1 AS k FROM p),
b AS (SELECT *, min(p * m / k) OVER (ORDER BY k DESC) AS bh FROM r)
SELECT feature_id, contrast, p * 100.5 < 0.05 AS by_bonferroni, least(1, bh) <= 0.05 * m / 100.5 AS by_bh FROM b""")
def effective_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M9: rejections with 100.5 effective tests in place of all."""
    tests = part_tests(spark, sf_dir).select("feature_id", "contrast", "p")
    one = multitest.adjust_effective(tests, 100.5).withColumnRenamed("reject", "by_bonferroni")
    return multitest.adjust_effective(one, 100.5, "bh").withColumnRenamed("reject", "by_bh").select("feature_id", "contrast", "by_bonferroni", "by_bh")


@query(f"""WITH {_OBS}, g AS (SELECT feature_id, grp, count(*) AS n, avg(value) AS m, coalesce(var_samp(value), 0) AS v FROM obs GROUP BY ALL),
w AS (SELECT feature_id, sum(n) - count(*) AS dof, sum((n - 1) * v) AS rss, max(m) FILTER (grp = 'A') AS m0, max(n) FILTER (grp = 'A') AS n0 FROM g GROUP BY 1 HAVING dof > 0 AND n0 IS NOT NULL)
SELECT feature_id, CASE grp WHEN 'A' THEN '(intercept)' ELSE grp END AS term, round(CASE grp WHEN 'A' THEN m0 ELSE m - m0 END, 6) + 0 AS beta,
  round(sqrt(rss / dof * (1 / n0 + CASE grp WHEN 'A' THEN 0 ELSE 1 / n END)), 6) + 0 AS se FROM g JOIN w USING (feature_id)""")
def dummy_coded_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least squares on dummy-coded groups per feature."""
    per = stats.describe_groups(clean.log2_values(part_observations(spark, sf_dir)))
    return stats.group_ols(per, "A").select("feature_id", "term", *[(F.round(c, 6) + 0.0).alias(c) for c in ("beta", "se")])


@query(f"""WITH {_TESTS}, ranked AS (
  SELECT *, count(*) OVER (PARTITION BY contrast) AS m, rank() OVER (PARTITION BY contrast ORDER BY p) AS lo,
    count(*) OVER (PARTITION BY contrast ORDER BY p) AS hi FROM p
)
SELECT contrast, feature_id, round(least(1, p * m), 6) AS p_bonferroni,
  round(least(1, max(p * (m - lo + 1)) OVER (PARTITION BY contrast ORDER BY p)), 6) AS p_holm,
  round(least(1, min(p * m / hi) OVER (PARTITION BY contrast ORDER BY p DESC)), 6) AS p_fdr_bh FROM ranked""")
def corrections_by_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1-M3 with each contrast as a family."""
    tests = part_tests(spark, sf_dir)
    for method in ("bonferroni", "holm", "fdr_bh"):
        tests = multitest.adjust(tests, method, ["contrast"]).drop("reject")
    return tests.select("contrast", "feature_id", *[F.round(f"p_{m}", 6).alias(f"p_{m}") for m in ("bonferroni", "holm", "fdr_bh")])


@query(f"""WITH {_TESTS}, ranked AS (SELECT *, count(*) OVER () AS m, rank() OVER (ORDER BY p) AS lo FROM p)
SELECT contrast, feature_id, round(least(1, max(p * (m - lo + 1)) OVER (ORDER BY p)), 6) AS p_holm FROM ranked""")
def holm_one_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2 over one large family, by range partitions."""
    return multitest.adjust(part_tests(spark, sf_dir), "holm").select("contrast", "feature_id", F.round("p_holm", 6).alias("p_holm"))


@query(f"""WITH {_TESTS}, b AS (SELECT *, least(1, p * count(*) OVER ()) AS pb FROM p)
SELECT contrast, count(*) AS tests, CAST(count(*) FILTER (p < 0.05) AS BIGINT) AS uncorrected, CAST(count(*) FILTER (pb < 0.05) AS BIGINT) AS p_bonferroni,
  count(DISTINCT CASE WHEN p < 0.05 THEN feature_id END) AS features, CAST(count(*) FILTER (abs(fc) >= 0.5) AS BIGINT) AS large_fc,
  CAST(count(*) FILTER (min_margin > 0) AS BIGINT) AS with_margin FROM b GROUP BY ROLLUP (contrast)""")
def discovery_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A13."""
    return stats.discovery_summary(multitest.adjust(part_tests(spark, sf_dir), "bonferroni"), fc_min=0.5)


@query(f"""WITH {_TESTS}, ranked AS (SELECT *, count(*) OVER (PARTITION BY contrast) AS m, row_number() OVER (PARTITION BY contrast ORDER BY p, feature_id) AS k FROM p),
w AS (SELECT *, (m + 1 - k) / (1 - p) AS m0k FROM ranked), l AS (SELECT *, lag(m0k) OVER (PARTITION BY contrast ORDER BY p, feature_id) AS before FROM w)
SELECT contrast, max(m) AS m, CAST(least(coalesce(ceil(min_by(m0k, k) FILTER (m0k > before)), max(m)), max(m)) AS BIGINT) AS m0 FROM l GROUP BY contrast""")
def true_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M5."""
    return multitest.m0_bh(part_tests(spark, sf_dir), ["contrast"])


@query(f"""WITH {_TESTS}, r AS (SELECT *, count(*) OVER (PARTITION BY contrast) AS m, count(*) OVER (PARTITION BY contrast ORDER BY p) AS hi FROM p),
q AS (SELECT *, min(p * m / hi) OVER (PARTITION BY contrast ORDER BY p DESC) AS bh FROM r), e AS (
  SELECT contrast, m, m - count(*) FILTER (bh <= 0.05 / 1.05) AS m0 FROM q GROUP BY contrast, m)
SELECT contrast, CAST(any_value(e.m) AS BIGINT) AS m, CAST(any_value(m0) AS BIGINT) AS m0,
  CAST(count(*) FILTER (m0 = 0 OR least(1, bh) * m0 / e.m <= 0.05 / 1.05) AS BIGINT) AS rejected FROM q JOIN e USING (contrast) GROUP BY contrast""")
def bky_two_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M6."""
    done = multitest.two_stage(part_tests(spark, sf_dir), ["contrast"], "bky")
    return done.groupBy("contrast").agg(F.max("m").alias("m"), F.max("m0").alias("m0"), F.sum(F.col("reject").cast("long")).alias("rejected"))


@query(f"""WITH {_TESTS}, b AS (SELECT *, p * count(*) OVER (PARTITION BY contrast) < 0.05 AS reject FROM p)
SELECT contrast, round(max(p) FILTER (reject), 7) AS last_rejected, round(min(p) FILTER (NOT reject), 7) AS first_kept FROM b GROUP BY contrast""")
def decision_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M10."""
    done = multitest.boundary(multitest.adjust(part_tests(spark, sf_dir), "bonferroni", ["contrast"]), ["contrast"])
    return done.select("contrast", F.round("last_rejected", 7).alias("last_rejected"), F.round("first_kept", 7).alias("first_kept"))


@query(f"""WITH {_TESTS} SELECT contrast, count(*) AS m, 0.05 / count(*) AS bonferroni, round(1 - pow(0.95, 1.0 / count(*)), 10) AS sidak FROM p GROUP BY contrast""")
def alpha_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M4."""
    return multitest.alpha_levels(part_tests(spark, sf_dir), 0.05, ["contrast"]).withColumn("sidak", F.round("sidak", 10))


@query(f"""WITH {_TESTS}, pp AS (SELECT round(p, 6) AS p FROM p) SELECT round(1 - p, 6) AS x, round((SELECT count(*) FROM pp q WHERE q.p > a.p) / (SELECT count(*) FROM pp), 8) AS y FROM pp a""")
def schweder_spjotvoll(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M11."""
    tests = part_tests(spark, sf_dir).select(F.round("p", 6).alias("p"))
    return multitest.spjotvoll(tests).select(F.round("x", 6).alias("x"), F.round("y", 8).alias("y"))


@query(f"""WITH {_OBS} SELECT coalesce(feature_id, -1) AS feature_id, coalesce(grp, '*') AS grp, grouping_id(feature_id, grp) AS level, count(*) AS n, round(avg(value), 8) AS mean, round(var_pop(value), 8) AS var_pop, round(var_samp(value), 8) AS var_samp
FROM obs GROUP BY GROUPING SETS ((feature_id, grp), (feature_id), ())""")
def group_description(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1."""
    d = stats.describe_levels(clean.log2_values(part_observations(spark, sf_dir)))
    named = (F.coalesce("feature_id", F.lit(-1)).alias("feature_id"), F.coalesce("grp", F.lit("*")).alias("grp"))
    return d.select(*named, "level", "n", *[F.round(c, 8).alias(c) for c in ("mean", "var_pop", "var_samp")])


@query(f"""WITH {_OBS}, k AS (SELECT feature_id, var_pop(value) AS measure FROM obs GROUP BY 1), c AS (SELECT quantile_cont(measure, 0.4) AS cut FROM k)
SELECT feature_id, count(*) AS n, round(any_value(measure), 8) AS measure FROM obs JOIN k USING (feature_id), c WHERE measure > cut GROUP BY 1""")
def variance_proportion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8 by share."""
    kept = clean.variance_filter(clean.log2_values(part_observations(spark, sf_dir)), 0.4, "proportion", ddof=0)
    return kept.groupBy("feature_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("measure"), 8).alias("measure"))


@query(f"""WITH {_OBS}, k AS (SELECT feature_id, abs(avg(value)) AS measure FROM obs GROUP BY 1 HAVING abs(avg(value)) > 15.2)
SELECT feature_id, count(*) AS n, round(any_value(measure), 8) AS measure FROM obs JOIN k USING (feature_id) GROUP BY 1""")
def mean_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F9."""
    kept = clean.mean_filter(clean.log2_values(part_observations(spark, sf_dir)), 15.2)
    return kept.groupBy("feature_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("measure"), 8).alias("measure"))


@query(f"""WITH {_OBS}, m AS (SELECT feature_id, avg(value) AS mu FROM obs GROUP BY 1), k AS (
  SELECT feature_id, avg(abs(value - mu)) AS measure FROM obs JOIN m USING (feature_id) GROUP BY 1 HAVING avg(abs(value - mu)) >= 0.9)
SELECT feature_id, count(*) AS n, round(any_value(measure), 8) AS measure FROM obs JOIN k USING (feature_id) GROUP BY 1""")
def mad_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F10."""
    kept = clean.mad_filter(clean.log2_values(part_observations(spark, sf_dir)), 0.9)
    return kept.groupBy("feature_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("measure"), 8).alias("measure"))


@query(f"""WITH {_OBS}, k AS (SELECT feature_id, max(value) - min(value) AS measure FROM obs GROUP BY 1 HAVING max(value) - min(value) > 4)
SELECT feature_id, count(*) AS n, round(any_value(measure), 8) AS measure FROM obs JOIN k USING (feature_id) GROUP BY 1""")
def range_measure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F11 with the range as measure."""
    kept = clean.filter_features(clean.log2_values(part_observations(spark, sf_dir)), F.max("value") - F.min("value"), lambda m: m > 4)
    return kept.groupBy("feature_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("measure"), 8).alias("measure"))


@query(f"""WITH {_TESTS}, r AS (SELECT feature_id, fc, row_number() OVER (ORDER BY abs(fc), feature_id) AS k, count(*) OVER () AS m FROM p WHERE contrast = 'A-N')
SELECT feature_id, round(fc, 6) + 0 AS fc FROM r WHERE k > CAST(floor(0.3 * m) AS BIGINT)""")
def drop_lowest_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F12 by fold change."""
    tests = part_tests(spark, sf_dir).where("contrast = 'A-N'")
    return clean.drop_bottom(tests, F.abs("fc"), 0.3).select("feature_id", (F.round("fc", 6) + 0.0).alias("fc"))


_GAPS = f"""{_OBS}, {_PAIRS}, g AS (
  SELECT feature_id, grp, avg(CASE WHEN gap_status IN (0, 8, 64, 128, 1, 2, 3, 4, 5) THEN 1.0 ELSE 0 END) AS ok,
    CAST(sum(CASE WHEN gap_status IN (0, 8, 64, 128, 1, 2, 3, 4, 5) THEN 0 ELSE 1 END) AS BIGINT) AS gaps FROM obs GROUP BY ALL
), rel AS (
  SELECT x.feature_id, contrast, x.gaps AS gaps1, y.gaps AS gaps2, x.ok >= 0.8 OR y.ok >= 0.8 AS reliable
  FROM pairs JOIN g x ON x.grp = grp_x JOIN g y ON y.grp = grp_y AND y.feature_id = x.feature_id
)"""
_ACCEPT = (0, 8, 64, 128, 1, 2, 3, 4, 5)


@query(f"WITH {_GAPS} SELECT * FROM rel")
def gap_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F13."""
    return clean.reliability(clean.fill_gaps(part_observations(spark, sf_dir)), flag_contrasts(spark), 0.8, _ACCEPT)


@query(f"WITH {_GAPS} SELECT * FROM rel WHERE (gaps1 >= 5 AND gaps2 <= 2) OR (gaps2 >= 5 AND gaps1 <= 2)")
def absence_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F15."""
    return clean.absent_present(clean.reliability(part_observations(spark, sf_dir), flag_contrasts(spark), 0.8, _ACCEPT), 5, 2)


@query(f"""WITH {_OBS} SELECT feature_id, round(avg(CASE WHEN gap_status IN (0, 1, 2, 3, 4) THEN 1.0 ELSE 0 END), 8) AS accepted FROM obs GROUP BY 1
HAVING avg(CASE WHEN gap_status IN (0, 1, 2, 3, 4) THEN 1.0 ELSE 0 END) >= 0.5""")
def reliable_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F14."""
    return clean.reliable_features(part_observations(spark, sf_dir), 0.5, (0, 1, 2, 3, 4)).select("feature_id", F.round("accepted", 8).alias("accepted"))


@query(f"WITH {_TESTS}, b AS (SELECT DISTINCT feature_id FROM p WHERE p < 0.05) SELECT feature_id, count(*) AS n FROM obs WHERE feature_id NOT IN (SELECT feature_id FROM b) GROUP BY 1")
def features_without_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F17."""
    tests = part_tests(spark, sf_dir).withColumn("reject", F.col("p") < 0.05)
    return clean.null_features(part_observations(spark, sf_dir), tests).groupBy("feature_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_TESTS}, k AS (SELECT DISTINCT feature_id FROM p WHERE p < 0.01)
SELECT feature_id, string_agg(contrast || ':' || printf('%.5f', p), ';' ORDER BY contrast) AS tests FROM p WHERE feature_id IN (SELECT feature_id FROM k) GROUP BY 1""")
def pvalues_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F16, F18."""
    tests = part_tests(spark, sf_dir)
    got = clean.extract_pvalues(tests, tests.where("p < 0.01").select("feature_id").distinct())
    line = F.transform("tests", lambda t: F.concat(t["contrast"], F.lit(":"), F.format_string("%.5f", t["p"])))
    return got.select("feature_id", F.array_join(line, ";").alias("tests"))


@query(f"WITH {_OBS} SELECT feature_id, sample_id, round(value - avg(value) OVER (PARTITION BY feature_id, grp), 6) + 0 AS value FROM obs")
def residuals_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F24."""
    out = clean.group_residuals(clean.log2_values(part_observations(spark, sf_dir)))
    return out.select("feature_id", "sample_id", (F.round("value", 6) + 0.0).alias("value"))


@query(f"""WITH {_TESTS}, k AS (SELECT DISTINCT feature_id FROM p WHERE p < 0.05), w AS (
  SELECT *, avg(value) OVER (PARTITION BY feature_id, grp) AS gm, avg(value) FILTER (grp = 'N') OVER (PARTITION BY feature_id) AS base FROM obs)
SELECT feature_id, sample_id, round(CASE WHEN feature_id IN (SELECT feature_id FROM k) THEN value - 0.5 * gm + base ELSE value END, 6) AS value FROM w""")
def effects_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F25."""
    tests = part_tests(spark, sf_dir).withColumn("reject", F.col("p") < 0.05)
    out = clean.remove_effects(clean.log2_values(part_observations(spark, sf_dir)), tests, "N", 0.5)
    return out.select("feature_id", "sample_id", F.round("value", 6).alias("value"))


@query(f"""WITH {_OBS}, r AS (
  SELECT *, row_number() OVER (PARTITION BY feature_id, grp ORDER BY value, sample_id) AS u, row_number() OVER (PARTITION BY feature_id, grp ORDER BY value DESC, sample_id DESC) AS d FROM obs
), g AS (SELECT feature_id, grp, min(value) FILTER (u = 3) AS lo, max(value) FILTER (d = 3) AS hi FROM r GROUP BY ALL), {_PAIRS}
SELECT x.feature_id, contrast, round(greatest(x.lo - y.hi, y.lo - x.hi), 6) AS kth_margin FROM pairs JOIN g x ON x.grp = grp_x JOIN g y ON y.grp = grp_y AND y.feature_id = x.feature_id""")
def third_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4 with k = 2."""
    out = stats.kth_margin(clean.log2_values(part_observations(spark, sf_dir)), flag_contrasts(spark), 2)
    return out.withColumn("kth_margin", F.round("kth_margin", 6))


_EV = "ev AS (SELECT user_id AS feature_id, event_type AS grp, value FROM events)"


@query(f"""WITH {_EV}, g AS (SELECT feature_id, grp, count(*) AS n, avg(value) AS m, var_samp(value) AS v FROM ev GROUP BY ALL), t AS (
  SELECT feature_id, count(*) - 1.0 AS d1, sum(n) - count(*) AS d2, sum(n * m * m) - sum(n * m) * sum(n * m) / sum(n) AS b, sum((n - 1) * coalesce(v, 0)) AS w FROM g GROUP BY 1)
SELECT feature_id, CAST(d1 AS DOUBLE) AS d1, CAST(d2 AS DOUBLE) AS d2, round((b / d1) / (w / d2), 6) AS f FROM t WHERE d1 > 0 AND d2 > 0 AND w > 0""")
def anova_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A6."""
    return stats.anova(event_observations(spark, sf_dir)).where("f is not null").select("feature_id", "d1", "d2", F.round("f", 6).alias("f"))


@query(f"""WITH {_EV}, g AS (SELECT feature_id, grp, count(*) AS n, avg(value) AS m, var_samp(value) AS v FROM ev GROUP BY ALL HAVING count(*) > 1 AND var_samp(value) > 0),
w AS (SELECT *, n / v AS w FROM g), s AS (SELECT *, sum(w) OVER (PARTITION BY feature_id) AS ws, sum(w * m) OVER (PARTITION BY feature_id) / sum(w) OVER (PARTITION BY feature_id) AS gm FROM w),
t AS (SELECT feature_id, CAST(count(*) AS DOUBLE) AS k, sum(w * (m - gm) * (m - gm)) AS num, sum((1 - w / ws) * (1 - w / ws) / (n - 1)) AS lam FROM s GROUP BY 1 HAVING count(*) > 1)
SELECT feature_id, round(num / (k - 1) / (1 + 2 * (k - 2) / (k * k - 1) * lam), 6) AS f, k - 1 AS d1, round((k * k - 1) / (3 * lam), 6) AS d2 FROM t""")
def welch_anova_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A6."""
    return stats.welch_anova(event_observations(spark, sf_dir)).select("feature_id", F.round("f", 6).alias("f"), "d1", F.round("d2", 6).alias("d2"))


@query("""SELECT CAST(least(floor((o_totalprice - lo) / ((hi - lo) / 20)), 19) AS INTEGER) AS bin, o_orderstatus, count(*) AS n
FROM orders, (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders) GROUP BY ALL""")
def price_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A12."""
    return stats.histogram(read(spark, sf_dir, "orders"), "o_totalprice", 20, ["o_orderstatus"])


@query("""WITH r AS (SELECT (rank() OVER (ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_totalprice) - 1) / 2.0) AS a,
  (rank() OVER (ORDER BY o_custkey) + (count(*) OVER (PARTITION BY o_custkey) - 1) / 2.0) AS b FROM orders) SELECT round(corr(a, b), 8) AS rho FROM r""")
def spearman_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A11."""
    return stats.spearman(read(spark, sf_dir, "orders"), "o_totalprice", "o_custkey").select(F.round("rho", 8).alias("rho"))


@query("""WITH c AS (SELECT o_orderpriority AS a, o_orderstatus AS b, count(*) * 1.0 AS n FROM orders GROUP BY ALL), w AS (
  SELECT *, sum(n) OVER (PARTITION BY a) AS na, sum(n) OVER (PARTITION BY b) AS nb, sum(n) OVER () AS t FROM c)
SELECT round(sum(n / t * ln(n * t / (na * nb))) / ((-sum(n / t * ln(na / t)) - sum(n / t * ln(nb / t))) / 2), 10) AS nmi FROM w""")
def label_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A19."""
    return stats.nmi(read(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus").select(F.round("nmi", 10).alias("nmi"))


@query("""WITH t AS (SELECT feature_id, contrast, a + b >= 12 AS effect, abs(a - b) >= 4 AS reject FROM (
  SELECT l_partkey AS feature_id, l_linestatus AS contrast, count(*) FILTER (l_returnflag = 'A') AS a, count(*) FILTER (l_returnflag = 'R') AS b FROM lineitem GROUP BY ALL))
SELECT contrast, CAST(count(*) FILTER (reject AND effect) AS BIGINT) AS tp, CAST(count(*) FILTER (reject AND NOT effect) AS BIGINT) AS fp,
  CAST(count(*) FILTER (NOT reject AND NOT effect) AS BIGINT) AS tn, CAST(count(*) FILTER (NOT reject AND effect) AS BIGINT) AS fn,
  round(coalesce(count(*) FILTER (reject AND effect) / nullif(count(*) FILTER (effect), 0), 0), 8) AS power FROM t GROUP BY contrast""")
def confusion_by_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A14."""
    n = lambda f: F.sum((F.col("l_returnflag") == f).cast("long"))
    t = read(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("feature_id"), F.col("l_linestatus").alias("contrast")).agg(n("A").alias("a"), n("R").alias("b"))
    tests = t.select("feature_id", "contrast", (F.abs(F.col("a") - F.col("b")) >= 4).alias("reject"))
    truth = t.select("feature_id", "contrast", (F.col("a") + F.col("b") >= 12).alias("effect"))
    return stats.confusion(tests, truth, ["feature_id", "contrast"], ["contrast"]).withColumn("power", F.round("power", 8))


@query(f"""WITH {_TESTS}, c AS (SELECT feature_id, contrast, p, feature_id % 50 AS cluster FROM p WHERE contrast = 'A-R')
SELECT feature_id, round(min(p) OVER (PARTITION BY cluster), 6) AS p_min, round(exp(avg(ln(p)) OVER (PARTITION BY cluster)), 6) AS p_geometric,
  round(count(p) OVER (PARTITION BY cluster) / sum(1 / p) OVER (PARTITION BY cluster), 6) AS p_harmonic FROM c""")
def combined_pvalues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A22, J6."""
    c = part_tests(spark, sf_dir).where("contrast = 'A-R'").select("feature_id", "p", (F.col("feature_id") % 50).alias("cluster"))
    for m in ("min", "geometric", "harmonic"):
        c = stats.combine_pvalues(c, method=m).withColumnRenamed("p_combined", f"p_{m}")
    return c.select("feature_id", *[F.round(f"p_{m}", 6).alias(f"p_{m}") for m in ("min", "geometric", "harmonic")])
