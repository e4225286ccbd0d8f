"""Queries over resampling, correlation, clusters, factors, regression, sensitivity and posteriors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamstat.functions import selection
from loamstat.functions.work import materialize
from loamstat.operators import bayes, calibrate, clean, cluster, correlate, factor, joins, multitest, regress, resample, sensitivity, sparse, stats, text, two_level
from loamstat.plans.mining import _COUNTS, _counts
from loamstat.plans.tables import event_observations, read
from loamstat.plans.testing import _P_OF_T

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _key(rep: str, ident: str, seed: str) -> str:
    """``resample.keyed`` in SQL."""
    p = resample.MOD
    x = f"(({rep} * 1103515245 + {ident} * 12345 + {seed}) % {p})"
    return f"({x} * {x} % {p}) * ({x} * {x} % {p}) % {p} * {x} % {p}"


_DIMS = "e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), c AS (SELECT unnest(range(64)) AS f, vec_id, unnest(v) AS x FROM e)"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))


def dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 64 dimensions as features, vectors as samples, packed."""
    cells = vectors(spark, sf_dir).select(F.posexplode("v").alias("feature_id", "value"), F.col("vec_id").alias("sample_id"))
    return correlate.pack(cells.withColumn("feature_id", F.col("feature_id").cast("long")))


_CORR = f"""{_DIMS}, r AS (SELECT a.f AS i, b.f AS j, corr(a.x, b.x) AS r, count(*) AS n FROM c a JOIN c b ON a.vec_id = b.vec_id AND a.f < b.f GROUP BY ALL),
tt AS (SELECT *, r * sqrt((n - 2) / (1 - r * r)) AS t, CAST(n - 2 AS DOUBLE) AS dof FROM r), p AS (SELECT *, {_P_OF_T} AS p FROM tt)"""


@query(f"""WITH {_CORR}, k AS (SELECT *, count(*) OVER () AS m, rank() OVER (ORDER BY p) + count(*) OVER (PARTITION BY p) - 1 AS rk FROM p), h AS (SELECT sum(1.0 / s.i) AS c FROM range(1, 2017) s(i))
SELECT i, j, round(r, 8) + 0 AS r, round(p, 6) AS p, round(least(1, min(p * m * c / rk) OVER (ORDER BY rk DESC)), 6) AS p_fdr_by FROM k, h""")
def correlation_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A9."""
    n = read(spark, sf_dir, "embeddings").count()
    out = multitest.adjust(correlate.edge_tests(correlate.column_edges(vectors(spark, sf_dir)), n), "fdr_by")
    return out.select("i", "j", (F.round("r", 8) + 0.0).alias("r"), F.round("p", 6).alias("p"), F.round("p_fdr_by", 6).alias("p_fdr_by"))


@query(f"""WITH {_CORR} SELECT i, j, round(tanh(atanh(r) - 1.959963984540054 / sqrt(n - 3)), 6) + 0 AS lo, round(tanh(atanh(r) + 1.959963984540054 / sqrt(n - 3)), 6) + 0 AS hi FROM r""")
def correlation_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10."""
    n = read(spark, sf_dir, "embeddings").count()
    out = correlate.correlation_ci(correlate.column_edges(vectors(spark, sf_dir)), n)
    return out.select("i", "j", (F.round("lo", 6) + 0.0).alias("lo"), (F.round("hi", 6) + 0.0).alias("hi"))


_NEAR = f"""{_DIMS}, d AS (SELECT a.vec_id AS i, b.vec_id AS j, 1 - corr(a.x, b.x) AS distance FROM c a JOIN c b ON a.f = b.f AND a.vec_id < b.vec_id GROUP BY ALL HAVING corr(a.x, b.x) >= 0.45)"""


def _near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correlate.correlation_distance(vectors(spark, sf_dir).withColumnRenamed("vec_id", "feature_id"), 0.45)


@query(f"WITH {_NEAR} SELECT i, j, round(distance, 6) AS distance FROM d")
def correlation_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C1 between vectors."""
    return _near_vectors(spark, sf_dir).withColumn("distance", F.round("distance", 6))


@query(f"""WITH RECURSIVE {_NEAR}, b AS (SELECT i AS x, j AS y FROM d UNION SELECT j, i FROM d), w(node, r) AS (SELECT DISTINCT x, x FROM b UNION SELECT w.node, b.y FROM w JOIN b ON b.x = w.r)
SELECT node, min(r) AS component FROM w GROUP BY node""")
def graph_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C3."""
    return correlate.threshold_graph(_near_vectors(spark, sf_dir), 0.5500001)[1]


@query()
def linkage_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C2 of all pairs correlated by a quarter or more."""
    return correlate.linkage_of_vectors(vectors(spark, sf_dir), 0.75, "vec_id")


@query()
def negative_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C4 over the linkage clusters."""
    packed = vectors(spark, sf_dir).withColumnRenamed("vec_id", "feature_id")
    return correlate.negative_clusters(packed, linkage_clusters(spark, sf_dir), 0.2)


@query()
def effective_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M7, M8: every formula over the 64 dimensions."""
    v = vectors(spark, sf_dir)
    lam = np.linalg.eigvalsh(correlate.column_correlations(v))
    rows = [(m, correlate.n_eff_of(lam, 64, m)) for m in ("nyholt", "li", "cheverud", "bretherton", "galwey", "peluso", "li_ji")]
    by_cluster = correlate.n_eff_cluster(correlate.column_edges(v).where("r >= 0.1").select("i", "j", (1 - F.col("r")).alias("distance")), 64, 0.9).first()["m_eff"]
    return spark.createDataFrame([*rows, ("clusters", by_cluster)], "method string, m_eff long")


@query(f"""WITH {_CORR}, s AS (SELECT 64.0 AS m, 64 + 2 * sum(r * r) AS q FROM r), v AS (SELECT *, q - m AS spread FROM s), f AS (
  SELECT 'nyholt' AS method, 1 + (m - 1) * (1 - spread / (m - 1) / m) AS x FROM v UNION ALL SELECT 'li', 1 + (m - 1) * (1 - spread / m / m) FROM v
  UNION ALL SELECT 'cheverud', m * (1 - (m - 1) * (spread / m) / (m * m)) FROM v UNION ALL SELECT 'bretherton', m * m / q FROM v
), z AS (SELECT method, CAST(floor(x) AS BIGINT) AS m_eff FROM f)
SELECT method, m_eff, round(1 - pow(0.95, 1.0 / m_eff), 8) AS sidak, round(0.05 / m_eff, 8) AS bonferroni FROM z""")
def effective_tests_by_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M7: the formulas of sums of eigenvalues and squares, with their levels."""
    lam = np.linalg.eigvalsh(correlate.column_correlations(vectors(spark, sf_dir)))
    rows = [(m, correlate.n_eff_of(lam, 64, m)) for m in ("nyholt", "li", "cheverud", "bretherton")]
    rows = [(m, k, *(round(float(x), 8) for x in correlate.effective_levels(k))) for m, k in rows]
    return spark.createDataFrame(rows, "method string, m_eff long, sidak double, bonferroni double")


_REPS = 12
_PERM = f"""{_DIMS}, s AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS pos FROM e), k AS (
  SELECT rep, pos, vec_id, {_key("rep", "pos", "1")} AS key FROM s, range(1, {_REPS + 1}) g(rep)
), o AS (SELECT rep, vec_id, row_number() OVER (PARTITION BY rep ORDER BY key, pos) <= (SELECT count(*) // 2 FROM e) AS x FROM k), g AS (
  SELECT rep, f, o.x AS side, count(*) AS n, avg(c.x) AS m, var_samp(c.x) AS v FROM o JOIN c USING (vec_id) GROUP BY ALL
), tt AS (
  SELECT a.rep, a.f, (a.m - b.m) / sqrt(a.v / a.n + b.v / b.n) AS t, pow(a.v / a.n + b.v / b.n, 2) / (pow(a.v / a.n, 2) / (a.n - 1) + pow(b.v / b.n, 2) / (b.n - 1)) AS dof
  FROM g a JOIN g b ON a.rep = b.rep AND a.f = b.f AND a.side AND NOT b.side
), p AS (SELECT *, {_P_OF_T} AS p FROM tt)"""


@query(f"WITH {_PERM} SELECT rep, round(min(p), 6) AS min_p, round(max(abs(t)), 6) AS max_t FROM p GROUP BY rep")
def permutation_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minimum p and maximum |t| per replicate (the keys are portable, so SQL repeats them)."""
    n = read(spark, sf_dir, "embeddings").count()
    out = resample.row_permutation_extremes(vectors(spark, sf_dir), n // 2, _REPS)
    return out.select("rep", F.round("min_p", 6).alias("min_p"), F.round("max_t", 6).alias("max_t"))


_PERM_OWN = _PERM.replace("SELECT rep, pos, vec_id, " + _key("rep", "pos", "1"), "SELECT rep, f, pos, vec_id, " + _key("rep", "pos", "1 + f * 7919"))
_PERM_OWN = _PERM_OWN.replace(f"FROM s, range(1, {_REPS + 1}) g(rep)", f"FROM s, range(1, {_REPS + 1}) g(rep), range(64) h(f)").replace("SELECT rep, vec_id, row_number() OVER (PARTITION BY rep ORDER", "SELECT rep, f, vec_id, row_number() OVER (PARTITION BY rep, f ORDER")
_PERM_OWN = _PERM_OWN.replace("SELECT rep, f, o.x AS side", "SELECT rep, c.f, o.x AS side").replace("FROM o JOIN c USING (vec_id)", "FROM o JOIN c ON c.vec_id = o.vec_id AND c.f = o.f")


@query(f"WITH {_PERM_OWN} SELECT rep, round(min(p), 6) AS min_p, round(max(abs(t)), 6) AS max_t FROM p GROUP BY rep")
def permutation_extremes_independent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R2: every column with a shuffle of its own."""
    n = read(spark, sf_dir, "embeddings").count()
    out = resample.row_permutation_extremes(vectors(spark, sf_dir), n // 2, _REPS, independent=True)
    return out.select("rep", F.round("min_p", 6).alias("min_p"), F.round("max_t", 6).alias("max_t"))


@query()
def significance_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level, order-statistic interval, effective number of tests."""
    n = read(spark, sf_dir, "embeddings").count()
    return resample.level_of(resample.row_permutation_extremes(vectors(spark, sf_dir), n // 2, 2000), 64, 0.05, 2000)


@query()
def significance_level_independent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R2."""
    n = read(spark, sf_dir, "embeddings").count()
    return resample.level_of(resample.row_permutation_extremes(vectors(spark, sf_dir), n // 2, 300, independent=True), 64, 0.05, 300)


@query()
def westfall_young(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R3 thresholds."""
    n = read(spark, sf_dir, "embeddings").count()
    return resample.thresholds_of(resample.row_permutation_extremes(vectors(spark, sf_dir), n // 2, 1000, equal_var=True), 0.05, 1000)


@query("""WITH s AS (SELECT event_type AS k, abs(value - 50) AS t FROM events), q AS (SELECT user_id AS k, abs(avg(value) - 50) AS t FROM events GROUP BY 1)
SELECT q.k AS user_id, round((SELECT count(*) FROM s WHERE s.t >= q.t) / (SELECT count(*) FROM s), 8) AS p_resampled FROM q""")
def pooled_exceedance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's mean deviation against the pool of single deviations."""
    e = read(spark, sf_dir, "events")
    tests = e.groupBy("user_id").agg((F.avg("value") - 50).alias("t"))
    out = resample.reiner_adjust(tests, e.select((F.col("value") - 50).alias("t")), ["user_id"])
    return out.select("user_id", F.round("p_resampled", 8).alias("p_resampled"))


def _event_pairs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("click-view", "click", "view"), ("error-view", "error", "view")], "contrast string, grp_x string, grp_y string")


@query()
def group_permutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R5."""
    obs = event_observations(spark, sf_dir).withColumn("sample_id", F.col("value"))
    out = resample.group_permutation(obs, _event_pairs(spark), 20)
    return out.groupBy("contrast").agg(F.count(F.lit(1)).alias("n"), F.percentile("p", F.lit(0.05)).alias("p05"))


@query(f"""WITH a AS (SELECT user_id AS f, CASE event_type WHEN 'click' THEN 0 ELSE 1 END AS side, list(value ORDER BY value) AS v FROM events WHERE event_type IN ('click', 'view') AND value IS NOT NULL GROUP BY ALL),
b AS (SELECT * FROM a WHERE f IN (SELECT f FROM a GROUP BY f HAVING count(*) = 2)), d AS (SELECT f, side, rep, v, unnest(range(len(v))) AS i FROM b, range(50) g(rep)),
k AS (SELECT f, side, rep, v[({_key("rep", "(i + side * 100003)", "1 + f")}) % len(v) + 1] AS x FROM d),
m AS (SELECT f, rep, avg(x) FILTER (side = 0) - avg(x) FILTER (side = 1) AS effect FROM k GROUP BY ALL) SELECT f AS feature_id, round(avg(effect) + 1e-9, 6) + 0 AS mean, round(stddev_samp(effect) + 1e-9, 6) + 0 AS sd FROM m GROUP BY 1""")
def bootstrap_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R6 (the keys are portable, so SQL repeats the draws)."""
    obs = event_observations(spark, sf_dir).withColumn("sample_id", F.col("value")).where("value is not null")
    per = resample.bootstrap_effect(obs, "click", "view", 50).groupBy("feature_id").agg(F.avg("effect").alias("mean"), F.stddev_samp("effect").alias("sd"))
    # means of a few decimals often end in a 5: a little is added before rounding
    return per.select("feature_id", *[(F.round(F.col(c) + 1e-9, 6) + 0.0).alias(c) for c in ("mean", "sd")])


@query(f"""WITH a AS (SELECT user_id AS f, CASE event_type WHEN 'click' THEN 0 ELSE 1 END AS side, list(value ORDER BY value) AS v FROM events WHERE event_type IN ('click', 'view') AND value IS NOT NULL GROUP BY ALL),
b AS (SELECT * FROM a WHERE f IN (SELECT f FROM a GROUP BY f HAVING count(*) = 2)), d AS (SELECT f, side, rep, v, 0 AS i FROM b, range(50) g(rep)),
k AS (SELECT f, side, rep, v[({_key("rep", "(i + side * 100003)", "1 + f")}) % len(v) + 1] AS x FROM d),
m AS (SELECT f, rep, avg(x) FILTER (side = 0) - avg(x) FILTER (side = 1) AS effect FROM k GROUP BY ALL) SELECT f AS feature_id, round(avg(effect) + 1e-9, 6) + 0 AS mean, round(stddev_samp(effect) + 1e-9, 6) + 0 AS sd FROM m GROUP BY 1""")
def single_draw_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One value a side and draw."""
    obs = event_observations(spark, sf_dir).withColumn("sample_id", F.col("value")).where("value is not null")
    per = resample.sampled_effect(obs, "click", "view", 50).groupBy("feature_id").agg(F.avg("effect").alias("mean"), F.stddev_samp("effect").alias("sd"))
    return per.select("feature_id", *[(F.round(F.col(c) + 1e-9, 6) + 0.0).alias(c) for c in ("mean", "sd")])


@query(f"""WITH {_DIMS}, s AS (SELECT f, x, row_number() OVER (PARTITION BY f ORDER BY vec_id) - 1 AS pos FROM c),
k AS (SELECT rep, f, pos, x, {_key("rep", "pos", "1 + f * 7919")} AS key FROM s, range(3) g(rep)),
o AS (SELECT rep, f, x, row_number() OVER (PARTITION BY rep, f ORDER BY key, pos) AS place FROM k),
r AS (SELECT a.rep, corr(a.x, b.x) AS r FROM o a JOIN o b ON a.rep = b.rep AND a.place = b.place AND a.f < b.f GROUP BY a.rep, a.f, b.f)
SELECT CAST(rep AS INTEGER) AS rep, round(quantile_disc(r, 0.025), 6) AS lo, round(quantile_disc(r, 0.975), 6) AS hi FROM r GROUP BY 1""")
def null_correlation_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R7."""
    out = two_level.null_correlations(dimensions(spark, sf_dir), 3)
    return out.select(F.col("rep").cast("int").alias("rep"), F.round("q0", 6).alias("lo"), F.round("q1", 6).alias("hi"))


_KM = """e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), c0 AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS k, v AS c FROM e ORDER BY vec_id LIMIT 8),
a0 AS (SELECT vec_id, any_value(e.v) AS v, arg_min(k, (list_distance(e.v, c), k)) AS k FROM e, c0 GROUP BY vec_id),
d AS (SELECT k, unnest(range(64)) AS i, unnest(v) AS x FROM a0), m AS (SELECT k, i, avg(x) AS x FROM d GROUP BY ALL), c1 AS (SELECT k, list(x ORDER BY i) AS c FROM m GROUP BY k),
a1 AS (SELECT vec_id, arg_min(k, (list_distance(e.v, c), k)) AS cluster, min(list_distance(e.v, c)) AS distance FROM e, c1 GROUP BY vec_id)"""


@query(f"WITH {_KM} SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, round(distance, 6) AS distance FROM a1")
def one_lloyd_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One round from the first eight vectors."""
    v = vectors(spark, sf_dir)
    return cluster.k_representatives(v, 8, n_iter=1)[0].select("vec_id", "cluster", F.round("distance", 6).alias("distance"))


@query(f"WITH {_KM} SELECT round(avg(distance * distance), 6) AS objective FROM a1")
def clustering_objective(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A20."""
    return cluster.kmeans_objective(cluster.k_representatives(vectors(spark, sf_dir), 8, n_iter=1)[0]).select(F.round("objective", 6).alias("objective"))


@query()
def median_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C5 with Manhattan distance and medians."""
    return cluster.k_representatives(vectors(spark, sf_dir), 6, dist="manhattan", rep="median", n_iter=3)[0].groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.avg("distance").alias("distance"))


@query("""WITH e AS (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)),
c0 AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS k, v AS c FROM e ORDER BY vec_id LIMIT 8), a0 AS (SELECT vec_id, any_value(e.v) AS v, arg_min(k, (1 - list_dot_product(e.v, c), k)) AS k FROM e, c0 GROUP BY vec_id),
d AS (SELECT k, unnest(range(64)) AS i, unnest(v) AS x FROM a0), m AS (SELECT k, i, avg(x) AS x FROM d GROUP BY ALL), c1 AS (SELECT k, list(x ORDER BY i) AS c FROM m GROUP BY k),
u AS (SELECT k, list_transform(c, lambda x: x / sqrt(list_dot_product(c, c))) AS c FROM c1)
SELECT vec_id, CAST(arg_min(k, (1 - list_dot_product(v, c), k)) AS INTEGER) AS cluster, round(min(1 - list_dot_product(v, c)), 6) + 0 AS distance FROM e, u GROUP BY vec_id""")
def one_spherical_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One round by cosine from the first eight vectors."""
    v = cluster.unit_rows(vectors(spark, sf_dir))
    out = cluster.spherical_kmeans(v, 8, cluster.first_centres(v, 8, "vec_id"), n_iter=1)[0]
    return out.select("vec_id", "cluster", (F.round("distance", 6) + 0.0).alias("distance"))


@query()
def spherical_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C6."""
    return cluster.spherical_kmeans(vectors(spark, sf_dir), 8, n_iter=4, empty="redraw")[0].groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


@query()
def repeated_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C7."""
    best, mean = cluster.kmeans_repeats(vectors(spark, sf_dir), 10, [1, 2, 3], "label", 10)
    return spark.createDataFrame([(best, mean)], "best double, mean double")


@query()
def buckshot_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C8."""
    v = vectors(spark, sf_dir)
    return cluster.k_representatives(v, 8, cluster.buckshot_init(v, 8), n_iter=2)[0].select("vec_id", "cluster", F.round("distance", 6).alias("distance"))


@query()
def spectral_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C10."""
    return cluster.spectral_clusters(cluster.similarity_graph(vectors(spark, sf_dir), "rbf", 0.5, 8, recall=0.95), 6, 10)


@query(f"""WITH {_DIMS}, q AS (SELECT a.vec_id AS key, b.vec_id AS nb, list_distance(a.v, b.v) AS d FROM e a JOIN e b ON a.vec_id <> b.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY d, nb) AS k FROM q),
g AS (SELECT least(key, nb) AS i, greatest(key, nb) AS j, max(exp(-0.5 * d * d)) AS w FROM r WHERE k <= 5 GROUP BY ALL), b AS (SELECT i, j, w FROM g UNION ALL SELECT j, i, w FROM g), s AS (SELECT i, sum(w) AS d FROM b GROUP BY i)
SELECT b.i, b.j, round(-w / sqrt(x.d * y.d), 5) AS value FROM b JOIN s x ON x.i = b.i JOIN s y ON y.i = b.j UNION ALL SELECT i, i, 1.0 FROM s""")
def graph_laplacian(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C10's normalised Laplacian."""
    return cluster.laplacian(cluster.similarity_graph(vectors(spark, sf_dir), "rbf", 0.5, 5)).withColumn("value", F.round("value", 5))


@query(f"""WITH {_DIMS} SELECT a.label = b.label AS within, CAST(least(floor(list_distance(a.v, b.v) / 2 * 20), 19) AS INTEGER) AS bin, count(*) AS n FROM e a JOIN e b ON a.vec_id < b.vec_id GROUP BY ALL""")
def class_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A21."""
    return cluster.class_distances(vectors(spark, sf_dir), "label", 20, 2.0)


@query()
def noisy_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row's quantised place, after a further round, with neighbours from the two-level index."""
    out = cluster.noisy_vq(vectors(spark, sf_dir), 5, 0.1, 1, recall=0.95)
    return out.select("vec_id", *[F.round(F.col("v")[i], 6).alias(f"v{i}") for i in range(64)])


@query(f"WITH {_KM}, n AS (SELECT cluster, label, count(*) AS n FROM a1 JOIN embeddings USING (vec_id) GROUP BY ALL) SELECT CAST(cluster AS INTEGER) AS cluster, arg_min(label, (-n, label)) AS label FROM n GROUP BY 1")
def cell_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The majority label of each cell."""
    v = vectors(spark, sf_dir)
    return cluster.quantised_labels(v, cluster.k_representatives(v, 8, n_iter=1)[0], "label")


@query()
def spectral_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes in the leading eigenvectors."""
    places, _ = cluster.spectral_embedding(cluster.similarity_graph(vectors(spark, sf_dir), "rbf", 0.5, 8), 4, 12)
    return places.select("id", *[F.col("v")[i].alias(f"e{i}") for i in range(4)])


@query()
def principal_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L1."""
    return factor.pca(vectors(spark, sf_dir), F.col("v"), 3)[0].select("vec_id", *[F.round(F.col("scores")[i], 6).alias(f"pc{i + 1}") for i in range(3)])


@query(f"""WITH {_DIMS}, m AS (SELECT f, avg(x) AS m FROM c GROUP BY f), z AS (SELECT sum((x - m) * (x - m)) / ((SELECT count(*) FROM e) - 1) AS total FROM c JOIN m USING (f)) SELECT round(total, 6) AS total_variance FROM z""")
def total_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L1's invariant: the eigenvalues' sum."""
    _, values, _ = factor.pca(vectors(spark, sf_dir), F.col("v"), 64)
    return spark.createDataFrame([(round(float(values.sum()), 6),)], "total_variance double")


@query()
def probabilistic_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L2."""
    return factor.ppca(vectors(spark, sf_dir), F.col("v"), 3)[0].select("vec_id", *[F.col("latent")[i].alias(f"z{i + 1}") for i in range(3)])


@query()
def discriminant_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L9."""
    return factor.lda(vectors(spark, sf_dir), F.col("v"), "label", 1e-3, 2)[0].select("vec_id", "label", "predicted")


_MOMENTS = f"""{_DIMS}, m AS (SELECT f, avg(x) AS m FROM c GROUP BY f), z AS (SELECT vec_id, f, x - m AS z FROM c JOIN m USING (f)), n AS (SELECT count(*) AS n FROM e),
s AS (SELECT a.f AS i, b.f AS j, sum(a.z * b.z) / (SELECT n FROM n) AS s FROM z a JOIN z b USING (vec_id) GROUP BY ALL)"""


@query(f"""WITH {_MOMENTS}, t AS (SELECT sum(s) FILTER (i = j) AS trace, sum(s * s) AS square FROM s), q AS (SELECT avg(w * w) AS fourth FROM (SELECT vec_id, sum(z * z) AS w FROM z GROUP BY 1)),
d AS (SELECT trace, square, fourth, (square - trace * trace / 64) / 64 AS d2, n FROM t, q, n) SELECT round(trace, 6) AS trace, round(least((fourth - square) / n / 64, d2) / d2, 8) AS shrinkage FROM d""")
def shrunk_covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L10."""
    s, shrink = factor.ledoit_wolf(vectors(spark, sf_dir), F.col("v"))
    return spark.createDataFrame([(round(float(np.trace(s)), 6), round(shrink, 8))], "trace double, shrinkage double")


@query(f"""WITH {_MOMENTS}, u AS (SELECT i, j, s * n / (n - 1) AS s FROM s, n), p AS (SELECT a.i, b.j, sum(a.s * b.s) AS s FROM u a JOIN u b ON a.j = b.i GROUP BY ALL)
SELECT 1 AS power, round(sum(s), 6) AS total FROM u WHERE i = j UNION ALL SELECT 2, round(sum(s), 8) FROM p WHERE i = j UNION ALL SELECT 3, round(sum(p.s * u.s), 8) FROM p JOIN u ON p.j = u.i AND p.i = u.j""")
def component_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L1: sums of the eigenvalues and of their squares and cubes."""
    _, values, _ = factor.pca(vectors(spark, sf_dir), F.col("v"), 64)
    return spark.createDataFrame([(k, round(float((values**k).sum()), 6 if k == 1 else 8)) for k in (1, 2, 3)], "power int, total double")


@query(f"""WITH {_DIMS}, q AS (SELECT a.f AS i, b.f AS j, sum(a.x * b.x) AS s FROM c a JOIN c b USING (vec_id) GROUP BY ALL)
SELECT 2 AS power, round(sum(s) FILTER (i = j), 5) AS total FROM q UNION ALL SELECT 4, round(sum(s * s), 3) FROM q""")
def latent_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of the squares and fourth powers of all singular values."""
    comps = factor.lsi(vectors(spark, sf_dir), F.col("v"), [f"d{i}" for i in range(64)], 64).select("component", "singular").distinct()
    total = lambda k, d: comps.agg(F.round(F.sum(F.pow("singular", F.lit(float(k)))), d).alias("total")).select(F.lit(k).alias("power"), "total")
    return total(2, 5).union(total(4, 3))


@query()
def bootstrap_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L1 in Poisson bootstrap replicates."""
    got = factor.bootstrap_pca(vectors(spark, sf_dir), F.col("v"), 3, 5, "vec_id")
    return spark.createDataFrame([(r, k, float(v)) for r, (values, _) in enumerate(got) for k, v in enumerate(values)], "rep int, component int, variance double")


@query()
def least_squares_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partial least squares of the labels' indicators."""
    v = vectors(spark, sf_dir)
    w = factor.pls(v, F.col("v"), F.array(*[(F.col("label") == i).cast("double") for i in range(3)]), 2)
    return spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(w)], "dimension int, w1 double, w2 double")


@query()
def latent_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top dimensions of the leading latents."""
    comps = factor.lsi(vectors(spark, sf_dir), F.col("v"), [f"d{i}" for i in range(64)], 3)
    return factor.top_latents(comps, 5)


@query()
def nonnegative_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order priorities by customer, from keyed numbers."""
    path = factor.nmf(_priority_cells(spark, sf_dir), 2, 3)[2]
    return spark.createDataFrame(list(enumerate(path)), "round long, error double")


def _priority_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order totals by customer and priority; a priority is its first figure, its place in the list."""
    place = F.substring("o_orderpriority", 1, 1).cast("long")
    return read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("i"), place.alias("j")).agg(F.sum("o_totalprice").cast("double").alias("value"))


@query("""WITH x AS (SELECT o_custkey AS i, CAST(o_orderpriority[1] AS BIGINT) AS j, CAST(sum(o_totalprice) AS DOUBLE) AS v FROM orders GROUP BY ALL),
p AS (SELECT a.j AS a, b.j AS b, sum(a.v * b.v) AS g FROM x a JOIN x b ON a.i = b.i GROUP BY ALL)
SELECT round(sum(g) FILTER (a = b) / 1e12, 4) AS trace, round(sum(g * g) / 1e24, 4) AS square FROM p""")
def singular_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two invariants of all singular values of the customers' priorities by block iteration: their squares' and fourth powers' sums."""
    values = factor.sparse_svd(_priority_cells(spark, sf_dir), 5)[2]
    return spark.createDataFrame([(round(float((values**2).sum()) / 1e12, 4), round(float((values**4).sum()) / 1e24, 4))], "trace double, square double")


@query()
def factor_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The non-negative start from singular pairs and the factors it leads to, until the error stays."""
    cells = _priority_cells(spark, sf_dir)
    _, h, path = factor.nmf(cells, 3, 6, init="nndsvd", tol=1.0)
    return h.withColumn("rounds", F.lit(len(path)))


@query()
def held_out_factorization(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L5, L6."""
    cells = read(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").cast("int").alias("i"), F.col("l_suppkey").cast("int").alias("j")).agg(F.avg("l_quantity").cast("float").alias("value"))
    return factor.cv_factorization(cells, 3)


_X = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"), F.ln("l_extendedprice").alias("y"), *[F.col(c).cast("double").alias(c) for c in _X]
    )


@query()
def elastic_net_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E1."""
    return regress.elastic_net_path(_lines(spark, sf_dir), _X, "y", [0.0, 0.5, 1.0], [0.0, 0.01, 0.1])


@query("""SELECT 'l_quantity' AS variable, round(regr_slope(ln(l_extendedprice), l_quantity), 8) AS beta FROM lineitem UNION ALL SELECT '(intercept)', round(regr_intercept(ln(l_extendedprice), l_quantity), 8) FROM lineitem""")
def least_squares_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E1 with one predictor and no penalty."""
    return regress.elastic_net_path(_lines(spark, sf_dir), ["l_quantity"], "y", [1.0], [0.0]).select("variable", F.round("beta", 8).alias("beta"))


_LINE = "t AS (SELECT l_orderkey * 10 + l_linenumber AS row_id, CAST(l_quantity AS DOUBLE) AS x, ln(l_extendedprice) AS y FROM lineitem)"
_LINE_FIT = "sign(c) * greatest(abs(c) - lam * alpha, 0) / (1 + lam * (1 - alpha)) / sx"


@query(f"""WITH {_LINE}, g AS (SELECT alpha, lam FROM (VALUES (0.0), (0.5), (1.0)) a(alpha), (VALUES (0.0), (0.01), (0.1)) b(lam)), m AS (SELECT avg(x) AS mx, avg(y) AS my, stddev_pop(x) AS sx, covar_pop(x, y) / stddev_pop(x) AS c FROM t),
f AS (SELECT alpha, lam, mx, my, {_LINE_FIT} AS b FROM m, g)
SELECT CAST(alpha AS DOUBLE) AS alpha, CAST(lam AS DOUBLE) AS lam, 'l_quantity' AS variable, round(b, 7) AS beta FROM f UNION ALL SELECT alpha, lam, '(intercept)', round(my - b * mx, 7) FROM f""")
def penalised_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E1 with one predictor over a grid of penalties."""
    return regress.elastic_net_path(_lines(spark, sf_dir), ["l_quantity"], "y", [0.0, 0.5, 1.0], [0.0, 0.01, 0.1]).withColumn("beta", F.round("beta", 7))


@query(f"""WITH {_LINE}, g AS (SELECT alpha, lam FROM (VALUES (0.5), (1.0)) a(alpha), (VALUES (0.0), (0.05), (0.3)) b(lam)), d AS (SELECT *, row_id % 5 AS fold FROM t),
m AS (SELECT k AS fold, avg(x) AS mx, avg(y) AS my, stddev_pop(x) AS sx, covar_pop(x, y) / stddev_pop(x) AS c FROM d, range(5) r(k) WHERE fold <> k GROUP BY k),
f AS (SELECT fold, alpha, lam, mx, my, {_LINE_FIT} AS b FROM m, g), e AS (SELECT fold, alpha, lam, avg(pow(y - my - b * (x - mx), 2)) AS mse FROM d JOIN f USING (fold) GROUP BY ALL),
s AS (SELECT alpha, lam, avg(mse) AS mse, stddev_samp(mse) / sqrt(5) AS se FROM e GROUP BY ALL), b AS (SELECT alpha, min(mse) AS mse, arg_min(lam, (mse, -lam)) AS lam, arg_min(se, (mse, -lam)) AS se FROM s GROUP BY alpha)
SELECT CAST(b.alpha AS DOUBLE) AS alpha, CAST(b.lam AS DOUBLE) AS lambda_min, CAST((SELECT max(s.lam) FROM s WHERE s.alpha = b.alpha AND s.mse <= b.mse + b.se) AS DOUBLE) AS lambda_1se, round(b.mse, 7) AS mse, round(b.se, 7) AS se FROM b""")
def cross_validated_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E2 with one predictor and arithmetic folds."""
    lines = _lines(spark, sf_dir)
    out = regress.cv_lambda(lines, ["l_quantity"], "y", [0.5, 1.0], 5, lambdas=[0.3, 0.05, 0.0], fold=F.col("row_id") % 5)
    return out.select("alpha", "lambda_min", "lambda_1se", F.round("mse", 7).alias("mse"), F.round("se", 7).alias("se"))


@query(f"""WITH {_LINE}, m AS (SELECT count(*) AS n, avg(x) AS mx, avg(y) AS my, regr_slope(y, x) AS b, var_pop(x) * count(*) AS sxx FROM t),
e AS (SELECT (y - my - b * (x - mx)) / (1 - 1.0 / n - (x - mx) * (x - mx) / sxx) AS e FROM t, m), q AS (SELECT avg(e) AS mean, stddev_samp(e) AS sd, stddev_pop(e) AS sp, avg(e * e) AS mse FROM e)
SELECT round(any_value(mean), 8) + 0 AS mean, round(any_value(sd), 7) AS sd, round(avg(pow((e - mean) / sp, 3)), 6) AS skewness, round(any_value(mse), 7) AS mse FROM e, q""")
def leave_one_out_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E5 with one predictor and no penalty, where the errors have a closed form."""
    out = regress.loo_summary(regress.loo(_lines(spark, sf_dir), ["l_quantity"], "y", 1.0, 0.0, "row_id"))
    return out.select((F.round("mean", 8) + 0.0).alias("mean"), F.round("sd", 7).alias("sd"), F.round("skewness", 6).alias("skewness"), F.round("mse", 7).alias("mse"))


@query(f"""WITH {_LINE}, q AS (SELECT 1 / (0.1 + sum(x * x) / 4) AS v, sum(x * y) / 4 AS c FROM t) SELECT 'l_quantity' AS variable, round(v * c, 8) AS mean, round(sqrt(v), 10) AS sd FROM q""")
def line_posterior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A30 with one weight."""
    mean, cov = bayes.bayes_linreg(_lines(spark, sf_dir), ["l_quantity"], "y", np.zeros(1), np.eye(1) * 10, 4.0)
    return spark.createDataFrame([("l_quantity", round(float(mean[0]), 8), round(float(np.sqrt(cov[0, 0])), 10))], "variable string, mean double, sd double")


@query()
def cross_validated_lambda(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E2."""
    return regress.cv_lambda(_lines(spark, sf_dir), _X, "y", [0.5, 1.0], 5)


@query("""WITH s AS (SELECT stddev_samp(l_quantity) AS sx, stddev_samp(ln(l_extendedprice)) AS sy, regr_slope(ln(l_extendedprice), l_quantity) AS b FROM lineitem)
SELECT 'l_quantity' AS variable, round(pow(b * sx / sy, 2), 8) AS importance FROM s""")
def normalized_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E3."""
    lines = _lines(spark, sf_dir)
    coefs = regress.elastic_net_path(lines, ["l_quantity"], "y", [1.0], [0.0])  # all: a predictor's importance isn't small because its unit is
    return regress.sigma_normalized(lines, coefs, ["l_quantity"], "y").select("variable", F.round("importance", 8).alias("importance"))


@query("SELECT l_orderkey * 10 + l_linenumber AS row_id, round(0.5 * l_quantity - 2 * l_tax + 1, 6) AS prediction FROM lineitem")
def sparse_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E4."""
    kept = {"l_quantity": 0.5, "l_tax": -2.0}
    return regress.sparse_predict(regress.sparsify_input(_lines(spark, sf_dir), kept, ("row_id",)), kept, 1.0).select("row_id", F.round("prediction", 6).alias("prediction"))


@query()
def stability_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E6 and E7's entropy."""
    probs = regress.stability_selection(_lines(spark, sf_dir), _X, "y", [0.001, 0.01, 0.1], 0.5, 6)
    return probs.join(regress.selection_entropy(probs), "lam")


@query()
def coefficient_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E8, A17."""
    return regress.coef_ranges(regress.coef_bootstrap(_lines(spark, sf_dir), _X, "y", "residual", 8))


@query()
def leave_one_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E5 over the suppliers' mean prices (one row per supplier)."""
    rows = read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("row_id")).agg(F.avg("l_extendedprice").alias("y"), F.avg("l_quantity").alias("q"), F.avg("l_discount").alias("d"))
    return regress.loo_summary(regress.loo(rows, ["q", "d"], "y", 1.0, 10.0, "row_id"))


@query("""SELECT model, count(*) AS n, round(count(*) / (SELECT count(*) FROM orders), 8) AS share FROM (SELECT CASE WHEN o_totalprice > 100000 THEN '1' ELSE '0' END || CASE WHEN o_custkey % 2 = 0 THEN '1' ELSE '0' END AS model FROM orders) GROUP BY 1""")
def model_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E7."""
    bits = F.concat(F.when(F.col("o_totalprice") > 100000, "1").otherwise("0"), F.when(F.col("o_custkey") % 2 == 0, "1").otherwise("0"))
    return regress.model_frequencies(read(spark, sf_dir, "orders").select(bits.alias("model"))).withColumn("share", F.round("share", 8))


@query()
def sobol_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bilinear model over the marginal quantiles of three columns."""
    cols = ["l_quantity", "l_discount", "l_tax"]
    a = sensitivity.quantile_sample(_lines(spark, sf_dir), cols, 4000, "latin", 1)
    b = sensitivity.quantile_sample(_lines(spark, sf_dir), cols, 4000, "random", 2)
    return sensitivity.sobol_indices(a, b, cols, lambda x: x[0] + 100 * x[1] * x[2])


_TWO_LINES = """l AS (SELECT l_linenumber AS k, l_orderkey AS row_id, CAST(l_quantity AS DOUBLE) AS q, CAST(l_discount AS DOUBLE) AS d, CAST(l_tax AS DOUBLE) AS t FROM lineitem),
j AS (SELECT a.q AS aq, a.d AS ad, {tax} AS az, b.q AS bq, b.d AS bd, {other} AS bz FROM l a JOIN l b ON a.row_id = b.row_id AND a.k = 1 AND b.k = 2),
m AS (SELECT aq + 100 * ad * az AS ya, bq + 100 * bd * bz AS yb, unnest([{{'factor': 'l_quantity', 'ym': bq + 100 * ad * az}}, {{'factor': 'l_discount', 'ym': aq + 100 * bd * az}}, {{'factor': 'l_tax', 'ym': aq + 100 * ad * bz}}]) AS u FROM j),
s AS (SELECT u.factor AS factor, (var_pop(ya) + var_pop(yb)) / 2 + pow(avg(ya) - avg(yb), 2) / 4 AS v, avg(yb * (u.ym - ya)) AS v1, avg(pow(ya - u.ym, 2)) / 2 AS vt FROM m GROUP BY 1)
SELECT factor, round(v1 / v, 6) + 0 AS s1, round(vt / v, 6) + 0 AS st FROM s"""


def _two_lines(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    line = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("row_id"), "l_linenumber", *[F.col(c).cast("double").alias(c) for c in ("l_quantity", "l_discount", "l_tax")])
    return line.where("l_linenumber = 1"), line.where("l_linenumber = 2")


def _rounded_indices(out: DataFrame) -> DataFrame:
    return out.select("factor", *[(F.round(c, 6) + 0.0).alias(c) for c in ("s1", "st")])


@query(f"WITH {_TWO_LINES.format(tax='a.t', other='b.t')}")
def sobol_indices_of_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E10 with the first two lines of every order as the two samples."""
    a, b = _two_lines(spark, sf_dir)
    return _rounded_indices(sensitivity.sobol_indices(a, b, ["l_quantity", "l_discount", "l_tax"], lambda x: x[0] + 100 * x[1] * x[2]))


@query(f"WITH {_TWO_LINES.format(tax='0.04', other='0.04')}")
def fixed_factor_of_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tax set to a value before E10."""
    a, b = (sensitivity.fix_factor(x, "l_tax", 0.04) for x in _two_lines(spark, sf_dir))
    return _rounded_indices(sensitivity.sobol_indices(a, b, ["l_quantity", "l_discount", "l_tax"], lambda x: x[0] + 100 * x[1] * x[2]))


_STEPS = "[" + ", ".join(str(i / 100) for i in range(101)) + "]"
_QUANTILES = f"k AS (SELECT quantile_cont(CAST(l_quantity AS DOUBLE), {_STEPS}) AS q, quantile_cont(CAST(l_discount AS DOUBLE), {_STEPS}) AS d, quantile_cont(CAST(l_tax AS DOUBLE), {_STEPS}) AS t FROM lineitem)"


def _quantile_sql(share: str, table: str) -> str:
    at = f"least(floor(({share}) * 100), 99)"
    low, high = (f"{table}[CAST({at} AS BIGINT) + {i}]" for i in (1, 2))
    return f"({low} + (({share}) * 100 - {at}) * ({high} - {low}))"


_SHARES = (0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0)


@query(f"""WITH l AS (SELECT unnest([{{'name': 'l_quantity', 'x': l_quantity}}, {{'name': 'l_extendedprice', 'x': l_extendedprice}}, {{'name': 'l_discount', 'x': l_discount}}, {{'name': 'l_tax', 'x': l_tax}}], recursive := true) FROM lineitem),
q AS (SELECT name, quantile_cont(x, {list(_SHARES)}) AS v FROM l GROUP BY name) SELECT name, unnest({list(_SHARES)})::DOUBLE AS share, round(unnest(v), 6) AS value FROM q""")
def column_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E9's marginal quantiles of four columns at once."""
    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    got = selection.quantiles(read(spark, sf_dir, "lineitem"), cols, list(_SHARES))
    rows = [(c, p, v) for c in cols for p, v in zip(_SHARES, got[c], strict=True)]
    return spark.createDataFrame(rows, "name string, share double, value double").withColumn("value", F.round("value", 6))


@query(f"""WITH {_QUANTILES}, r AS (SELECT range AS i FROM range(250)) SELECT i AS row_id, round({_quantile_sql("(i + 0.5) / 250", "q")}, 6) + 0 AS l_quantity,
  round({_quantile_sql("(i + 0.5) / 250", "d")}, 6) + 0 AS l_discount, round({_quantile_sql("(i + 0.5) / 250", "t")}, 6) + 0 AS l_tax FROM r, k""")
def quantile_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A walk along the marginal quantiles."""
    cols = ["l_quantity", "l_discount", "l_tax"]
    out = sensitivity.quantile_sample(_lines(spark, sf_dir), cols, 250, "grid")
    return out.select("row_id", *[(F.round(c, 6) + 0.0).alias(c) for c in cols])


@query()
def replicate_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E11."""
    cols = ["l_quantity", "l_discount", "l_tax"]
    x = sensitivity.quantile_sample(_lines(spark, sf_dir), cols, 2000, "random", 1)
    return sensitivity.mara_indices(x, cols, lambda c: c[0] + 100 * c[1] * c[2])


_CURVE = ", ".join(f"{_quantile_sql(f'0.5 + asin(sin(s * {w})) / pi()', t)} AS x{t}" for w, t in ((11, "q"), (19, "d"), (27, "t")))


@query(f"""WITH {_QUANTILES}, r AS (SELECT (2 * range + 1) / 2000 * pi() - pi() AS s FROM range(2000)), x AS (SELECT s, {_CURVE} FROM r, k), y AS (SELECT s, xq + 100 * xd * xt AS y FROM x),
f AS (SELECT factor, w * h AS wave FROM (VALUES ('l_quantity', 11), ('l_discount', 19), ('l_tax', 27)) v(factor, w), range(1, 5) g(h)),
p AS (SELECT factor, wave, pow(avg(y * cos(wave * s)), 2) + pow(avg(y * sin(wave * s)), 2) AS p FROM y, f GROUP BY ALL)
SELECT factor, round(2 * sum(p) / (SELECT var_pop(y) FROM y), 6) + 0 AS s1 FROM p GROUP BY 1""")
def fourier_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E12."""
    cols = ["l_quantity", "l_discount", "l_tax"]
    x = sensitivity.quantile_sample(_lines(spark, sf_dir), cols, 2000, "curve", 1)
    out = sensitivity.fast_indices(x, cols, F.col("l_quantity") + 100 * F.col("l_discount") * F.col("l_tax"))
    return out.select("factor", (F.round("s1", 6) + 0.0).alias("s1"))


@query()
def fourier_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First-order and total indices, a search curve for every factor."""
    cols = ["l_quantity", "l_discount", "l_tax"]
    design = sensitivity.fast_design(_lines(spark, sf_dir), cols, 1001)
    return sensitivity.fast_total_indices(design, cols, F.col("l_quantity") + 100 * F.col("l_discount") * F.col("l_tax"))


@query("""SELECT o_orderpriority, o_orderstatus, round(l, 8) AS likelihood, round(p, 8) AS prior, round(l * p / sum(l * p) OVER (PARTITION BY o_orderstatus), 8) AS posterior FROM (
  SELECT o_orderpriority, o_orderstatus, n / sum(n) OVER (PARTITION BY o_orderpriority) AS l, sum(n) OVER (PARTITION BY o_orderpriority) / sum(n) OVER () AS p FROM (
    SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2))""")
def bayes_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A26."""
    out = bayes.bayes_rule(read(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus")
    return out.select("o_orderpriority", "o_orderstatus", *[F.round(c, 8).alias(c) for c in ("likelihood", "prior", "posterior")])


@query("""SELECT l_returnflag, round(sum(w * l_quantity) / sum(w), 6) AS l_quantity, round(sum(w) * sum(w) / sum(w * w), 4) AS ess FROM (SELECT *, exp(l_discount * 10 - 1) AS w FROM lineitem) GROUP BY 1""")
def importance_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A27."""
    out = bayes.importance_summary(read(spark, sf_dir, "lineitem").withColumn("lw", F.col("l_discount") * 10), "lw", ["l_quantity"], ["l_returnflag"])
    return out.select("l_returnflag", F.round("l_quantity", 6).alias("l_quantity"), F.round("ess", 4).alias("ess"))


@query("SELECT event_type, count(*) AS n, CAST(sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) AS BIGINT) AS y, round((sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) + 2.0) / (count(*) + 12), 8) AS mean FROM events GROUP BY 1")
def beta_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A23."""
    e = read(spark, sf_dir, "events").withColumn("hit", (F.col("value") > 50).cast("int"))
    return bayes.beta_posterior(e, ["event_type"], "hit", 2, 10).select("event_type", "n", "y", F.round("mean", 8).alias("mean"))


#: The regularised incomplete beta function at x by Simpson's rule.
_BETA_AT = """(x / 2000 / 3 * list_sum(list_transform(range(0, 2001), lambda i: (CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) *
  (CASE WHEN i = 0 THEN 0 ELSE exp((pa - 1) * ln(x * i / 2000) + (pb - 1) * ln(1 - x * i / 2000) + lgamma(pa + pb) - lgamma(pa) - lgamma(pb)) END))))"""


@query(f"""WITH RECURSIVE g AS (SELECT event_type, count(value) AS n, CAST(sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) AS BIGINT) AS y FROM events GROUP BY 1),
h AS (SELECT *, CAST(y + 2 AS DOUBLE) AS pa, CAST(n - y + 10 AS DOUBLE) AS pb FROM g), b(event_type, pa, pb, tail, lo, hi, k) AS (
  SELECT event_type, pa, pb, tail, CAST(0 AS DOUBLE), CAST(1 AS DOUBLE), 0 FROM h, (VALUES (0.05), (0.95)) v(tail) UNION ALL
  SELECT event_type, pa, pb, tail, CASE WHEN c < tail THEN x ELSE lo END, CASE WHEN c < tail THEN hi ELSE x END, k + 1 FROM (SELECT *, {_BETA_AT} AS c FROM (SELECT *, (lo + hi) / 2 AS x FROM b WHERE k < 35))),
q AS (SELECT event_type, max((lo + hi) / 2) FILTER (tail = 0.05) AS lo, max((lo + hi) / 2) FILTER (tail = 0.95) AS hi FROM b WHERE k = 35 GROUP BY 1), t AS (SELECT event_type, {_BETA_AT} AS below FROM (SELECT *, 0.5 AS x FROM h))
SELECT event_type, y, n, round(pa / (pa + pb), 6) AS mean, round(lo, 6) AS lo, round(hi, 6) AS hi, round(below, 6) AS below FROM h JOIN q USING (event_type) JOIN t USING (event_type)""")
def beta_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A23 with intervals and tail probability."""
    e = read(spark, sf_dir, "events").withColumn("hit", (F.col("value") > 50).cast("int"))
    return bayes.beta_posterior(e, ["event_type"], "hit", 2, 10).select("event_type", "y", "n", *[F.round(c, 6).alias(c) for c in ("mean", "lo", "hi", "below")])


@query(f"""WITH RECURSIVE g AS (SELECT event_type, count(value) AS n, avg(value) AS mean, stddev_samp(value) AS sd, CAST(count(value) - 1 AS DOUBLE) AS dof FROM events GROUP BY 1 HAVING count(value) > 1),
b(event_type, dof, lo, hi, k) AS (SELECT event_type, dof, CAST(0 AS DOUBLE), CAST(50 AS DOUBLE), 0 FROM g UNION ALL
  SELECT event_type, dof, CASE WHEN p > 0.05 THEN t ELSE lo END, CASE WHEN p > 0.05 THEN hi ELSE t END, k + 1 FROM (SELECT *, {_P_OF_T} AS p FROM (SELECT *, (lo + hi) / 2 AS t FROM b WHERE k < 50))),
q AS (SELECT event_type, (lo + hi) / 2 AS q FROM b WHERE k = 50)
SELECT event_type, n, round(mean, 5) AS mean, round(sd, 5) AS sd, round(mean - q * sd / sqrt(n), 5) AS lo, round(mean + q * sd / sqrt(n), 5) AS hi,
  round(mean - q * sd * sqrt(1 + 1 / n), 5) AS pred_lo, round(mean + q * sd * sqrt(1 + 1 / n), 5) AS pred_hi FROM g JOIN q USING (event_type)""")
def mean_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A24."""
    out = bayes.mean_posterior(read(spark, sf_dir, "events"), ["event_type"], "value")
    return out.select("event_type", "n", *[F.round(c, 5).alias(c) for c in ("mean", "sd", "lo", "hi", "pred_lo", "pred_hi")])


@query()
def odds_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Late against early halves of each priority's orders."""
    o = read(spark, sf_dir, "orders").withColumn("hit", (F.col("o_orderstatus") == "F").cast("int")).withColumn("arm", F.when(F.col("o_totalprice") > 150000, 2).otherwise(1))
    n = lambda a: F.sum((F.col("arm") == a).cast("long"))
    y = lambda a: F.sum(F.when(F.col("arm") == a, F.col("hit"))).cast("long")
    counts = o.groupBy("o_orderpriority").agg(n(1).alias("n1"), y(1).alias("y1"), n(2).alias("n2"), y(2).alias("y2"))
    return bayes.odds_ratio_posterior(counts, "o_orderpriority", draws=4000)


@query("""WITH d AS (SELECT l_suppkey % 4 AS chain, l_orderkey * 10 + l_linenumber AS it, l_returnflag AS param, l_quantity AS value FROM lineitem),
h AS (SELECT *, it * 2 > max(it) OVER (PARTITION BY param, chain) + min(it) OVER (PARTITION BY param, chain) AS half FROM d), g AS (SELECT param, chain, half, count(*) AS n, avg(value) AS m, var_samp(value) AS v FROM h GROUP BY ALL),
o AS (SELECT param, avg(n) AS n, avg(v) AS w, var_samp(m) AS b FROM g GROUP BY param) SELECT param, round(sqrt(((n - 1) / n * w + b) / w), 8) AS rhat FROM o""")
def chain_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A29."""
    d = read(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 4).alias("chain"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("iter"), F.col("l_returnflag").alias("param"), F.col("l_quantity").alias("value"))
    return bayes.rhat(d).select("param", F.round("rhat", 8).alias("rhat"))


@query()
def ranked_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A29 after normalisation by ranks."""
    d = read(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 4).alias("chain"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("iter"), F.col("l_returnflag").alias("param"), F.col("l_extendedprice").alias("value"))
    return bayes.rhat(d, rank=True).select("param", F.round("rhat", 8).alias("rhat"))


@query("SELECT round(avg(-0.5 * ln(2 * pi() * 250000000) - pow(l_extendedprice - 1500 * l_quantity, 2) / 500000000), 8) AS mlppd FROM lineitem")
def predictive_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A31."""
    return bayes.mlppd(read(spark, sf_dir, "lineitem"), F.col("l_extendedprice"), F.col("l_quantity") * 1500, F.lit(2.5e8)).select(F.round("mlppd", 8).alias("mlppd"))


@query()
def regression_posterior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A30."""
    mean, cov = bayes.bayes_linreg(_lines(spark, sf_dir), _X, "y", np.zeros(4), np.eye(4) * 10, 1.0)
    return spark.createDataFrame([(c, float(m), float(np.sqrt(v))) for c, m, v in zip(_X, mean, np.diag(cov), strict=True)], "variable string, mean double, sd double")


@query("""SELECT variable, round(quantile_cont(v, 0.05), 6) AS p05, round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.95), 6) AS p95, round(avg(v), 6) AS mean FROM (SELECT l_returnflag AS variable, l_extendedprice AS v FROM lineitem) GROUP BY 1""")
def sample_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A17."""
    c = read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("variable"), F.col("l_extendedprice").alias("beta"))
    return regress.coef_ranges(c).select("variable", *[F.round(x, 6).alias(x) for x in ("p05", "p50", "p95", "mean")])


@query("""WITH r AS (SELECT l_returnflag AS method, l_suppkey AS rep, count(*) FILTER (l_tax > 0.06) AS fn, count(*) FILTER (l_discount > 0.09) AS fp, count(*) FILTER (l_discount > 0.06) AS rejections, count(*) FILTER (l_tax > 0.03) AS n_effects, count(*) AS n_tests FROM lineitem GROUP BY ALL)
SELECT method, round(avg(coalesce((n_effects - fn) / nullif(n_effects, 0), 0)), 8) AS sensitivity, round(avg(coalesce((n_tests - n_effects - fp) / nullif(n_tests - n_effects, 0), 0)), 8) AS specificity,
  round(avg(coalesce(fp / nullif(rejections, 0), 0)), 8) AS fdr, round(avg(CASE WHEN fp > 0 THEN 1.0 ELSE 0 END), 8) AS fwer, round(avg(rejections / n_tests), 8) AS rejection_ratio FROM r GROUP BY 1""")
def experiment_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as replicates, stacked from two halves."""
    n = lambda c: F.sum((c).cast("long"))
    line = read(spark, sf_dir, "lineitem")
    runs = [
        line.where(part).groupBy(F.col("l_returnflag").alias("method"), F.col("l_suppkey").alias("rep")).agg(
            n(F.col("l_tax") > 0.06).alias("fn"), n(F.col("l_discount") > 0.09).alias("fp"), n(F.col("l_discount") > 0.06).alias("rejections"), n(F.col("l_tax") > 0.03).alias("n_effects"), F.count(F.lit(1)).alias("n_tests")
        )
        for part in ("l_returnflag = 'A'", "l_returnflag <> 'A'")
    ]
    out = stats.experiment_measures(stats.combine_results(*runs))
    return out.select("method", *[F.round(c, 8).alias(c) for c in ("sensitivity", "specificity", "fdr", "fwer", "rejection_ratio")])


@query("""WITH q AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), d AS (
  SELECT a.vec_id, a.label AS own, b.label, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.e, b.e), b.vec_id) AS r FROM q a JOIN q b ON b.vec_id % 2 = 1 AND a.vec_id % 2 = 0),
v AS (SELECT vec_id, own, label, count(*) AS n FROM d WHERE r <= 7 GROUP BY ALL), b AS (SELECT vec_id, any_value(own) AS label, arg_min(label, (-n, label)) AS predicted FROM v GROUP BY vec_id)
SELECT coalesce(label, -1) AS label, round(avg(CASE WHEN label = predicted THEN 1.0 ELSE 0 END), 8) AS accuracy, count(*) AS n FROM b GROUP BY ROLLUP (label)""")
def vote_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A18."""
    e = read(spark, sf_dir, "embeddings")
    got = joins.knn_classify(e.where("vec_id % 2 = 1"), e.where("vec_id % 2 = 0"), 7).join(e.select("vec_id", "label"), "vec_id")
    return stats.accuracy(got).select(F.coalesce("label", F.lit(-1)).alias("label"), F.round("accuracy", 8).alias("accuracy"), "n")


@query("""SELECT l_orderkey, l_linenumber, round((l_quantity - m) / s, 6) + 0 AS l_quantity, round((l_tax - mt) / st, 6) + 0 AS l_tax FROM lineitem, (SELECT avg(l_quantity) AS m, stddev_samp(l_quantity) AS s, avg(l_tax) AS mt, stddev_samp(l_tax) AS st FROM lineitem)""")
def standardized_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F20."""
    out = clean.standardize(read(spark, sf_dir, "lineitem"), ["l_quantity", "l_tax"])[0]
    return out.select("l_orderkey", "l_linenumber", *[(F.round(c, 6) + 0.0).alias(c) for c in ("l_quantity", "l_tax")])


@query("SELECT l_orderkey, l_linenumber, round(lo + l_discount * (hi - lo), 6) AS l_discount FROM lineitem, (SELECT min(l_tax) AS lo, max(l_tax) AS hi FROM lineitem)")
def rescaled_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """discounts (in the unit interval) to the taxes' range."""
    line = read(spark, sf_dir, "lineitem")
    out = clean.scale_to_ranges(line, line.select(F.col("l_tax").alias("l_discount")), ["l_discount"])
    return out.select("l_orderkey", "l_linenumber", F.round("l_discount", 6).alias("l_discount"))


@query("""SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem""")
def dense_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a column of zeros is dropped."""
    line = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", (F.col("l_tax") * 0).alias("nothing"))
    return clean.remove_sparse_columns(line, 0.99, ("l_orderkey", "l_linenumber"))


@query("""SELECT p_partkey, p_brand AS source, p_partkey % 7 AS sample, CAST(p_retailprice AS VARCHAR) || '@' || CAST(p_size AS VARCHAR) AS masstime FROM part WHERE abs(p_size - 25) <= 20""")
def named_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """drop far rows, parse a name, make and split the two-part key."""
    p = clean.drop_high_delta(read(spark, sf_dir, "part").withColumn("delta", F.col("p_size") - 25), 20)
    name = F.concat(F.lit("run_a_"), (F.col("p_partkey") % 7).cast("string"), F.lit(".raw.txt"))
    key = clean.masstime(F.col("p_retailprice").cast("string"), F.col("p_size").cast("string"))
    back = clean.split_masstime(F.col("masstime"))
    out = p.select("p_partkey", F.col("p_brand").alias("source"), clean.sample_id(name).cast("long").alias("sample"), key.alias("masstime"), "p_size")
    return out.where(back["rtime"] == F.col("p_size")).drop("p_size")


@query("""SELECT l_suppkey AS feature_id, 's_' || l_returnflag AS sample_id, round(sum(l_quantity), 6) AS value, CASE l_returnflag WHEN 'A' THEN 'x' ELSE 'y' END AS grp FROM lineitem GROUP BY l_suppkey, l_returnflag""")
def melted_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IO2, F7: a wide supplier matrix to long observations with groups."""
    flags = ["A", "N", "R"]
    wide = read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("feature_id")).pivot("l_returnflag", flags).agg(F.sum("l_quantity"))
    wide = wide.select("feature_id", *[F.col(f).alias(f"s_{f}") for f in flags])
    samples = spark.createDataFrame([("s_A", "x"), ("s_N", "y"), ("s_R", "y")], "sample_id string, grp string")
    out = clean.melt_matrix(wide, samples, [f"s_{f}" for f in flags], keys=["feature_id"])
    return out.where("value is not null").select("feature_id", "sample_id", F.round("value", 6).alias("value"), "grp")


@query()
def stemmed_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N2, N3."""
    t = text.tokenize(read(spark, sf_dir, "documents"), text.TokenOptions((), 2))
    return text.word_freqs(text.stem_tokens(t), 50)


@query()
def cluster_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N7 by language."""
    weights = text.tfidf(_counts(spark, sf_dir))
    labels = read(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("cluster"))
    return text.cluster_topics(weights, labels, 5, 6)


@query()
def null_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R8 with A15's averages."""
    obs = event_observations(spark, sf_dir).withColumn("sample_id", F.col("value"))
    results, _ = calibrate.null_calibration(obs, _event_pairs(spark), 10, lambda o: clean.variance_filter(o, 1.0), ("uncorrected", "bonferroni", "fdr_bh"), 30)
    return stats.experiment_measures(results)


@query()
def spike_in_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fifth of the users get a shift in one group."""
    obs = event_observations(spark, sf_dir).withColumn("sample_id", F.col("value"))
    shifts = obs.where("feature_id % 5 = 0 and grp = 'click'").select("feature_id", "grp", F.lit(60.0).alias("shift")).distinct()
    return stats.experiment_measures(calibrate.spike_in_calibration(obs, _event_pairs(spark), shifts, 10, ("bonferroni", "fdr_bh", "bky_2step")))


@query("""WITH a AS (SELECT o_orderkey AS position, CAST(o_custkey AS VARCHAR) || '_' || CAST(o_orderkey AS VARCHAR) AS sample_id FROM orders WHERE o_orderstatus = 'F')
SELECT sample_id, position, CAST(row_number() OVER (ORDER BY position) AS INTEGER) AS place FROM a""")
def aligned_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """finished orders' columns against all columns."""
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("position"), F.concat_ws("_", F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string")).alias("sample_id"), "o_orderstatus")
    return clean.align_samples(o.where("o_orderstatus = 'F'"), o)


@query("""WITH t AS (SELECT l_orderkey * 10 + l_linenumber AS row_id, ln(l_extendedprice) AS y, l_quantity AS q FROM lineitem), m AS (SELECT avg(y) AS my, stddev_samp(y) AS sy, avg(q) AS mq, stddev_samp(q) AS sq FROM t)
SELECT round((y - my) / sy, 6) + 0 AS l_extendedprice, round((q - mq) / sq, 6) + 0 AS l_quantity FROM t, m""")
def regression_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F22."""
    out = clean.prepare_regression(read(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice", "l_quantity"), "l_extendedprice", ["l_orderkey"])
    return out.select(*[(F.round(c, 6) + 0.0).alias(c) for c in ("l_extendedprice", "l_quantity")])


@query()
def randomized_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """how many values changed, per flag."""
    line = read(spark, sf_dir, "lineitem").withColumn("id", F.col("l_orderkey") * 10 + F.col("l_linenumber")).withColumn("was", F.col("l_extendedprice"))
    out = clean.randomize_column(line, "l_extendedprice", 0.2, "id")
    return out.groupBy("l_returnflag").agg(F.avg((F.col("was") != F.col("l_extendedprice")).cast("double")).alias("changed"))


@query("""WITH o AS (SELECT l_partkey AS feature_id, l_returnflag AS grp, log2(l_extendedprice) AS value, l_orderkey * 10 + l_linenumber AS id FROM lineitem WHERE l_returnflag IN ('A', 'R')),
h AS (SELECT feature_id FROM o GROUP BY 1 HAVING avg(value) > 15), m AS (SELECT *, avg(value) FILTER (grp = 'A') OVER (PARTITION BY feature_id) AS ma, avg(value) FILTER (grp = 'R') OVER (PARTITION BY feature_id) AS mr FROM o)
SELECT id, round(CASE WHEN feature_id IN (SELECT feature_id FROM h) THEN value - CASE grp WHEN 'A' THEN ma ELSE mr END + least(CASE grp WHEN 'A' THEN ma ELSE mr END, ma, mr) ELSE value END, 6) AS value FROM m""")
def pair_effects_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F26."""
    obs = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("feature_id"), F.col("l_returnflag").alias("grp"), F.log2("l_extendedprice").alias("value"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"))
    tests = obs.where("grp in ('A', 'R')").groupBy("feature_id").agg((F.avg("value") > 15).alias("reject"))
    return clean.remove_pair_effects(obs, tests, "A", "R").select("id", F.round("value", 6).alias("value"))


@query("""SELECT l_partkey AS feature_id, round(avg(log2(l_extendedprice)) FILTER (l_returnflag = 'A') - avg(log2(l_extendedprice)) FILTER (l_returnflag = 'R'), 6) + 0 AS effect
FROM lineitem GROUP BY 1 HAVING count(*) FILTER (l_returnflag = 'A') > 0 AND count(*) FILTER (l_returnflag = 'R') > 0""")
def contrast_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A8."""
    obs = read(spark, sf_dir, "lineitem").where("l_returnflag in ('A', 'R')").select(F.col("l_partkey").alias("feature_id"), F.col("l_returnflag").alias("grp"), F.log2("l_extendedprice").alias("value"))
    per = stats.describe_groups(obs)
    both = per.groupBy("feature_id").count().where("count = 2").select("feature_id")
    weights = spark.createDataFrame([("A-R", "A", 1.0), ("A-R", "R", -1.0)], "contrast string, grp string, weight double")
    return stats.group_contrasts(clean.get_features(per, both), weights).select("feature_id", (F.round("effect", 6) + 0.0).alias("effect"))


@query()
def games_howell(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A7 over event types, users together."""
    per = stats.describe_groups(event_observations(spark, sf_dir).withColumn("feature_id", F.lit(0)))
    groups = per.select("grp").distinct()
    return stats.games_howell(stats.pairwise_contrasts(per, stats.contrast_table(groups)), 5).select("contrast", "diff", "se", "t", "dof", "p")


@query()
def robust_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L4."""
    beta = factor.irls(read(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount"], "l_extendedprice", 1.0, 5)
    return spark.createDataFrame([(c, float(b)) for c, b in zip(["l_quantity", "l_discount"], beta, strict=True)], "variable string, beta double")


@query("""WITH m AS (SELECT var_pop(l_quantity) AS a, covar_pop(l_quantity, l_discount) AS b, var_pop(l_discount) AS c, covar_pop(l_quantity, l_extendedprice) AS u, covar_pop(l_discount, l_extendedprice) AS v FROM lineitem)
SELECT 'l_quantity' AS variable, round((c * u - b * v) / (a * c - b * b), 5) AS beta FROM m UNION ALL SELECT 'l_discount', round((a * v - b * u) / (a * c - b * b), 3) FROM m""")
def unweighted_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L4 at p = 2, where all weights are 1."""
    beta = factor.irls(read(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount"], "l_extendedprice", 2.0, 3)
    return spark.createDataFrame([("l_quantity", round(float(beta[0]), 5)), ("l_discount", round(float(beta[1]), 3))], "variable string, beta double")


@query()
def sparse_loadings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L3."""
    b = factor.sparse_pca(vectors(spark, sf_dir), F.col("v"), 2, 0.01, rounds=20)
    return spark.createDataFrame([(i, float(r[0]), float(r[1])) for i, r in enumerate(b)], "dimension int, c1 double, c2 double")


@query()
def resampled_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A28 (the sample's size is the feature)."""
    line = read(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (F.col("l_discount") * 20).alias("lw"))
    return bayes.importance_resample(line, "lw", 500, "id")


@query()
def fixed_factor_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E13 before E10."""
    cols = ["l_quantity", "l_discount", "l_tax"]
    a, b = (sensitivity.fix_factor(sensitivity.quantile_sample(_lines(spark, sf_dir), cols, 2000, "random", s), "l_tax", 0.04) for s in (1, 2))
    return sensitivity.sobol_indices(a, b, cols, lambda x: x[0] + 100 * x[1] * x[2])


@query()
def mean_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A24 by draws."""
    per = read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("grp")).agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd")).withColumn("feature_id", F.lit(0))
    pairs = stats.pairwise_contrasts(per, stats.contrast_table(per.select("grp")))
    return bayes.mean_diff_posterior(pairs, "contrast", draws=4000)


@query()
def text_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best and mean agreement with the language over a grid of settings."""
    docs = read(spark, sf_dir, "documents").where("lang is not null")
    grid = [{"stem": stem, "sublinear": s, "min_df": d, "n_max": n} for stem in (False, True) for s, d, n in ((True, 5, 1), (True, 20, 1), (False, 5, 1), (False, 20, 1), (True, 20, 2))]
    grid += [{"min_df": 5, "kernel": kernel, "components": 6, "rounds": 8} for kernel in ("cosine", "rbf", "laplacian", "polynomial")]
    grid += [{"min_df": 5, "kernel": "cosine", "components": 12, "rounds": 8}]
    return text.text_grid(docs, grid, "lang", 4, [1])


_SPARSE = f"""{_COUNTS}, raw AS (SELECT doc_id, term, (1 + ln(tf)) * (ln(n_docs / df) + 1) AS w FROM k), u AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM raw),
sim AS (SELECT a.doc_id AS key, b.doc_id AS neighbour, sum(a.w * b.w) AS s, sum(least(a.w, b.w)) AS m FROM u a JOIN u b ON a.term = b.term AND a.doc_id <> b.doc_id GROUP BY ALL),
near AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY round(s, 9) DESC, neighbour) AS r FROM sim)"""


@query(f"""WITH {_SPARSE} SELECT key, r AS rank, round(s, 6) AS similarity FROM near WHERE r <= 5 AND key % 20 = 0""")
def sparse_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The similarities of the nearest documents by cosine of tf-idf, exact (id % 20 against all)."""
    cells = materialize(text.tfidf(_counts(spark, sf_dir)).select(F.col("doc_id").alias("key"), "term", "weight"), "cells")
    near = sparse.cosine_neighbours(cells.where("key % 20 = 0"), cells, 5)
    return near.select("key", F.col("rank").cast("long").alias("rank"), F.round("similarity", 6).alias("similarity"))


@query(f"""WITH {_SPARSE}, t AS (SELECT doc_id, sum(w) AS t FROM u GROUP BY 1), g AS (SELECT 1.0 / count(DISTINCT term) AS g FROM u)
SELECT r.key, r.r AS rank, round(s, 6) AS cosine, round(exp(-g * greatest(2 - 2 * s, 0)), 6) AS rbf, round(exp(-g * (x.t + y.t - 2 * m)), 6) AS laplacian, round((g * s + 1) ** 3, 6) AS polynomial
FROM near r JOIN t x ON x.doc_id = r.key JOIN t y ON y.doc_id = r.neighbour, g WHERE r.r = 1 AND key % 20 = 0""")
def kernel_similarities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four kernels of every queried document and its nearest one."""
    cells = materialize(text.tfidf(_counts(spark, sf_dir)).select(F.col("doc_id").alias("key"), "term", "weight"), "cells")
    near = sparse.cosine_neighbours(cells.where("key % 20 = 0"), cells, 1).where("rank = 1")
    edges = near.select(F.col("key").alias("i"), F.col("neighbour").alias("j"), "similarity")
    out = near.select("key", F.col("rank").cast("long").alias("rank"))
    for kernel in sparse.KERNELS:
        out = out.join(sparse.kernel_weights(edges, cells, kernel).select(F.col("i").alias("key"), F.round("weight", 6).alias(kernel)), "key")
    return out


def _spiked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Vectors as features with their 64 numbers as samples, and a shift for every fifth."""
    packed = vectors(spark, sf_dir).select(F.col("vec_id").alias("feature_id"), "v")
    return packed, packed.where("feature_id % 5 = 0").select("feature_id", F.lit(0.1).alias("shift"))


_T = "(sx / 32 - sy / 32) / sqrt(((qx - sx * sx / 32) / 31 + (qy - sy * sy / 32) / 31) / 2 * (2.0 / 32))"
_SUMS = "sum(x) FILTER ({0}) AS sx, sum(x * x) FILTER ({0}) AS qx, sum(x) FILTER (NOT ({0})) AS sy, sum(x * x) FILTER (NOT ({0})) AS qy"


@query(f"""WITH cells AS (SELECT vec_id AS f, unnest(range(64)) AS pos, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings),
o AS (SELECT rep, pos, row_number() OVER (PARTITION BY rep ORDER BY {_key("rep", "pos", "1")}, pos) - 1 AS place FROM range(1, 4) g(rep), range(64) p(pos)),
d AS (SELECT rep, f, place, x + CASE WHEN place < 32 AND f % 5 = 0 THEN 0.1 ELSE 0 END AS x FROM cells JOIN o USING (pos)),
seen AS (SELECT rep, f, abs({_T}) AS t FROM (SELECT rep, f, {_SUMS.format("place < 32")} FROM d GROUP BY ALL)),
i AS (SELECT rep, k, place, row_number() OVER (PARTITION BY rep, k ORDER BY {_key("(rep * 40 + k)", "place", "7920")}, place) <= 32 AS inx FROM range(1, 4) g(rep), range(40) h(k), range(64) p(place)),
drawn AS (SELECT rep, k, max(abs({_T})) AS most FROM (SELECT rep, k, f, {_SUMS.format("inx")} FROM d JOIN i USING (rep, place) GROUP BY ALL) GROUP BY ALL),
lim AS (SELECT rep, most FROM drawn QUALIFY row_number() OVER (PARTITION BY rep ORDER BY most DESC, k) = 3)
SELECT rep, count(*) FILTER (f % 5 = 0 AND t <= most) AS fn, count(*) FILTER (f % 5 <> 0 AND t > most) AS fp, count(*) FILTER (t > most) AS rejections, count(*) AS n_tests FROM seen JOIN lim USING (rep) GROUP BY rep""")
def two_level_westfall_young(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Westfall-Young inside every outer data set (both levels' keys are portable)."""
    packed, shifts = _spiked(spark, sf_dir)
    return two_level.two_level_calibration(packed, 32, 3, 40, shifts, ("westfall_young",)).select("rep", "fn", "fp", "rejections", "n_tests")


@query()
def two_level_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R9 under all methods."""
    packed, shifts = _spiked(spark, sf_dir)
    return stats.experiment_measures(two_level.two_level_calibration(packed, 32, 3, 40, shifts))


@query()
def indexed_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J7 by the two-level index: the five nearest vectors of every id divisible by 20, among all."""
    e = read(spark, sf_dir, "embeddings")
    out = joins.knn_two_level(e.where("vec_id % 20 = 0"), e, 5)
    return out.select("key", "neighbour", F.round("distance", 5).alias("distance"), F.col("rank").cast("long").alias("rank"))


@query("SELECT count(*) AS n FROM embeddings")
def indexed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With all cells looked at, the index finds every vector itself: none is lost."""
    e = read(spark, sf_dir, "embeddings")
    named = e.select((-F.col("vec_id") - 1).alias("vec_id"), "embedding")  # a query's own row may be near it
    index = joins.two_level_index(e)
    own = materialize(joins.search_index(index, named, 1, (2, 2)).where("distance < 1e-6").select("key"), "own")
    # a row that its nearest cells don't hold is looked for in all
    rest = materialize(named.join(own.withColumnRenamed("key", "vec_id"), "vec_id", "left_anti"), "rest")
    far = joins.search_index(index, rest, 1, (1 << 20, 1 << 20)).where("distance < 1e-6").select("key")
    near = own if rest.isEmpty() else own.unionByName(far)
    return near.agg(F.count(F.lit(1)).alias("n"))
