"""Queries over joins, ranks, text and pair preparation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamstat.operators import joins, pairs, ranks, text
from loamstat.plans.tables import read
from loamstat.plans.testing import _TESTS, part_tests

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query("""SELECT a.p_partkey AS i, b.p_partkey AS j, CAST(abs(a.p_size - b.p_size) AS DOUBLE) AS dm, round(abs(a.p_retailprice - b.p_retailprice), 6) AS dt
FROM part a JOIN part b ON a.p_partkey < b.p_partkey AND abs(a.p_size - b.p_size) <= 1 AND abs(a.p_retailprice - b.p_retailprice) <= 2.5""")
def band_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J1."""
    f = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("feature_id"), F.col("p_size").cast("double").alias("mass"), F.col("p_retailprice").alias("rtime"))
    return joins.masstime_duplicates(f, 1.0, 2.5).select("i", "j", "dm", F.round("dt", 6).alias("dt"))


@query("""WITH c AS (SELECT vec_id, unnest(range(64)) AS s, unnest(embedding) AS v FROM embeddings), o AS (SELECT vec_id, s, CAST(round(v * 3) AS INTEGER) AS v FROM c)
SELECT a.vec_id AS i, b.vec_id AS j, count(*) / 64.0 AS similarity FROM o a JOIN o b ON a.s = b.s AND a.v = b.v AND a.vec_id < b.vec_id GROUP BY ALL HAVING count(*) >= 0.8 * 64""")
def value_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings in coarse steps, pairs equal in eight of ten dimensions."""
    cells = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("feature_id"), F.posexplode("embedding").alias("sample_id", "v"))
    obs = cells.select("feature_id", "sample_id", F.round(F.col("v").cast("double") * 3).cast("int").alias("value"))
    return joins.value_duplicates(obs, 0.8)


@query("""WITH k AS (SELECT DISTINCT p_brand AS source, CAST(p_size AS DOUBLE) AS m, p_retailprice AS t FROM part)
SELECT a.source AS source_l, a.m AS m_l, a.t AS t_l, b.source AS source_r, b.m AS m_r, b.t AS t_r, a.m - b.m AS dm, round(a.t - b.t, 6) + 0 AS dt
FROM k a JOIN k b ON a.source < b.source AND abs(a.m - b.m) <= 0.5 AND abs(a.t - b.t) <= 1.5""")
def source_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J3."""
    f = read(spark, sf_dir, "part").select(F.col("p_brand").alias("source"), F.col("p_size").cast("double").alias("mass"), F.col("p_retailprice").alias("rtime"))
    return joins.cross_source_duplicates(f, 0.5, 1.5).withColumn("dt", F.round("dt", 6) + 0.0)


@query("""SELECT a.s_suppkey AS i, b.s_suppkey AS j, round(abs(a.s_acctbal - b.s_acctbal), 6) AS distance, round(greatest(0, 1 - 0.01 * abs(a.s_acctbal - b.s_acctbal)), 6) AS weight
FROM supplier a JOIN supplier b ON a.s_suppkey < b.s_suppkey AND abs(a.s_acctbal - b.s_acctbal) <= 80""")
def proximity_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J4, soft."""
    out = joins.proximity_pairs(read(spark, sf_dir, "supplier"), "s_acctbal", 80.0, "s_suppkey", True, 0.01)
    return out.select("i", "j", F.round("distance", 6).alias("distance"), F.round("weight", 6).alias("weight"))


@query("""WITH q AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), d AS (
  SELECT a.vec_id AS key, b.vec_id AS neighbour, list_distance(a.e, b.e) AS distance FROM q a JOIN q b ON a.vec_id <> b.vec_id AND a.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY distance, neighbour) AS rank FROM d) SELECT key, neighbour, round(distance, 5) AS distance, rank FROM r WHERE rank <= 5""")
def nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stated query set - every row whose id is divisible by 20 - against all rows."""
    e = read(spark, sf_dir, "embeddings")
    out = joins.knn(e.where("vec_id % 20 = 0"), e, 5)
    return out.select("key", "neighbour", F.round("distance", 5).alias("distance"), F.col("rank").cast("long").alias("rank"))


@query("""WITH q AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), d AS (
  SELECT a.vec_id, b.label, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.e, b.e), b.vec_id) AS r FROM q a JOIN q b ON b.vec_id % 2 = 1 AND a.vec_id % 2 = 0),
v AS (SELECT vec_id, label, count(*) AS n FROM d WHERE r <= 7 GROUP BY ALL) SELECT vec_id, arg_min(label, (-n, label)) AS predicted FROM v GROUP BY vec_id""")
def nearest_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classification of the even ids by the odd ones (the two halves are the feature)."""
    e = read(spark, sf_dir, "embeddings")
    return joins.knn_classify(e.where("vec_id % 2 = 1"), e.where("vec_id % 2 = 0"), 7)


@query("""WITH b AS (SELECT * FROM (VALUES (0, 1.0, 2.0, 3.0), (1, 0.5, -1.0, 4.0)) v(rep, b0, b1, b2))
SELECT l_orderkey, l_linenumber, rep, round(b0 * l_quantity + b1 * l_discount + b2 * l_tax, 6) + 0 AS prediction FROM lineitem, b""")
def coefficient_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J8."""
    coefs = spark.createDataFrame([(0, [1.0, 2.0, 3.0]), (1, [0.5, -1.0, 4.0])], "rep int, beta array<double>")
    rows = read(spark, sf_dir, "lineitem").withColumn("id", F.struct("l_orderkey", "l_linenumber"))
    out = joins.uncertainty_predict(rows, coefs, "id", F.array("l_quantity", "l_discount", "l_tax"))
    return out.select("id.l_orderkey", "id.l_linenumber", "rep", (F.round("prediction", 6) + 0.0).alias("prediction"))


def _whole_mean(col: str) -> Column:
    """The mean rounded to a whole number, from a decimal sum: a sum of doubles depends on its order, and so does what a mean of x.5 is rounded to."""
    return F.round(F.avg(F.col(col).cast("decimal(28,10)")), 0).cast("double")


@query("""WITH s AS (SELECT l_suppkey, l_quantity AS x, l_orderkey, l_linenumber FROM lineitem), r AS (SELECT l_suppkey, l_returnflag AS f, avg(l_extendedprice) AS v FROM lineitem GROUP BY ALL)
SELECT l_suppkey, f, count(*) OVER w AS rank_max, rank() OVER w AS rank_min FROM r WINDOW w AS (PARTITION BY f ORDER BY abs(round(v, 0)) DESC)""")
def magnitude_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W1 with ties max and min."""
    r = read(spark, sf_dir, "lineitem").groupBy("l_suppkey", F.col("l_returnflag").alias("f")).agg(_whole_mean("l_extendedprice").alias("value"))
    top = ranks.rank_abs(r, ["f"]).withColumnRenamed("rank", "rank_max")
    return ranks.rank_abs(top, ["f"], ties="min").select("l_suppkey", "f", "rank_max", F.col("rank").alias("rank_min"))


_RANKED = """v AS (SELECT l_suppkey AS variable, l_returnflag AS method, l_linestatus AS lam, round(avg(l_extendedprice), 0) AS v FROM lineitem GROUP BY ALL),
r AS (SELECT variable, method, lam, rank() OVER (PARTITION BY method, lam ORDER BY abs(v) DESC) AS rank FROM v)"""


def _supplier_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("variable"), F.col("l_returnflag").alias("method"), F.col("l_linestatus").alias("lam")).agg(_whole_mean("l_extendedprice").alias("value"))
    return ranks.rank_abs(v, ["method", "lam"], ties="min")


@query(f"""WITH {_RANKED}, s AS (SELECT variable, lam, round(var_samp(rank), 6) AS rank_var, round(stddev_samp(rank), 6) AS rank_sd FROM r GROUP BY ALL)
SELECT *, CASE WHEN rank_sd IS NULL THEN NULL ELSE count(rank_sd) OVER (PARTITION BY lam ORDER BY rank_sd DESC NULLS LAST) END AS sd_rank FROM s WHERE rank_sd IS NOT NULL""")
def rank_spreads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W2."""
    s = ranks.rank_spread(_supplier_ranks(spark, sf_dir), ["variable", "lam"], digits=6).where("rank_sd is not null")
    return s.select("variable", "lam", F.round("rank_var", 6).alias("rank_var"), F.round("rank_sd", 6).alias("rank_sd"), "sd_rank")


@query(f"""WITH {_RANKED} SELECT a.variable, a.lam, a.rank - b.rank AS diff, abs(a.rank - b.rank) AS abs_diff FROM r a JOIN r b ON a.variable = b.variable AND a.lam = b.lam AND a.method = 'A' AND b.method = 'R'""")
def rank_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W3."""
    return ranks.rank_diff(_supplier_ranks(spark, sf_dir), "A", "R", ["variable", "lam"])


@query("""SELECT p_partkey, split_part(v, '_', 1) AS index, split_part(v, '_', 2) AS part, value FROM (
  SELECT p_partkey, 'S1_size' AS v, CAST(p_size AS DOUBLE) AS value FROM part UNION ALL SELECT p_partkey, 'ST_price', p_retailprice FROM part)""")
def wide_to_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unpivot and split compound names."""
    wide = read(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("S1_size"), F.col("p_retailprice").alias("ST_price"))
    long = ranks.to_long(wide, ["p_partkey"])
    return long.select("p_partkey", *ranks.split_name(F.col("variable"), "_", ["index", "part"]), "value")


@query("""SELECT l_suppkey, round(avg(l_quantity) FILTER (l_returnflag = 'A'), 6) AS a, round(avg(l_quantity) FILTER (l_returnflag = 'N'), 6) AS n, round(avg(l_quantity) FILTER (l_returnflag = 'R'), 6) AS r FROM lineitem GROUP BY 1""")
def long_to_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pivot with named columns."""
    long = read(spark, sf_dir, "lineitem").groupBy("l_suppkey", F.lower("l_returnflag").alias("f")).agg(F.round(F.avg("l_quantity"), 6).alias("v"))
    return ranks.to_wide(long, ["l_suppkey"], "f", "v", ["a", "n", "r"])


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC, l_orderkey * 10 + l_linenumber) AS k FROM lineitem)
SELECT l_returnflag, l_orderkey, l_linenumber, l_extendedprice FROM r WHERE k <= 10""")
def largest_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W7 per group (the k is the feature)."""
    lines = read(spark, sf_dir, "lineitem").withColumn("id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return ranks.topk(lines, "l_extendedprice", 10, False, ["l_returnflag"], "id").select("l_returnflag", "l_orderkey", "l_linenumber", "l_extendedprice")


@query(f"""WITH {_TESTS}, b AS (SELECT feature_id, p AS p1, median_fc AS p2 FROM p WHERE contrast = 'A-N'), r AS (SELECT *, row_number() OVER (ORDER BY p2, feature_id) AS position FROM b),
k AS (SELECT * FROM r WHERE position <= CAST(floor(0.25 * (SELECT count(*) FROM b)) AS BIGINT)), w AS (
  SELECT position, avg(CASE WHEN p1 < 0.2 THEN 1.0 ELSE 0 END) OVER f AS share, (max(p2) OVER f - min(p2) OVER f) / 2 AS half_width, count(*) OVER f AS c FROM k WINDOW f AS (ORDER BY position ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING))
SELECT position, round(share, 6) AS share, round(half_width, 6) AS half_width FROM w WHERE c = 50""")
def tail_dependence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W5."""
    t = part_tests(spark, sf_dir).where("contrast = 'A-N'").select("feature_id", F.col("p").alias("p1"), F.col("median_fc").alias("p2"))
    out = ranks.tail_dependence(t, "p1", "p2", 0.2, 0.25, 50)
    return out.select(F.col("position").cast("long").alias("position"), F.round("share", 6).alias("share"), F.round("half_width", 6).alias("half_width"))


@query(f"""WITH {_TESTS} SELECT contrast, round(regr_slope(fc, median_fc), 6) AS slope, round(regr_intercept(fc, median_fc), 6) AS intercept, round(corr(fc, median_fc), 6) AS corr FROM p GROUP BY 1""")
def dependence_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W5's linear fit."""
    fit = ranks.line_fit(part_tests(spark, sf_dir), "median_fc", "fc", ["contrast"])
    return fit.select("contrast", *[F.round(c, 6).alias(c) for c in ("slope", "intercept", "corr")])


@query(f"""WITH {_TESTS}, b AS (SELECT feature_id, p, abs(fc) AS f, median_fc AS y FROM p WHERE contrast = 'N-R'),
lo AS (SELECT * FROM b WHERE y < 0.3 ORDER BY y DESC, feature_id DESC LIMIT 50), hi AS (SELECT * FROM b WHERE y >= 0.3 ORDER BY y, feature_id LIMIT 50)
SELECT round(avg(CASE WHEN p < 0.3 THEN 1.0 ELSE 0 END), 6) AS p, round(avg(CASE WHEN f < 0.3 THEN 1.0 ELSE 0 END), 6) AS f FROM (FROM lo UNION ALL FROM hi)""")
def interval_dependence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W6."""
    t = part_tests(spark, sf_dir).where("contrast = 'N-R'").select("feature_id", "p", F.abs("fc").alias("f"), "median_fc")
    out = ranks.interval_dependence(t, ["p", "f"], "median_fc", 0.3, 0.3, 100)
    return out.select(F.round("p", 6).alias("p"), F.round("f", 6).alias("f"))


@query("""WITH RECURSIVE s AS (SELECT l_partkey AS k, l_orderkey * 10 + l_linenumber AS id, l_extendedprice AS v, row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice, l_orderkey * 10 + l_linenumber) AS r FROM lineitem),
g AS (SELECT k, id, v, r, v AS leader FROM s WHERE r = 1 UNION ALL SELECT s.k, s.id, s.v, s.r, CASE WHEN s.v - g.leader > 4000 THEN s.v ELSE g.leader END FROM g JOIN s ON s.k = g.k AND s.r = g.r + 1)
SELECT k, id, leader FROM g""")
def leader_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W8 per part."""
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("k"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_extendedprice").alias("v"))
    return joins.leader_groups(lines, "id", "v", 4000.0, "k").select("k", "id", "leader")


@query("""WITH RECURSIVE p AS (SELECT DISTINCT l_extendedprice AS v FROM lineitem), l AS (SELECT min(v) AS v FROM p UNION ALL SELECT min(p.v) FROM l JOIN p ON p.v - l.v > 200 HAVING min(p.v) IS NOT NULL)
SELECT l_orderkey, l_linenumber, l.v AS leader FROM lineitem ASOF JOIN l ON lineitem.l_extendedprice >= l.v""")
def leaders_of_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W8 on one dense axis: all prices."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return joins.leader_groups(lines, "l_orderkey", "l_extendedprice", 200.0).select("l_orderkey", "l_linenumber", "leader")


@query("""WITH p AS (SELECT l_suppkey AS s, CAST(l_quantity AS INTEGER) AS lam, count(*) AS size FROM lineitem GROUP BY ALL)
SELECT s, lam, size, size - lag(size) OVER w AS delta, round(1.0 * (lead(size, 1) OVER w - lag(size, 1) OVER w) + 0.5 * (lead(size, 2) OVER w - lag(size, 2) OVER w), 6) AS sliding FROM p
WINDOW w AS (PARTITION BY s ORDER BY lam) QUALIFY delta IS NOT NULL AND sliding IS NOT NULL""")
def path_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W9."""
    p = read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("s"), F.col("l_quantity").cast("int").alias("lam")).agg(F.count(F.lit(1)).alias("size"))
    return ranks.model_delta(p, ["s"], order="lam").where("delta is not null and sliding is not null").select("s", "lam", "size", "delta", F.round("sliding", 6).alias("sliding"))


STOP = ("the", "of", "and", "a", "in", "to")
_TOKENS = r"""tok AS (
  SELECT doc_id, lang, source, list_filter(list_transform(list_filter(regexp_extract_all(coalesce(text, ''), '([\pL\pN_*]+|[^\s\pL\pN_*]+)'), lambda t: NOT regexp_matches(t, '[^\x00-\x7F]')),
    lambda t: regexp_replace(lower(t), '^[_*]+|[_*]+$', '', 'g')), lambda t: length(t) > 2 AND regexp_full_match(t, '[a-z]+') AND t NOT IN ('the', 'of', 'and', 'a', 'in', 'to')) AS tokens FROM documents
), term AS (SELECT doc_id, lang, unnest(tokens) AS term FROM tok)"""


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.tokenize(read(spark, sf_dir, "documents"), text.TokenOptions(STOP, 2, "drop")).select("doc_id", "lang", "source", "tokens")


@query(f"WITH {_TOKENS} SELECT doc_id, len(tokens) AS n, md5(array_to_string(tokens, ' ')) AS digest FROM tok")
def token_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N1."""
    return _tokens(spark, sf_dir).select("doc_id", F.size("tokens").cast("long").alias("n"), F.md5(F.array_join("tokens", " ").cast("binary")).alias("digest"))


@query(f"WITH {_TOKENS} SELECT term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM term GROUP BY 1 HAVING count(*) >= 20")
def word_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N3."""
    return text.word_freqs(_tokens(spark, sf_dir), 20)


_COUNTS = f"""{_TOKENS}, gram AS (
  SELECT doc_id, unnest(list_concat(tokens, list_transform(range(1, len(tokens)), lambda i: tokens[i] || ' ' || tokens[i + 1]))) AS term FROM tok
), c AS (SELECT doc_id, term, count(*) AS tf FROM gram GROUP BY ALL), v AS (
  SELECT term, count(*) AS df, sum(tf) AS total FROM c GROUP BY 1 HAVING count(*) >= 5 AND count(*) <= 0.5 * (SELECT count(*) FROM documents)
), top AS (SELECT term, df FROM v ORDER BY total DESC, term LIMIT 300), k AS (SELECT doc_id, term, tf, df, (SELECT count(*) FROM documents) AS n_docs FROM c JOIN top USING (term))"""


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.ngram_counts(_tokens(spark, sf_dir), 1, 2, 5, 0.5, 300)


@query(f"WITH {_COUNTS} SELECT doc_id, term, tf, df, n_docs FROM k")
def ngram_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N4 (the vocabulary's size is the feature)."""
    return _counts(spark, sf_dir)


@query(f"""WITH {_COUNTS}, w AS (SELECT *, (1 + ln(tf)) * (ln(n_docs / df) + 1) AS w FROM k)
SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 8) AS weight FROM w""")
def tfidf_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N5."""
    return text.tfidf(_counts(spark, sf_dir)).select("doc_id", "term", F.round("weight", 8).alias("weight"))


@query(f"""WITH {_COUNTS}, p AS (SELECT lang AS cluster, term, CAST(sum(tf) AS BIGINT) AS n FROM k JOIN documents USING (doc_id) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, term) AS rank FROM p) SELECT * FROM r WHERE rank <= 15""")
def top_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N6 (the k is the feature)."""
    labels = read(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("cluster"))
    return text.top_terms(_counts(spark, sf_dir), labels, 15).withColumn("rank", F.col("rank").cast("long"))


@query("SELECT doc_id, lang, CAST(dense_rank() OVER (ORDER BY lang) - 1 AS INTEGER) AS code FROM documents")
def label_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N8."""
    return text.encode_labels(read(spark, sf_dir, "documents").select("doc_id", "lang"), "lang")


_PAIRS = r"""tp AS (
  SELECT a.conv_id * 1000 + a.turn AS turn_id, string_split(coalesce(a.text, ''), '.') AS s, string_split(coalesce(b.text, ''), '.') AS t FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1
), pr AS (
  SELECT turn_id * 10000 + i AS pair_id, coalesce(s[i + 1], '') AS s, coalesce(t[i + 1], '') AS t FROM (SELECT *, unnest(range(greatest(len(s), len(t)))) AS i FROM tp)
), norm AS (
  SELECT pair_id, trim(regexp_replace(regexp_replace(lower(trim(strip_accents(s))), '([.!?])', ' \1', 'g'), '[^a-zA-Z.!?]+', ' ', 'g')) AS src,
    trim(regexp_replace(regexp_replace(lower(trim(strip_accents(t))), '([.!?])', ' \1', 'g'), '[^a-zA-Z.!?]+', ' ', 'g')) AS tgt FROM pr
)"""


def _turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(pair_id, s, t)``: the whole texts of consecutive turns."""
    c = read(spark, sf_dir, "conversations")
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("t"))
    return c.join(nxt, ["conv_id", "turn"]).select((F.col("conv_id") * 1000 + F.col("turn")).alias("pair_id"), F.col("text").alias("s"), "t")


def _normalized(raw: DataFrame) -> DataFrame:
    return raw.select("pair_id", pairs.normalize_sentence(F.col("s")).alias("src"), pairs.normalize_sentence(F.col("t")).alias("tgt"))


def _sentence_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sentences of consecutive turns, the n-th with the n-th; where one turn has more, its last ones stand alone."""
    parts = _turn_pairs(spark, sf_dir).select("pair_id", *[F.split(F.coalesce(c, F.lit("")), r"\.").alias(c) for c in ("s", "t")])
    each = parts.select("*", F.explode(F.sequence(F.lit(0), F.greatest(F.size("s"), F.size("t")) - 1)).alias("i"))
    at = lambda c: F.coalesce(F.get(F.col(c), F.col("i")), F.lit(""))
    return _normalized(each.select((F.col("pair_id") * 10_000 + F.col("i")).alias("pair_id"), at("s").alias("s"), at("t").alias("t")))


@query(f"WITH {_PAIRS} SELECT * FROM norm")
def normalized_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of consecutive turns."""
    return _sentence_pairs(spark, sf_dir)


@query(f"WITH {_PAIRS} SELECT * FROM norm WHERE len(string_split(src, ' ')) < 10 AND len(string_split(tgt, ' ')) < 10 AND (starts_with(tgt, 'th') OR starts_with(tgt, 'on') OR starts_with(tgt, 'e'))")
def filtered_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N11."""
    return pairs.filter_pairs(_sentence_pairs(spark, sf_dir), 10, ("th", "on", "e"))


_VOCAB = f"""{_PAIRS}, w AS (SELECT pair_id, unnest(string_split(src, ' ')) AS word, unnest(range(len(string_split(src, ' ')))) AS pos FROM norm),
f AS (SELECT word, min(pair_id * 100000 + pos) AS first, count(*) AS count FROM w WHERE word <> '' GROUP BY 1), vocab AS (SELECT word, row_number() OVER (ORDER BY first) + 1 AS index, count FROM f)"""


@query(f"WITH {_VOCAB} SELECT word, index, count FROM vocab")
def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N12."""
    return pairs.build_vocab(_sentence_pairs(spark, sf_dir), "src")


@query(f"WITH {_VOCAB} SELECT n.pair_id, array_to_string(list_append(coalesce(l, []), 1), ',') AS ids FROM norm n LEFT JOIN (SELECT pair_id, list(index ORDER BY pos) AS l FROM w JOIN vocab USING (word) GROUP BY 1) e ON e.pair_id = n.pair_id")
def encoded_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N13."""
    p = _sentence_pairs(spark, sf_dir)
    return pairs.encode(p, pairs.build_vocab(p, "src"), "src").select("pair_id", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))


@query(f"WITH {_PAIRS} SELECT pair_id, src AS text FROM norm")
def decoded_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N13 there and back."""
    p = _sentence_pairs(spark, sf_dir)
    v = pairs.build_vocab(p, "src")
    return pairs.decode(pairs.encode(p, v, "src"), v)


@query()
def padded_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N14 over the whole texts of consecutive turns."""
    p = _normalized(_turn_pairs(spark, sf_dir))
    both = pairs.encode(p, pairs.build_vocab(p, "src"), "src").withColumnRenamed("ids", "src_ids").join(pairs.encode(p, pairs.build_vocab(p, "tgt"), "tgt").withColumnRenamed("ids", "tgt_ids"), "pair_id")
    return pairs.pad_batches(both)


@query("SELECT doc_id, (((doc_id * 1103515245 + 12345) % 2147483648) // 65536) % 1000 < 800 AS train FROM documents")
def keyed_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N15."""
    return pairs.keyed_split(read(spark, sf_dir, "documents").select("doc_id"), 0.8, "doc_id")
