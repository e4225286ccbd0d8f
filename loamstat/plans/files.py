"""Queries over readers and writers: tables are written as delimited files in the shared work folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamstat.functions.work import checkpoint_root
from loamstat.plans.tables import read
from loamstat.plans.testing import _TESTS, part_tests
from loamstat.sources import tables

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_root(spark)}/work/{name}-{uuid.uuid4().hex}"


@query("""SELECT l_suppkey AS supplier, CAST(l_linenumber - 1 AS INTEGER) AS position, CASE WHEN l_linenumber <= 4 THEN 'early' ELSE 'late' END AS grp,
  round(sum(l_quantity), 4) AS area, CAST(count(*) AS INTEGER) AS gap FROM lineitem GROUP BY ALL""")
def feature_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IO1: suppliers as features, line numbers as samples; header lines in a file of their own."""
    n = 7
    per = read(spark, sf_dir, "lineitem").groupBy("l_suppkey").pivot("l_linenumber", list(range(1, n + 1))).agg(F.round(F.sum("l_quantity"), 4).alias("a"), F.count(F.lit(1)).alias("g"))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    cells = [F.col("l_suppkey").cast("string"), *[F.lit(x) for x in ("x", "x", "x")], F.col("l_suppkey").cast("string"), *[F.lit("x")] * 3]
    cells += [text(f"{i}_a") for i in range(1, n + 1)] + [F.lit("")] * n + [text(f"{i}_g") for i in range(1, n + 1)]
    path = _folder(spark, "matrix")
    per.select(F.concat_ws(";", *cells)).write.text(f"{path}/body")
    line = lambda name: ";".join(["", "", "", "", *[""] * 4, *[name(i) for i in range(1, n + 1)], *[""] * (2 * n)])
    head = [line(lambda i: "early" if i <= 4 else "late"), line(lambda i: ""), line(lambda i: f"f_{i}.raw")]
    spark.createDataFrame([("\n".join(head),)], "line string").coalesce(1).write.text(f"{path}/head")
    features, samples = tables.read_feature_matrix(spark, f"{path}/body", 3, 8, n, head_path=f"{path}/head")
    pair = F.explode(F.array(*[F.struct(F.lit(f"a{i}").alias("sample_id"), F.col(f"a{i}").alias("area"), F.col(f"g{i}").alias("gap")) for i in range(n)]))
    long = features.select(F.col("m0").cast("long").alias("supplier"), pair.alias("c")).select("supplier", "c.*")
    return long.where("area is not null").join(samples, "sample_id").select("supplier", "position", "grp", "area", "gap")


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def delimited_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IO4: fields parted by #."""
    path = _folder(spark, "suppliers")
    read(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal").write.csv(path, sep="#", header=True)
    return tables.read_delimited(spark, path, "#", "s_suppkey long, s_name string, s_acctbal double")


@query("SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'even' ELSE 'odd' END AS mode, o_orderkey, o_totalprice, true AS tagged FROM orders")
def tagged_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IO3: two folders in one read, each row with its file's name."""
    path = _folder(spark, "orders")
    rows = read(spark, sf_dir, "orders").select((F.col("o_orderkey") % 2).alias("odd"), "o_orderkey", "o_totalprice")
    for odd, name in ((0, "even"), (1, "odd")):
        rows.where(F.col("odd") == odd).select(F.lit(name).alias("mode"), "o_orderkey", "o_totalprice").write.csv(f"{path}/{name}", sep=";", header=True)
    got = tables.read_tagged(spark, [f"{path}/even", f"{path}/odd"], "mode string, o_orderkey long, o_totalprice double")
    return got.select("mode", "o_orderkey", "o_totalprice", F.col("source").endswith(".csv").alias("tagged"))


@query(r"""SELECT translate(coalesce(b.text, ''), chr(9) || chr(10) || chr(13), '   ') AS src, translate(coalesce(a.text, ''), chr(9) || chr(10) || chr(13), '   ') AS tgt
FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1""")
def tab_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IO5: consecutive turns, one tab-separated pair a line, reversed on reading."""
    c = read(spark, sf_dir, "conversations")
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("t"))
    flat = lambda x: F.translate(F.coalesce(x, F.lit("")), "\t\n\r", "   ")
    path = _folder(spark, "pairs")
    c.join(nxt, ["conv_id", "turn"]).select(F.concat_ws("\t", flat("text"), flat("t"))).write.text(path)
    return tables.read_pairs(spark, path, reverse=True).select("src", "tgt")


_KEPT = f"""WITH {_TESTS}, kept AS (SELECT * FROM p WHERE p < 0.05 AND abs(fc) >= 0.5)"""


def _tested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_tests(spark, sf_dir).select("feature_id", "contrast", "fc", "p", F.col("contrast").alias("source"))


@query(f"{_KEPT} SELECT feature_id, contrast, round(fc, 6) AS fc, round(p, 7) AS p FROM kept")
def written_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IO6: significant tests, written in the order of corrected p and read back."""
    path = _folder(spark, "tests")
    tables.write_tests(_tested(spark, sf_dir).drop("source"), path, ";", 0.5, 0.05, "p")
    back = tables.read_delimited(spark, path, ";", "feature_id long, contrast string, fc double, p double")
    return back.select("feature_id", "contrast", F.round("fc", 6).alias("fc"), F.round("p", 7).alias("p"))


@query(f"{_KEPT} SELECT DISTINCT contrast AS source, feature_id FROM kept")
def split_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IO7: significant ids in a folder per contrast."""
    path = _folder(spark, "split")
    tables.write_by_source(tables.significant(_tested(spark, sf_dir), 0.5, 0.05, "p"), path, "source", "feature_id")
    return spark.read.csv(path, sep=";", header=True, schema="feature_id long, source string").select("source", "feature_id")
