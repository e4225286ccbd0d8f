"""Queries of ranks and importances where a rounding decides the result."""

from __future__ import annotations

import duckdb

from loamstat.operators import ranks
from loamstat.plans import registry


def table(spark, folder, rows: str):
    """``lineitem`` of (l_suppkey, l_returnflag, l_linestatus, l_extendedprice, l_quantity)."""
    con = duckdb.connect()
    cols = "l_suppkey, l_returnflag, l_linestatus, l_extendedprice, l_quantity"
    con.sql(f"CREATE TABLE t AS SELECT row_number() OVER () AS l_orderkey, 1 AS l_linenumber, {cols}, 0.0::DOUBLE AS l_discount, 0.0::DOUBLE AS l_tax FROM ({rows}) v({cols})")
    con.sql(f"COPY t TO '{folder}/lineitem.parquet' (FORMAT parquet)")
    # prices in decimals: DuckDB's sums of them are exact, those of doubles depend on their order
    con.sql("CREATE VIEW lineitem AS SELECT * REPLACE (l_extendedprice::DECIMAL(15, 2) AS l_extendedprice) FROM t")
    return con


def lines(flag: str, other: float) -> str:
    """Supplier 1's mean is 2.5, yet doubles fall short of it in most orders; the others' are ``other`` and 0.2."""
    prices = [(1, x) for x in (1.92, 0.92, 2.01, 2.28, 2.11, 5.76)] + [(2, other), (3, 0.2)]
    return ", ".join(f"({s}, '{flag}', 'F', {x}::DOUBLE, 1.0::DOUBLE)" for s, x in prices)


def same(name, spark, folder, con):
    got = sorted(map(tuple, registry.QUERIES[name](spark, str(folder)).collect()))
    assert got == sorted(con.sql(registry.ORACLE_SQL[name]).fetchall())
    return got


def test_magnitude_ranks_round_exact_means(spark, tmp_path):
    con = table(spark, tmp_path, f"VALUES {lines('A', 3.0)}")
    assert same("magnitude_ranks", spark, tmp_path, con) == [(1, "A", 2, 1), (2, "A", 2, 1), (3, "A", 3, 3)]


def test_rank_spreads_round_exact_means(spark, tmp_path):
    con = table(spark, tmp_path, f"VALUES {lines('A', 3.0)}, {lines('R', 1.0)}")
    assert [r[:3] for r in same("rank_spreads", spark, tmp_path, con)] == [(1, "F", 0.0), (2, "F", 0.5), (3, "F", 0.0)]


def test_rank_spread_ties_in_the_digits_of_the_sql(spark):
    n = 1_000_000  # sds 1000000 and 1000000.00000017
    rows = [("a", 0), ("a", n), ("a", 2 * n), ("b", 0), ("b", n + 1), ("b", 2 * n)]
    got = ranks.rank_spread(spark.createDataFrame(rows, "variable string, rank long"), ["variable"], digits=6)
    assert {r["variable"]: r["sd_rank"] for r in got.collect()} == {"a": 2, "b": 2}


def test_importance_of_a_predictor_in_large_units(spark, tmp_path):
    """A slope under the tolerance of sparse coefficients (here 5e-6) is no importance of zero."""
    con = table(spark, tmp_path, "VALUES (1, 'A', 'F', 1000.0::DOUBLE, 0.0::DOUBLE), (1, 'A', 'F', 1000.0, 10000.0), (1, 'A', 'F', 1100.0, 20000.0)")
    assert same("normalized_importance", spark, tmp_path, con) == [("l_quantity", 0.75)]
