"""Registered queries against their SQL twins on the smallest tables."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest

from loamstat.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(map(repr, df.astype(object).where(df.notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, db, name):
    assert rows(registry.QUERIES[name](spark, SF).toPandas()) == rows(db.sql(registry.ORACLE_SQL[name]).df())


#: Columns that lie in [0, 1].
SHARES = {"p", "probability", "best_nmi", "mean_nmi", "changed", "sensitivity", "specificity", "fdr", "fwer", "shrinkage", "train_ratio"}


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_query_runs(spark, name):
    """Queries without SQL run to their end; the values are held in test_bruteforce and test_library."""
    got = registry.QUERIES[name](spark, SF).toPandas()
    assert len(got) or name in EMPTY, name
    for c in got.columns:
        if got[c].dtype == "float64":
            assert not np.isinf(got[c]).any()
            if c in SHARES:
                assert got[c].dropna().between(-1e-9, 1 + 1e-9).all(), c


#: No cluster of this small table has a negative partner, or no group has enough rows.
EMPTY: set[str] = set()


def test_padded_batches_hold_whole_turns(spark, db):
    """Every word of both turns is in its batch, not those of the first sentence only."""
    word = "len(list_filter(string_split(trim(regexp_replace(regexp_replace(lower(trim(strip_accents({}))), '([.!?])', ' \\1', 'g'), '[^a-zA-Z.!?]+', ' ', 'g')), ' '), lambda w: w <> ''))"
    sql = f"SELECT a.conv_id * 1000 + a.turn AS pair_id, {word.format('a.text')} AS n, {word.format('b.text')} AS m FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1"
    got = registry.QUERIES["padded_batches"](spark, SF).toPandas()
    real = sorted((r.pair_id, sum(i >= 2 for i in r.src_padded), sum(i >= 2 for i in r.tgt_padded)) for r in got.itertuples())
    assert real == sorted(db.sql(sql).fetchall())
