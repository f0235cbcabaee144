"""Every registered query at the smallest scale, next to its SQL."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from check_sql import rows
from dwell.plans import oracle, queries as registered
from dwell.sources.tables import TABLES

FOLDER = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    return con


def test_every_query_has_sql_but_the_models():
    without = set(registered.all_queries()) - set(oracle.all_sql())
    assert without == {"mdl_tfidf_logreg", "mdl_subword_softmax", "mdl_score_topk", "mdl_save_load"}
    assert not set(SQL) - set(entry.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, name):
    df = entry.queries()[name](spark, FOLDER)
    cur = con.execute(SQL[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(columns, cur.fetchall())


def test_entry(spark):
    assert entry.entry(spark).columns == ["name", "hours", "minutes"]
