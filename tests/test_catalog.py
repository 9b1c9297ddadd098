"""Every query with SQL gives the rows of its SQL, and the columns of both agree."""

import math

import duckdb
import pytest

import __spark_entry__ as driver

from .conftest import SMALL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    return str(value)


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def test_entry(spark):
    assert driver.entry(spark).columns == ["source", "n", "accuracy", "norm_ed", "chars"]


def test_all_sql_has_a_query():
    assert set(driver.oracle_sql()) <= set(driver.queries())


@pytest.mark.parametrize("name", sorted(driver.oracle_sql()))
def test_query_matches_sql(spark, oracle, name):
    got = driver.queries()[name](spark, SMALL)
    columns = sorted(got.columns)
    want = oracle.execute(driver.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == columns
    places = [names.index(c) for c in columns]
    want = sorted(tuple(plain(r[i]) for i in places) for r in want.fetchall())
    assert sorted(tuple(plain(r[c]) for c in columns) for r in got.collect()) == want
