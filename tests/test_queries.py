"""Every registered query against its SQL, on the smallest tables."""

import datetime
import decimal
import math
from pathlib import Path

import duckdb
import pytest

from tallyflow.plans.registry import FLAGSHIP, QUERIES, SQL

SF = "/root/testdata/sf0.001"
#: What runs here within another query; tests/test_sweep.py and tests/test_operators.py hold them against brute force.
WITHIN = {"m12_sigma_sweep", "g10_communities"}


def plain(v):
    if isinstance(v, float | decimal.Decimal):
        v = float(v)
        return None if math.isnan(v) else float(f"{v:.9g}") + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    return v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


def same_rows(df, duck, sql):
    cur = duck.execute(sql)
    names = [x[0] for x in cur.description]
    theirs = cur.fetchall()
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    mine = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=repr)
    want = sorted((tuple(plain(r[names.index(c)]) for c in order) for r in theirs), key=repr)
    assert mine == want


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, name):
    same_rows(QUERIES[name](spark, SF), duck, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - WITHIN))
def test_other_queries_run(spark, name):
    assert QUERIES[name](spark, SF).limit(1).count() == 1


def test_flagship_is_registered():
    assert FLAGSHIP in QUERIES and FLAGSHIP in SQL
