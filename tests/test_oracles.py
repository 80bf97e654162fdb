"""Every query with SQL against DuckDB on the smallest tables; the others run."""

import datetime
import math

import duckdb
import pytest

from terrane import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (datetime.date, datetime.datetime)):
        return str(v)
    return float(v) if isinstance(v, (int, float)) or type(v).__name__ == "Decimal" else v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=str)


def close(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-6, abs_tol=2e-4)
    return a == b


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query_equals_sql(spark, sf, duck, name):
    df = plans.QUERIES[name](spark, sf)
    got = rows_of(df.columns, df.collect())
    con = duck.execute(plans.ORACLES[name])
    names = [d[0] for d in con.description]
    want = rows_of(names, con.fetchall())
    assert sorted(names) == sorted(df.columns) and want
    assert len(got) == len(want)
    assert all(close(x, y) for a, b in zip(got, want) for x, y in zip(a, b))


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLES)))
def test_query_runs(spark, sf, name):
    assert plans.QUERIES[name](spark, sf).count() > 0


def test_every_query_has_a_name_of_its_own():
    assert len(plans.QUERIES) == sum(len(m.QUERIES) for m in plans._MODULES)
    assert set(plans.ORACLES) <= set(plans.QUERIES)
