"""Every query with SQL against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from voltlake.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    return tuple(map(norm, v)) if isinstance(v, list | tuple) else v


def rows(names, got):
    return sorted(([str(norm(r[k])) for k in sorted(range(len(names)), key=names.__getitem__)] for r in got), key=str)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_as_sql(spark, duck, name):
    df = registry.queries()[name](spark, DATA)
    cur = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, df.collect()) == rows(names, cur.fetchall())


@pytest.mark.parametrize("name", ["param_points", "param_curve"])
def test_same_as_sql_where_values_are_zero(spark, tmp_path, name):
    """Every eleventh value is 0, so logarithms of some segments' ends aren't finite."""
    con = duckdb.connect()
    con.execute(f"copy (select * replace (case when event_id % 11 = 0 then 0.0 else value end as value) from '{DATA}/events.parquet') to '{tmp_path}/events.parquet' (format parquet)")
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet'")
    df = registry.queries()[name](spark, str(tmp_path))
    cur = con.execute(registry.oracle_sql()[name])
    want = rows([d[0] for d in cur.description], cur.fetchall())
    assert rows(df.columns, df.collect()) == want and any("inf" in str(r) for r in want) == (name == "param_points")
