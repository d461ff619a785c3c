"""Every registered query against its DuckDB SQL on the smallest tables."""

import math

import duckdb
import pytest

from quillon.plans import registry

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 4) + 0.0
    return str(v) if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_sql(spark, duck, sf_dir, name):
    df = registry.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    got = duck.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    expected = sorted((tuple(plain(r[i]) for i in at) for r in got.fetchall()), key=str)
    assert len(rows) == len(expected)
    for a, b in zip(rows, expected):
        for x, y in zip(a, b):
            if isinstance(x, float) and isinstance(y, (int, float)):
                assert math.isclose(x, y, rel_tol=1e-5, abs_tol=2e-4)
            else:
                assert x == y


def assert_equals_sql(spark, name, table, rows, folder):
    """The query and its SQL give the same on a table of these rows (SQL)."""
    con = duckdb.connect()
    con.execute(f"create table {table} as {rows}")
    con.execute(f"copy {table} to '{folder}/{table}.parquet'")
    df = registry.QUERIES[name](spark, str(folder))
    got = con.execute(registry.ORACLE_SQL[name])
    assert [d[0] for d in got.description] == df.columns
    rows = sorted(map(tuple, df.collect()))
    assert rows and rows == sorted(got.fetchall())


def test_integer_functions_of_large_keys(spark, tmp_path):
    # products of keys from 2**31 on, keys from 2**23, 2**24 and 2**28 on, and the last one of 31 bits
    keys = "(values (0::bigint), (149999), (8388608), (16777217), (268435456), (2147483647)) k(k)"
    parts = "(values (0::bigint), (19999), (1199999), (2147483647)) p(p)"
    rows = f"select k as l_orderkey, p as l_partkey, cast(n as int) as l_linenumber from {keys}, {parts}, range(1, 8) n(n)"
    assert_equals_sql(spark, "fn_integer", "lineitem", rows, tmp_path)


def test_strings_of_large_keys(spark, sf_dir, tmp_path):
    # keys whose seconds pass 32 bits, and whose year passes 9999
    rows = f"select * replace (p_partkey % 4 * 1000000 + p_partkey as p_partkey) from '{sf_dir}/part.parquet' limit 40"
    assert_equals_sql(spark, "fn_string", "part", rows, tmp_path)
