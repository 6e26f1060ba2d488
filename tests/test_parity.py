"""Every query with SQL against DuckDB at the smallest scale; the rest must run."""

import collections
import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = os.environ.get("PARITY_DIR", "/root/testdata/sf0.001")
if not os.path.isdir(FOLDER):
    pytest.skip("no test data here", allow_module_level=True)
QUERIES, SQL = entry.queries(), entry.oracle_sql()


def same(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return tuple(map(same, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{FOLDER}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = collections.Counter(tuple(same(r[c]) for c in columns) for r in df.collect())
    if name in SQL:
        result = duck.execute(SQL[name])
        names = [d[0] for d in result.description]
        assert sorted(names) == columns
        place = [names.index(c) for c in columns]
        assert got == collections.Counter(tuple(same(r[i]) for i in place) for r in result.fetchall())
