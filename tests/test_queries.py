"""Every query that has SQL gives what DuckDB gives on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CORE = [f.__name__ for f in entry.core.ALL]

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def shown(v):
    return repr(float(v) + 0.0) if isinstance(v, float) else str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(shown(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", CORE)
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert got[1]
        return
    r = duck.sql(sql)
    assert got == rows(r.columns, r.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 3


def test_entry_without_what_the_training_data_operators_need():
    import subprocess
    import sys

    told = "import sys, warnings; warnings.simplefilter('ignore'); sys.modules['ahocorasick'] = None; import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), e.llm)"
    out = subprocess.run([sys.executable, "-c", told], capture_output=True, text=True, timeout=120, cwd=os.path.dirname(os.path.abspath(entry.__file__)))
    n, sql, llm = out.stdout.split()
    assert (int(n), llm) == (len(CORE), "None") and 0 < int(sql) <= len(CORE), out.stderr
