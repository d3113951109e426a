"""Every registered query against its SQL in DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from brindle.plans import registry

DATA = "/root/testdata/sf0.001"
NAMES = sorted(registry.queries())
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{DATA}/{name}'")
    return con


def plain(v):
    return ("nan" if math.isnan(v) else round(v, 9)) if isinstance(v, float) else v


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    out = duck.execute(sql)
    names = [c[0] for c in out.description]
    assert sorted(names) == cols
    want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in out.fetchall()), key=repr)
    assert rows == want


def test_entry_has_the_optional_queries_only_if_they_are_there(spark):
    import __spark_entry__

    names = __spark_entry__.queries()
    assert set(registry.queries()) <= set(names)
    assert set(__spark_entry__.oracle_sql()) <= set(names)
    assert __spark_entry__.entry(spark).limit(1).count() == 1
