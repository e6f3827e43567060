"""Every query with SQL against DuckDB on the smallest tables; every other one must run."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
NAMES = sorted(n for n in entry.queries() if not n.startswith("op") and n != "pipeline")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    rows = entry.queries()[name](spark, SF)
    sql = entry.oracle_sql().get(name)
    if not sql:
        rows.write.format("noop").mode("overwrite").save()
        return
    got, ref = rows.collect(), duck.execute(sql)
    columns = [d[0] for d in ref.description]
    assert sorted(rows.columns) == sorted(columns)
    plain = lambda v: round(v, 9) if isinstance(v, float) else v
    want = sorted(repr(tuple(plain(dict(zip(columns, r))[c]) for c in sorted(columns))) for r in ref.fetchall())
    assert sorted(repr(tuple(plain(r[c]) for c in sorted(columns))) for r in got) == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
