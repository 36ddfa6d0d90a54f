"""Every registered query of the engine runs on the smallest tables and agrees with its SQL."""

import math
import os

import duckdb
import pytest

from waymark.plans import clauses, generated, queries

ALL = queries.ALL | generated.ALL | clauses.ALL

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


def plain(v):
    return None if v is None or isinstance(v, float) and math.isnan(v) else round(float(v), 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", list(ALL))
def test_agrees(spark, db, name):
    query, sql = ALL[name]
    df = query(spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(str(plain(r[c])) for c in columns) for r in df.collect()))
    assert got
    if sql:
        rel = db.sql(sql)
        assert sorted(rel.columns) == columns
        at = [rel.columns.index(c) for c in columns]
        assert got == sorted(tuple(str(plain(r[k])) for k in at) for r in rel.fetchall())


def test_entry_point(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(ALL) <= set(e.queries())
