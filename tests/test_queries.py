"""Every registered query of the engine against its SQL in DuckDB, on the smallest tables."""

import math
import os

import __spark_entry__ as entry
import duckdb
import pytest
from bundlefold import queries as engine

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    return float(f"{v:.9g}") if isinstance(v, (int, float)) and not isinstance(v, bool) else v


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for name in os.listdir(SF):
        c.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return c


@pytest.mark.parametrize("name", sorted(engine.QUERIES))
def test_query(spark, db, name):
    df = engine.QUERIES[name](spark, SF)
    rows = df.collect()
    if name not in engine.ORACLE_SQL:
        assert df.columns
        return
    found = db.execute(engine.ORACLE_SQL[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    want = [dict(zip(columns, r, strict=True)) for r in found.fetchall()]
    key = lambda r: str([plain(r[c]) for c in sorted(columns)])
    assert sorted(map(key, (r.asDict() for r in rows))) == sorted(map(key, want))


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
