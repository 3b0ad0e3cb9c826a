"""Every registered query against its SQL in DuckDB at the smallest scale."""

import math

import duckdb
import pytest

from formweave.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    return str(v)


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(name, spark, sf, con):
    df = registry.queries()[name](spark, sf)
    cols = sorted(df.columns)
    rows = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    sql = registry.oracle_sql().get(name)
    if sql is None:
        return
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    want = sorted(tuple(plain(x[names.index(c)]) for c in cols) for x in found.fetchall())
    assert rows == want
