"""Every query that has SQL returns what the SQL returns, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from netquill.plans import catalog

DATA = Path("/root/testdata/sf0.001")
TABLES = "events documents pages".split()


def plain(value):
    return round(value, 9) if isinstance(value, float) else value


@pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query(spark, name):
    df = catalog.QUERIES[name](spark, str(DATA))
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    found = con.sql(catalog.SQL[name])
    at = [found.columns.index(c) for c in columns]
    assert sorted(found.columns) == columns
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=str)
