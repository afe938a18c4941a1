"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from tidewheel.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(v):
    if hasattr(v, "item"):
        v = v.item()
    return round(v, 6) if isinstance(v, float) else str(v) if not isinstance(v, (int, bool, type(None))) else v


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", catalog.queries())
def test_query(spark, duck, name):
    got = catalog.queries()[name](spark, DATA)
    columns = sorted(got.columns)
    rows = [tuple(plain(v) for v in r) for r in got.select(*columns).collect()]
    if name in catalog.oracle_sql():
        want = duck.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({catalog.oracle_sql()[name]})").fetchall()
        assert sorted(map(str, rows)) == sorted(str(tuple(plain(v) for v in r)) for r in want)
    else:
        assert rows
