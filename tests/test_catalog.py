"""Every catalogued query against the same SQL in DuckDB."""

import collections
import glob
import os

import pytest

duckdb = pytest.importorskip("duckdb")

from tessella.plans import catalog  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def same(x):
    return round(x, 6) if isinstance(x, float) else x


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_sql(spark, db, name):
    df = catalog.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = collections.Counter(tuple(same(v) for v in r) for r in df.select(*[f"`{n}`" for n in names]).collect())
    c = db.execute(f"SELECT {', '.join(chr(34) + n + chr(34) for n in names)} FROM ({catalog.SQL[name]})")
    want = collections.Counter(tuple(same(v) for v in r) for r in c.fetchall())
    assert got == want
    assert sum(got.values()) > 0
