"""Every registered query against its SQL, on the smallest tables."""

import datetime
import math
import os

import pytest

from gridproof.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return repr(v)


@pytest.mark.parametrize("key", sorted(catalog.oracle_sql()))
def test_query(spark, sf_dir, duck, key):
    got = catalog.queries()[key](spark, sf_dir)
    want = duck.execute(catalog.oracle_sql()[key])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    rows = sorted(tuple(plain(r[c]) for c in names) for r in got.collect())
    assert rows == sorted(tuple(plain(v) for v in r) for r in want.fetchall())


@pytest.mark.parametrize("key", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_rows(spark, sf_dir, key):
    assert catalog.queries()[key](spark, sf_dir).count() > 0
