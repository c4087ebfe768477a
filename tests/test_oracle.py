"""Every query of the catalogue against its SQL on the smallest tables."""

import os

import pytest

from sparkloom.plans import catalogue

duckdb = pytest.importorskip("duckdb")
DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(DIR):
        pytest.skip("no tables")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, con, name):
    df = catalogue.QUERIES[name](spark, DIR)
    rows = [tuple(r) for r in df.select(*sorted(df.columns)).collect()]
    if name not in catalogue.ORACLE_SQL:
        return
    cur = con.execute(catalogue.ORACLE_SQL[name])
    names = [x[0] for x in cur.description]
    want = [tuple(r[names.index(c)] for c in sorted(names)) for r in cur.fetchall()]
    assert sorted(names) == sorted(df.columns)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(rows, key=key) == sorted(want, key=key)
