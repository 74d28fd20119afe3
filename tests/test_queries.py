"""Every query against its SQL on the given tables."""

import os

import duckdb
import pytest

from folioscope.plans.registry import ORACLE_SQL, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    rows = sorted(map(tuple, got.select(*cols).collect()), key=repr)
    if name not in ORACLE_SQL:
        assert got.columns
        return
    rel = duck.sql(f"select {', '.join(cols)} from ({ORACLE_SQL[name]})")
    assert sorted(rel.columns) == cols
    wanted = sorted(rel.fetchall(), key=repr)
    assert len(rows) == len(wanted), (len(rows), len(wanted), [r for r in rows if r not in wanted][:3], [r for r in wanted if r not in rows][:3])
    assert rows == wanted
