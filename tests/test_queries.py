"""Every registered query with SQL gives the rows that the SQL gives."""

import math

import duckdb
import pytest

from veristrata.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    found = duckdb.connect()
    for t in TABLES:
        found.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return found


def _plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    return x


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query(spark, con, name):
    frame = registry.QUERIES[name](spark, SF)
    names = sorted(frame.columns)
    got = sorted((tuple(_plain(r[c]) for c in names) for r in frame.collect()), key=repr)
    cursor = con.execute(registry.ORACLES[name])
    columns = [c[0] for c in cursor.description]
    want = sorted((tuple(_plain(dict(zip(columns, r))[c]) for c in names) for r in cursor.fetchall()), key=repr)
    assert sorted(columns) == names
    assert got == want


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
