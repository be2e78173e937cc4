"""Every registered query of the engine against its SQL."""

import os

import duckdb
import pytest

from quarrystone.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def canonical(v):
    return f"{v:.9g}" if isinstance(v, float) else repr(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in os.listdir(SF):
        if f.endswith(".parquet"):
            c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, SF)
    rows = got.collect()
    if name not in ORACLES:
        assert rows
        return
    made = con.execute(ORACLES[name])
    names = [c[0] for c in made.description]
    assert sorted(names) == sorted(got.columns)
    want = sorted([canonical(r[names.index(c)]) for c in sorted(names)] for r in made.fetchall())
    assert sorted([canonical(r[c]) for c in sorted(names)] for r in rows) == want


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(1).count() == 1 and set(e.oracle_sql()) <= set(e.queries())
