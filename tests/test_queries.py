"""Every registered core query gives the rows of its SQL, and leaves extra columns alone."""

import duckdb
import pytest

from compare import plain
from wardenlake.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    from pathlib import Path

    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = con.execute(ORACLES[name])
    theirs = [c[0] for c in got.description]
    assert sorted(theirs) == cols
    sql = sorted(tuple(plain(r[theirs.index(c)]) for c in cols) for r in got.fetchall())
    assert sorted(tuple(plain(r[c]) for c in cols) for r in df.collect()) == sql


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
