import duckdb
import pytest

from compare import plain
from wardenlake.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
COLUMNS = {"p1_found": ["seq", "lang"], "p2_found": ["tbl", "seq", "pii_type", "start_pos"], "p4_found": ["tbl", "seq_a", "seq_b"], "p5_found": ["seq", "defect"], "p6_ids": ["doc_id", "ids"], "p8_found": ["doc_id", "grade"]}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    con.execute(f"CREATE VIEW perf AS SELECT * FROM '{SF}/perf.parquet'")
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = con.execute(ORACLES[name])
    theirs = [c[0] for c in got.description]
    sql = sorted(tuple(plain(r[theirs.index(c)]) for c in cols) for r in got.fetchall())
    assert sorted(tuple(plain(r[c]) for c in cols) for r in df.collect()) == sql


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.columns == COLUMNS[name] and df.count() > 0
