import duckdb
import pytest

from listenloom.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_runs_and_agrees_with_its_sql(spark, name):
    df = queries.QUERIES[name](spark, DATA)
    rows = [tuple(map(str, r)) for r in df.collect()]
    assert len(df.columns) == len(set(df.columns))
    if name in queries.ORACLES:
        con = duckdb.connect()
        for t in ("plays", "session_table"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
        cur = con.execute(queries.ORACLES[name])
        names = [d[0] for d in cur.description]
        assert sorted(rows) == sorted(tuple(str(r[names.index(c)]) for c in df.columns) for r in cur.fetchall())
