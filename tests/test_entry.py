import duckdb
import pytest

import __spark_entry__ as entry
from listenloom.plans import catalogue, general

DATA = "/root/testdata/sf0.001"
CHEAP = ["conform_events", "validate_events", "canonical_keys", "vocab", "sessionize", "gap_buckets", "eval_popularity", "eval_repeat", "eval_itemknn", "itemknn_topk", "recommend_discovery", "drift_timeline", "tag_lookup", "lift_labels", "cluster_profile", "p7_found"]


@pytest.mark.parametrize("name", CHEAP)
def test_agrees_with_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("plays", "session_table", "track_catalog", "embeddings", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = entry.queries()[name](spark, DATA)
    cur = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(tuple(map(str, r)) for r in df.collect()) == sorted(tuple(str(r[names.index(c)]) for c in df.columns) for r in cur.fetchall())


def test_flagship_and_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalogue.ORACLES) <= set(catalogue.QUERIES) and set(general.ORACLES) <= set(general.QUERIES)
