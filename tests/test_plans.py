"""Plans stay the ones wanted: pruned scans, pushed filters, no products of tables."""

import pytest

import __spark_entry__ as entry
from listenloom import runtime
from listenloom.operators import features
from listenloom.operators.usable import usable_plays

DATA = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_read_what_is_used(spark):
    plays = spark.read.parquet(f"{DATA}/plays.parquet")
    plan = _plan(usable_plays(plays).select("play_id", "user_id", "ts"))
    assert "ReadSchema: struct<play_id:bigint,user_id:string,ts:bigint,artist:string,track:string>" in plan
    assert "GreaterThan(ts,0)" in plan and "IsNotNull(user_id)" in plan


@pytest.mark.parametrize("name", ["vocab", "sessionize", "cooccurrence", "itemknn_topk", "eval_popularity", "drift_timeline", "session_stats"])
def test_no_products_of_tables(spark, name):
    assert "CartesianProduct" not in _plan(entry.queries()[name](spark, DATA))


def test_intermediates_can_be_cleared(spark):
    kept = runtime.materialize(spark.range(3), "x")
    assert kept.count() == 3 and runtime.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    path = kept.inputFiles()[0]
    fs, p = runtime.hadoop_fs(spark, path)
    assert fs.exists(p)
    runtime.clear_intermediates(spark)
    assert not fs.exists(p)


def test_windows_spelled_out_are_not_broadcast(spark):
    """Windows of 100 users make 0.8 million rows, which Spark takes for a few kB."""
    seqs = spark.range(100 * 2000).selectExpr("cast(id % 100 as string) as user_id", "id div 100 as pos", "id % 7 as item_id")
    rows = features.supervised(seqs, features.train_windows(seqs, 80, 20))
    assert len(rows.toPandas()) > 700_000
    assert "BroadcastHashJoin" not in _plan(rows)
