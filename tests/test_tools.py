import json

import pytest
from pyspark.sql import functions as F

import cli
from listenloom.model import scoring, train
from listenloom.model.encoder import Shape, new_weights
from listenloom.operators import features, insights
from listenloom.operators.evaluation import popularity_ranks
from listenloom.operators.harness import Popularity, Scorer, evaluate
from listenloom.runtime import broadcast_small, discard, fresh_path, hadoop_fs, intermediates, materialize
from listenloom.sources.tags import TagCache, fetch_tags, tags_of


def test_tags_of_replies(spark):
    many = json.dumps({"toptags": {"tag": [{"name": " Dub ", "count": 100}, {"name": "", "count": 9}, {"name": "slow", "count": "7"}, {"name": "odd", "count": "x"}, {"name": "rare", "count": 0}]}})
    one = json.dumps({"toptags": {"tag": {"name": "Surf", "count": 3}}})
    df = spark.createDataFrame([(1, many), (2, one), (3, "{"), (4, None), (5, "{}")], "i int, reply string")
    assert {r.i: r.t for r in df.select("i", tags_of(F.col("reply")).alias("t")).collect()} == {1: ["dub", "slow"], 2: ["surf"], 3: [], 4: [], 5: []}
    assert df.where("i = 1").select(tags_of(F.col("reply"), 8).alias("t")).first().t == ["dub"]


def test_fetching_goes_on_where_it_stopped(spark):
    cache = TagCache(spark, fresh_path(spark, "tags"))
    items = spark.createDataFrame([(k,) for k in ("a", "b", "c", "bad", "", "a")], "key string")

    def ask(key):
        if key == "bad":
            raise OSError("down")
        return json.dumps({"toptags": {"tag": [{"name": key, "count": 5}]}}) if key != "c" else None

    assert {r.key: r.tags for r in fetch_tags(items, cache, ask, rate=1000, step=2, limit=2).collect()} == {"a": ["a"], "b": ["b"]}
    assert {r.key: r.tags for r in fetch_tags(items, cache, ask, rate=1000).collect()} == {"a": ["a"], "b": ["b"], "c": []}


def test_strings_for_numbers(spark):
    v = spark.createDataFrame([(2, "a :: x", "A", "X"), (3, "b :: y :: z", None, None)], "item_id bigint, item_key string, artist string, track string")
    tags = spark.createDataFrame([("a :: x", ["dub"])], "item_key string, tags array<string>")
    assert {r.item_id: r.text for r in features.vocab_strings(v, tags).collect()} == {0: "", 1: "", 2: "X by A. Genre: dub", 3: "y :: z by b"}
    items = features.vocab_strings(v)
    folder = fresh_path(spark, "vectors")
    first = {r.item_id: r.vec for r in scoring.cached_embeddings(items, "text", folder, 16).collect()}
    assert {r.item_id: r.vec for r in scoring.cached_embeddings(items, "text", folder, 16).collect()} == first and not any(first[0])
    assert len(hadoop_fs(spark, folder)[0].listStatus(hadoop_fs(spark, folder)[1])) == 1


def test_settings_and_validation(tmp_path):
    (tmp_path / "c.json").write_text('{"epochs": 2, "loss": "bpr"}')
    assert train.Config.read(str(tmp_path / "c.json")) == train.Config(epochs=2, loss="bpr")
    with pytest.raises(ValueError, match="speed"):
        train.Config.of({"speed": 1})
    import numpy as np

    seqs = [(np.array([2, 3, 4, 5]), np.arange(4)), (np.array([2, 3, 4, 1]), np.arange(4)), (np.array([2, 3]), np.arange(2))]
    shorter, asked = train.held_out(seqs)
    assert [len(s[0]) for s in shorter] == [3, 4, 2] and [a[2] for a in asked] == [5]
    shape = Shape(n_items=12, dim=8, heads=2, blocks=1, max_len=6)
    w = new_weights(shape)
    w["bias"][5] = 1e6
    assert train.ndcg_validator(shape, asked)(w) == pytest.approx(1.0)
    w["bias"][5] = -1e6
    assert train.ndcg_validator(shape, asked, 5)(w) == 0.0


def test_one_protocol_for_every_scorer(spark):
    instances = spark.createDataFrame([("a", 2, True, False, False), ("b", 3, True, False, False), ("c", 9, False, False, True)], "instance_id string, target bigint, is_repeat boolean, is_cold_user boolean, is_cold_item boolean")
    counts = spark.createDataFrame([(2, 5), (3, 5), (4, 1)], "item_id bigint, cnt bigint")
    assert {r.instance_id: r["rank"] for r in popularity_ranks(instances, counts, 10).collect()} == {"a": 1, "b": 1, "c": 9}
    assert {r.instance_id: r["rank"] for r in popularity_ranks(instances, counts, 10, True).collect()} == {"a": 0, "b": 0, "c": 3}
    assert isinstance(Popularity(counts), Scorer)
    got = evaluate([Popularity(counts), Popularity(counts, True, "hopeful")], instances, None, 10, (5,))
    assert {r.model: r.hr_5 for r in got.where("slice = 'overall'").collect()} == {"popularity": pytest.approx(2 / 3, abs=1e-6), "hopeful": 1.0}
    with pytest.raises(TypeError):
        evaluate([object()], instances, None, 10)


def test_signals_reach_sessions_and_clusters(spark):
    sessions = spark.createDataFrame([(1, 0), (2, 0), (3, 1)], "session_id bigint, cluster int")
    signals = insights.session_signals(spark.createDataFrame([(1, 60_000, True, None), (1, 120_000, False, None), (3, None, None, True)], "session_id bigint, ms_played bigint, skipped boolean, shuffle boolean"))
    both = insights.with_signals(sessions, signals)
    assert {r.session_id: (r.mean_seconds, r.skip_rate, r.shuffle_rate) for r in both.collect()} == {1: (90.0, 0.5, None), 2: (None, None, None), 3: (None, None, 1.0)}
    assert {r.cluster: (r.mean_seconds, r.shuffle_rate) for r in insights.signal_profile(both).collect()} == {0: (90.0, None), 1: (None, 1.0)}


def test_what_is_written_goes_away(spark):
    there = lambda df: hadoop_fs(spark, df._written_to)[0].exists(hadoop_fs(spark, df._written_to)[1])
    with intermediates(spark):
        a, b = materialize(spark.range(2), "a"), materialize(spark.range(2), "b")
        discard(a, spark.range(1))
        assert not there(a) and there(b)
    assert not there(b)
    assert "ResolvedHint" not in broadcast_small(spark.range(5), 3)._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" in broadcast_small(spark.range(3), 3)._jdf.queryExecution().analyzed().toString()


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    cli.main(["list"])
    assert "p7_found" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        cli.main(["run", "nothing", "--data", "x", "--out", "y"])
    monkeypatch.setattr(cli, "_session", lambda _: spark)
    cli.main(["run", "tag_lookup", "--data", "/root/testdata/sf0.001", "--out", f"file://{tmp_path}"])
    assert spark.read.parquet(f"file://{tmp_path}/tag_lookup").count() > 0
    spark.createDataFrame([(1, "u", 5)], "play_id bigint, user_id string, ts bigint").write.parquet(f"file://{tmp_path}/events")
    cli.main(["sessions", "--table", f"file://{tmp_path}/table", "--events", f"file://{tmp_path}/events"])
    assert "version 1" in capsys.readouterr().out
