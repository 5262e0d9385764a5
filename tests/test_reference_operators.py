import json
import math
import zipfile

import duckdb
import pytest
from pyspark.sql import functions as F

from listenloom.functions.canonical import normalised, normalised_text, sql_normalised
from listenloom.functions.time import display_stamp, gap_bucket, to_unix_seconds, window_number
from listenloom.operators import evaluation as E
from listenloom.operators import features, insights, report
from listenloom.operators.splits import assert_no_leakage, temporal_split
from listenloom.operators.vocab import build_vocab, coverage, encode, positives
from listenloom.schema import ConformError, conform, empty, validate, validate_report
from listenloom.sources import delimited, exports, requests, synthetic, tables

TITLES = ["Kettle", "Kettle (ft. Ana & the Lamps)", "kettle [With Ana]", "KETTLE - Featuring Ana", "Kettle (Explicit)", "Kettle [1999 Remastered]", "Kettle - 2004 Re-Master", "Kettle - Mono Version 1967", "Kettle - 1999 - Deluxe Edition", "Kettle (Bonus Track) - Radio Edit (feat. Ana)", "Kettle - Clean - Single Version", "--Kettle ... ", "Kettle (bonustrack) _"]
OTHERS = {"Kettle - Live": "kettle - live", "Kettle (1999)": "kettle (1999)", "Kettle - 1999": "kettle - 1999", "Kettle (Feature)": "kettle (feature)", "With Ana - Kettle": "with ana - kettle", "Remaster Plan": "remaster plan", "Ké  ttle\u00a0[x": "ké ttle [x", "(": "(", "": ""}


def test_normalisation(spark):
    rows = spark.createDataFrame([(t,) for t in [*TITLES, *OTHERS, None]], "t string").select("t", normalised(F.col("t")).alias("k")).collect()
    assert all(r.k == normalised_text(r.t) for r in rows)
    assert {t: normalised_text(t) for t in TITLES} == dict.fromkeys(TITLES, "kettle")
    assert {t: normalised_text(t) for t in OTHERS} == OTHERS
    sql = duckdb.connect().execute(f"SELECT t, {sql_normalised('t')} FROM (SELECT unnest(?) AS t)", [[*TITLES, *OTHERS]]).fetchall()
    assert all(k == normalised_text(t) for t, k in sql)
    assert normalised_text("Grüße ＡＢ") == "grüsse ab"


def test_vocabulary(spark):
    rows = [("u", i, i, "A", "x", "a :: x") for i in range(5)] + [("u", 9, 9, "B", "y", "b :: y")] * 2
    df = spark.createDataFrame(rows, "user_id string, ts bigint, seq bigint, artist string, track string, item_key string")
    v = build_vocab(df, 5)
    assert [(r.item_id, r.item_key, r.cnt) for r in v.collect()] == [(2, "a :: x", 5)]
    assert {r.item_key: r.item_id for r in encode(df, v).collect()} == {"a :: x": 2, "b :: y": 1}
    asked = spark.createDataFrame([("a :: x",), ("z :: q",)], "item_key string")
    assert coverage(asked, v).first().coverage == 0.5 and coverage(asked.limit(0), v).first().coverage == 0.0


def test_gap_buckets(spark):
    df = spark.createDataFrame([(None,), (0,), (1,), (3599,), (3600,), (31536000,), (-5,)], "g bigint")
    assert [r.b for r in df.select(gap_bucket(F.col("g")).alias("b")).collect()] == [1, 2, 3, 11, 12, 23, 2]


def test_times(spark):
    df = spark.createDataFrame([("2009-05-04T23:08:57Z",), ("1970-01-01T00:00:01Z",), ("not a date",)], "t string")
    assert [r.s for r in df.select(to_unix_seconds(F.col("t")).alias("s")).collect()] == [1241478537, 1, None]
    assert spark.range(1).select(window_number(F.lit(-1), F.lit(0), 1).alias("w")).first().w == -1


def test_stamps_are_shown_in_utc(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        rows = spark.createDataFrame([(1298962800,), (0,), (None,), (1300000000,)], "t bigint").select(display_stamp(F.col("t")).alias("s")).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert [r.s for r in rows] == ["2011-03-01 07:00:00+00:00", "1970-01-01 00:00:00+00:00", None, "2011-03-13 07:06:40+00:00"]


def test_conform_and_validate(spark):
    raw = spark.createDataFrame([("u", "5", "A", "x", "bad"), ("u", "x", "A", "x", "1"), ("u", "7", "A", "y", "30000")], "user_id string, ts string, artist string, track string, ms_played string")
    got = conform(raw, "src")
    assert [(r.ts, r.ms_played, r.source) for r in got.collect()] == [(5, None, "src"), (7, 30000, "src")]
    with pytest.raises(ConformError):
        conform(raw.withColumn("track", F.lit(None).cast("string")))
    with pytest.raises(ConformError):
        conform(raw.drop("artist"))
    assert positives(got).count() == 2 and empty(spark).count() == 0
    late = spark.createDataFrame([("u", 5, "A", "x", 0), ("u", 3, "A", "x", 1)], "user_id string, ts bigint, artist string, track string, seq int")
    assert validate_report(late, "seq").first().n_out_of_order == 1
    with pytest.raises(ConformError):
        validate(late, "seq")


def test_split(spark):
    df = spark.createDataFrame([(f"u{i % 10}", 100 + i) for i in range(100)], "user_id string, ts bigint")
    s = temporal_split(df, 0.2, 0.2)
    assert s.cutoff == 179 and s.holdout.count() == 2
    assert_no_leakage(s)
    assert s.train.join(s.holdout, "user_id", "left_semi").count() == 0
    for bad in (0, 1, -1):
        with pytest.raises(ValueError):
            temporal_split(df, bad)
    with pytest.raises(ValueError):
        temporal_split(df.where("user_id = 'u1'"), 0.2, 0.9)


SEQ = "user_id string, pos bigint, ts bigint, seq bigint, item_id bigint, session_no bigint, gap_s bigint, session_id bigint"


def test_cooccurrence_and_knn(spark):
    seqs = spark.createDataFrame([("u", p, 10 * p, p, p + 2, 0, 10, 1) for p in range(3)], SEQ)
    co = {(r.i, r.j): r.n for r in E.cooccurrence(seqs).collect()}
    assert co == {(i, j): 1 for i in (2, 3, 4) for j in (2, 3, 4) if i != j}
    sim = E.similarity(E.cooccurrence(seqs))
    assert {r.sim for r in sim.collect()} == {0.5}
    asked = spark.createDataFrame([("q", "u", 2)], "instance_id string, user_id string, pos bigint")
    scores = {r.item_id: r.score for r in E.knn_scores(asked, seqs, sim).collect()}
    assert scores == {4: pytest.approx(0.958502, abs=1e-6), 2: 0.5, 3: pytest.approx(0.458502, abs=1e-6)}
    instance = spark.createDataFrame([("q", "u", 2, 4)], "instance_id string, user_id string, pos bigint, target bigint")
    assert E.knn_ranks(instance, seqs, sim, 3).first()["rank"] == 0


def test_repeat_scores(spark):
    seqs = spark.createDataFrame([("u", 0, 1, 0, 2, 0, None, 1), ("u", 1, 3601, 1, 3, 1, 3600, 2)], SEQ)
    asked = spark.createDataFrame([("q", "u", 2, 3)], "instance_id string, user_id string, pos bigint, target bigint")
    none = spark.createDataFrame([], "item_id bigint, cnt bigint")
    got = {r.item_id: r.score for r in E.repeat_scores(asked, seqs, none).collect()}
    assert got == {2: pytest.approx(0.995883, abs=1e-6), 3: 1.5}


def test_metrics(spark):
    ranked = spark.createDataFrame([(3, True, False, False), (0, False, True, True)], "rank bigint, is_repeat boolean, is_cold_user boolean, is_cold_item boolean")
    by = {r.slice: r for r in E.sliced_metrics(ranked, "m", (5,)).collect()}
    assert set(by) == set(E.SLICES) and by["overall"].n == 2
    assert (by["repeat"].hr_5, by["repeat"].ndcg_5, by["repeat"].mrr_5) == (1.0, pytest.approx(1 / math.log2(5), abs=1e-8), 0.25)
    text = report.markdown(E.sliced_metrics(ranked, "m", (10,)))
    assert "| overall | 2 |" in text and report.chance_level(10, 100) == 0.1


def test_drift(spark):
    vectors = insights.item_vectors(spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 2.0])], "vec_id bigint, embedding array<float>"))
    day = 86_400
    rows = [("u", 100 + i, 2) for i in range(20)] + [("u", 100 + day + i, 3) for i in range(2)] + [("u", 100 + 2 * day + i, 3) for i in range(20)] + [("u", 100 + 2 * day + 50 + i, 1) for i in range(30)]
    seqs = spark.createDataFrame(rows, "user_id string, ts bigint, item_id bigint")
    a, b, c = insights.drift_timeline(seqs, vectors, 1, 10).orderBy("window").collect()
    assert (a.step, a.displacement, a.sparse, a.top_items) == (None, 0.0, False, ["2"])
    assert (b.step, b.displacement, b.sparse, b.since_previous) == (None, None, True, None)
    assert (c.step, c.displacement, c.since_previous, c.n_events, c.n_unique) == (1.0, 1.0, 2, 50, 1)


def test_windows(spark):
    seqs = spark.createDataFrame([("u", p, p + 2) for p in range(10)] + [("v", 0, 2), ("v", 1, 2)], "user_id string, pos bigint, item_id bigint")
    got = sorted((r.window_end, r.window_start) for r in features.train_windows(seqs, 4, 3).collect())
    assert got == [(3, 0), (6, 2), (9, 5)]


def test_sentences(spark):
    df = spark.createDataFrame([(" A ", "x", ["", "rock", None, "b", "c", "d"]), (None, "y", None)], "artist string, track string, tags array<string>")
    got = [r.s for r in df.select(features.item_sentence(F.col("artist"), F.col("track"), F.col("tags")).alias("s")).collect()]
    assert got == ["x by A. Genre: rock, b, c", "y by "]


STAMPS = ("2011-03-01T07:00:00Z", "2011-03-01T07:04:10Z", "2011-03-01T07:04:10Z", "2012-12-24T18:30:00Z")
NAMES = (("m1", "Ana", "n1", "Kettle"), ("", "The Lamps", "", "Harbour"), ("m2", "Ana", "n2", 'Rust "demo"'), ("m3", "Lumil", "n3", "Oh, Window"))
LOG = "".join("\t".join((user, t, *names)) + "\n" for user, t, names in zip(("listener-a",) * 3 + ("listener-b",), STAMPS, NAMES))


def test_play_log(spark, tmp_path):
    (tmp_path / "log.tsv").write_text(LOG + "too\tmany\tfields\ta\tb\tc\td\n")
    df = delimited.read_play_log(spark, str(tmp_path / "log.tsv"))
    rows = df.orderBy("user_id", "ts", "seq").collect()
    assert len(rows) == 4 and rows[0].ts == 1298962800 and rows[2].track == 'Rust "demo"' and {r.ms_played for r in rows} == {None}
    assert delimited.read_play_log(spark, str(tmp_path / "log.tsv"), users=1).count() == 3
    assert delimited.read_play_log(spark, str(tmp_path / "log.tsv"), limit=2).count() == 2
    with pytest.raises(FileNotFoundError):
        delimited.read_play_log(spark, str(tmp_path / "none.tsv"))


def test_exports(spark, tmp_path):
    full = [{"ts": "2024-03-19T22:26:38Z", "ms_played": 180000, "master_metadata_track_name": "x", "master_metadata_album_artist_name": "A", "shuffle": True, "skipped": None, "offline": False}, {"ts": "2024-03-19T23:00:00Z", "ms_played": 5, "master_metadata_track_name": None, "episode_name": "pod"}]
    account = [{"endTime": "2024-03-19 22:26", "artistName": "A", "trackName": "x", "msPlayed": 180000}]
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "StreamingHistory0.json").write_text(json.dumps(account))
    got = exports.read_export(spark, str(tmp_path / "a")).collect()
    assert [(r.ts, r.source) for r in got] == [(1710887160 - 180, "spotify-account")]
    (tmp_path / "a" / "endsong_0.json").write_text(json.dumps(full))
    got = exports.read_export(spark, str(tmp_path / "a")).collect()
    assert [(r.ts, r.shuffle, r.source) for r in got] == [(1710887198, True, "spotify-extended")]
    with zipfile.ZipFile(tmp_path / "up.zip", "w") as z:
        z.writestr("../../MyData/endsong_0.json", json.dumps(full))
        z.writestr("ReadMe.pdf", "x")
    history = exports.read_upload(spark, str(tmp_path / "up.zip"), str(tmp_path / "w"))
    assert [tuple(r) for r in history.collect()] == [("A", "x", 1710887198)]
    (tmp_path / "zips").mkdir()
    for user, members in (("ana", {"x/endsong_0.json": full, "StreamingHistory0.json": account}), ("lumil", {"StreamingHistory0.json": account})):
        with zipfile.ZipFile(tmp_path / "zips" / f"{user}.zip", "w") as z:
            for name, body in members.items():
                z.writestr(name, json.dumps(body))
    (tmp_path / "zips" / "broken.zip").write_text("x")
    got = exports.read_archives(spark, str(tmp_path / "zips")).collect()
    assert sorted((r.user_id, r.ts, r.source) for r in got) == [("ana", 1710887198, "spotify-extended"), ("lumil", 1710887160 - 180, "spotify-account")]
    (tmp_path / "endsong_9.json").write_text('{"no": "array"}')
    for bad in ("endsong_9.json", "nothing.txt"):
        (tmp_path / "nothing.txt").write_text("x")
        with pytest.raises(exports.ExportError):
            exports.read_upload(spark, str(tmp_path / bad), str(tmp_path / "w2"))
    with pytest.raises(FileNotFoundError):
        exports.read_export(spark, str(tmp_path / "w3"))


def test_requests_and_cache(spark, tmp_path):
    assert requests.request_histories(spark, [[("A", "x", 1)]]).count() == 1
    for bad in ([], [[("A", "", 1)]], [[("A", "x", 0)]]):
        with pytest.raises(ValueError):
            requests.request_histories(spark, bad)
    v = spark.createDataFrame([(i, "k", 1, "A", f"t{i}") for i in range(2, 30)], "item_id bigint, item_key string, cnt bigint, artist string, track string")
    ts = [r.ts for r in requests.sample_history(v, 8).orderBy("ts").collect()]
    assert [b - a for a, b in zip(ts, ts[1:])] == [210] * 5 + [9000, 210] and ts[-1] == 1_700_000_000
    assert requests.random_histories(spark, 100, 3, 5).count() == 15
    built = []

    def build():
        built.append(1)
        return v

    for force in (False, False, True):
        assert tables.cached_dataset(spark, f"file://{tmp_path}/c", "corpus", build, force=force).count() == 28
    assert len(built) == 2


def test_synthetic(spark):
    w = synthetic.World(users=8, months=6, artists=60, seed=1)
    events, items, tastes = synthetic.generate(spark, w)
    rows = sorted(events.collect(), key=lambda r: (r.user_id, r.ts))
    assert len(rows) > 1000 and tastes.count() == 48 and items.count() == 480
    assert all(sum(x * x for x in r.taste) == pytest.approx(1) for r in tastes.collect())
    assert sorted(map(str, synthetic.generate(spark, w)[0].repartition(3).collect())) == sorted(map(str, rows))
    assert len({(r.artist, r.track) for r in items.collect()}) == 480
    out = {(r.artist, r.track): r.release_ts for r in items.collect()}
    assert 0.1 < sum(t > w.start for t in out.values()) / 480 and all(r.ts >= out[r.artist, r.track] for r in rows)
    seen, repeats, counts, sittings = set(), 0, {}, 1
    for before, r in zip([None, *rows], rows):
        key = (r.user_id, r.artist, r.track)
        repeats += key in seen
        seen.add(key)
        counts[key[1:]] = counts.get(key[1:], 0) + 1
        sittings += before is not None and (before.user_id != r.user_id or r.ts - before.ts > 1800)
    assert 0.4 < repeats / len(rows) < 0.97 and sum(n >= 5 for n in counts.values()) > 100
    assert 0.4 < sum(r.ms_played >= 30_000 for r in rows) / len(rows) < 0.95
    assert sittings > 10 and len(rows) / sittings > 2


def test_order_is_checked_over_slices(spark):
    rows = [("u", 10, 1), ("u", 20, 2), ("u", 15, 40), ("u", None, 41), ("u", 5, 60), ("v", 1, 3), ("v", 9, 61), ("u", 4, 99), (None, 3, 100)]
    df = spark.createDataFrame([(u, t, "A", "x", s) for u, t, s in rows], "user_id string, ts bigint, artist string, track string, seq bigint")
    for slices in (1, 7, 1000):
        assert validate_report(df, "seq", slices).first().asDict() == {"n_rows": 9, "n_null": 2, "n_not_positive": 0, "n_out_of_order": 2}


def test_requests_are_encoded_and_answered(spark):
    from listenloom.operators import serving

    words = spark.createDataFrame([(2, "a :: x", 3, "A", "x"), (3, "a :: y", 2, "A", "y"), (4, "b :: z", 1, "B", "z")], "item_id bigint, item_key string, cnt bigint, artist string, track string")
    sim = spark.createDataFrame([(2, 3, 0.9), (3, 2, 0.9), (2, 4, 0.5)], "i bigint, j bigint, sim double")
    asked = requests.request_histories(spark, [[("A", "x (Remastered)", 5), ("Q", "q", 3), ("A", "y", 1)], [("Q", "q", 1)]])
    got, context = serving.recommend_histories(asked, words, sim, 5)
    assert [(r.item_id, r.is_repeat) for r in got.orderBy("instance_id", "place").collect()] == [(3, True), (2, True), (4, False)]
    assert [(r.instance_id, r.history_length, r.matched, r.cold_start) for r in context.orderBy("instance_id").collect()] == [("0", 3, 2, False), ("1", 1, 0, True)]
    new, _ = serving.recommend_histories(asked, words, sim, 5, discover=True)
    assert [r.item_id for r in new.collect()] == [4]


def test_kinds(spark):
    import random

    from listenloom.operators import archetypes

    r = random.Random(0)
    rows = [(i, [float(i % 3 == k) * 5 + r.random() for k in range(3)]) for i in range(90)] + [(99, None)]
    df = spark.createDataFrame(rows, "session_id bigint, vectors array<float>")
    model, scores = archetypes.choose_kinds(df, (2, 5))
    assert max(scores, key=scores.get) == 3
    placed = {x.session_id: x.cluster for x in archetypes.assign_kinds(df, model).collect()}
    assert len(placed) == 90 and len({(i % 3, c) for i, c in placed.items()}) == 3


def test_small_helpers(spark, tmp_path):
    from listenloom.functions.latency import LatencyWindow
    from listenloom.model.encoder import Shape, new_weights, untouched_residuals
    from listenloom.model.scoring import trace_points
    from listenloom.operators.archetypes import kinds_summary
    from listenloom.operators.vocab import vocab_differences

    a = spark.createDataFrame([(2, "x"), (3, "y")], "item_id bigint, item_key string")
    b = spark.createDataFrame([(2, "x"), (3, "z"), (4, "y")], "item_id bigint, item_key string")
    assert vocab_differences(a, a) == 0 and vocab_differences(a, b) == 2
    window = LatencyWindow(3)
    assert window.snapshot()["p50"] is None
    for ms in (100, 1, 2, 3):
        window.record(ms)
    assert window.snapshot() == {"total": 4, "kept": 3, "p50": 2.0, "p95": pytest.approx(2.9), "p99": pytest.approx(2.98), "max": 3.0, "mean": 2.0}
    with window.timed():
        pass
    window.reset()
    assert window.snapshot()["total"] == 0
    w = new_weights(Shape(n_items=5, dim=4, items="hybrid", text_dim=3), __import__("numpy").zeros((5, 3)))
    assert untouched_residuals(w) == 3
    instances = spark.createDataFrame([(f"{u}:{i}", u) for u in "abc" for i in range(9)], "instance_id string, user_id string")
    assert trace_points(instances, 2, 4).count() == 8
    r = kinds_summary(a, 9, {3: 0.1, 4: 0.5}).first()
    assert (r.k, r.clustered_sessions, r.total_sessions, r.silhouette) == (4, 2, 9, {3: 0.1, 4: 0.5})
    assert report.notes(1, 20) and not report.notes(2, 20)
    report.write_insights(str(tmp_path / "i"), a, b, a)
    report.write(E.sliced_metrics(spark.createDataFrame([(0, True, False, False)], "rank bigint, is_repeat boolean, is_cold_user boolean, is_cold_item boolean"), "m"), str(tmp_path / "r"), {"seed": 0})
    assert "| 3 | z |" in (tmp_path / "i" / "insights.md").read_text() and (tmp_path / "r" / "results.csv").exists()
