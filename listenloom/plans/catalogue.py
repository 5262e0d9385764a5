"""The reference operators as queries over the play table and its companions, with SQL for each.

The SQL is written without regard to the way the engine goes: ranks count over all
items, sessions over one running sum, pairs over a join of positions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from listenloom.functions.canonical import SEPARATOR, normalised, sql_normalised, with_item_key
from listenloom.functions.time import GAP_EDGES, display_stamp, gap_bucket
from listenloom.operators import evaluation as E
from listenloom.model import encoder, scoring, train
from listenloom.operators import archetypes, features, insights, serving
from listenloom.operators.harness import ItemKnn, Popularity, Repeat, evaluate
from listenloom.operators.ordered import grouped_quantiles, histories, in_sequence, sessionized
from listenloom.operators.splits import Split, leakage_report, split_summary, temporal_split
from listenloom.operators.vocab import build_vocab, coverage, encode, long_enough, positives, train_counts
from listenloom.runtime import materialize
from listenloom.schema import conform, validate_report

MIN_COUNT, MIN_LEN, PER_USER, TEST, HOLDOUT = 3, 5, 20, 0.15, 0.10
WINDOW_DAYS, MIN_EVENTS = 90, 10


# stages --------------------------------------------------------------------------------
def events(spark: SparkSession, d: str) -> DataFrame:
    """Canonical events of the play table, each delivered play once, with ``seq`` for ties."""
    plays = spark.read.parquet(f"{d}/plays.parquet").withColumn("seq", F.col("play_id"))
    return conform(plays.drop("ingested_at", "play_id"), None, keep=("seq",), guard=None).distinct()


def keyed(spark: SparkSession, d: str) -> DataFrame:
    return materialize(with_item_key(positives(events(spark, d)), unicode=False), "keyed")


def encoded_rows(spark: SparkSession, d: str, rows: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Encoded events of users that have enough, and the vocabulary."""
    rows = keyed(spark, d) if rows is None else rows
    vocab = materialize(build_vocab(rows, MIN_COUNT), "vocab")
    return materialize(encode(long_enough(rows, MIN_LEN), vocab).drop("item_key", "artist", "track"), "encoded"), vocab


def positioned(spark: SparkSession, d: str, rows: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Encoded events with their positions and each user's sessions, and the vocabulary."""
    encoded, vocab = encoded_rows(spark, d, rows)
    return materialize(in_sequence(encoded), "positioned"), vocab


def sequences(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Encoded events in sequence with sessions numbered over all users, and the vocabulary."""
    encoded, vocab = encoded_rows(spark, d)
    return sessionized(encoded), vocab


class Experiment:
    """Everything an evaluation needs, made once. Training events are a part of the sequences: a user's first ones, so positions hold."""

    def __init__(self, spark: SparkSession, d: str):
        rows = keyed(spark, d)
        self.seqs, self.vocab = positioned(spark, d, rows)
        self.split = temporal_split(rows, TEST, HOLDOUT)
        past = self.seqs.where(F.col("ts") < self.split.cutoff).join(self.split.holdout, "user_id", "left_anti")
        self.train = materialize(long_enough(past, MIN_LEN), "train")
        self.counts = materialize(train_counts(self.train), "counts")
        self.n_items = self.vocab.count()
        self.instances = materialize(E.eval_instances(self.seqs, self.split.cutoff, self.split.holdout, self.counts, PER_USER), "instances")

    def similar(self) -> DataFrame:
        return materialize(E.nearest_items(E.similarity(E.cooccurrence(self.train))), "similar")


def _split(spark: SparkSession, d: str) -> Split:
    return temporal_split(keyed(spark, d), TEST, HOLDOUT)


# queries -------------------------------------------------------------------------------
def conform_events(spark, d):
    return events(spark, d).select("user_id", "ts", "seq", "artist", "track", "ms_played", "skipped", "shuffle", "offline", "source")


def validate_events(spark, d):
    plays = spark.read.parquet(f"{d}/plays.parquet")
    return validate_report(plays, "play_id")


def positive_events(spark, d):
    return positives(events(spark, d)).groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def corpus_summary(spark, d):
    e = events(spark, d)
    return e.agg(F.count("*").alias("events"), F.countDistinct("user_id").alias("users"), F.countDistinct("artist").alias("artists"), F.countDistinct(F.struct("artist", "track")).alias("tracks"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.bool_or(F.col("ms_played").isNotNull()).alias("has_ms"))


def corpus_span(spark, d):
    """First and last play of each source, as shown to people."""
    return events(spark, d).groupBy("source").agg(F.min("ts").alias("a"), F.max("ts").alias("b")).select("source", display_stamp(F.col("a")).alias("first_play"), display_stamp(F.col("b")).alias("last_play"))


def canonical_keys(spark, d):
    pairs = events(spark, d).select("artist", "track").distinct()
    return with_item_key(pairs, unicode=False).select("artist", "track", "item_key")


def canonical_keys_unicode(spark, d):
    return with_item_key(events(spark, d), unicode=True).groupBy("item_key").agg(F.count("*").alias("n"), F.countDistinct("artist", "track").alias("spellings"))


def vocab(spark, d):
    return build_vocab(keyed(spark, d), MIN_COUNT)


def encoded_events(spark, d):
    rows = keyed(spark, d)
    return encode(rows, build_vocab(rows, MIN_COUNT)).select("user_id", "ts", "seq", "item_id")


def vocab_coverage(spark, d):
    rows = keyed(spark, d)
    return coverage(rows, build_vocab(rows, MIN_COUNT)).select(F.round("coverage", 9).alias("coverage"))


def sessionize(spark, d):
    return sessionized(keyed(spark, d)).select("user_id", "ts", "seq", "pos", "gap_s", "session_id")


def gap_buckets(spark, d):
    return sessionized(keyed(spark, d)).groupBy(gap_bucket(F.col("gap_s")).alias("bucket")).agg(F.count("*").alias("n"))


def session_stats(spark, d):
    return insights.session_behaviour(sequences(spark, d)[0])


def session_signals(spark, d):
    return insights.session_signals(sessionized(keyed(spark, d)))


def session_features(spark, d):
    """Behaviour and signals of the sessions long enough for a vector."""
    seqs = sequences(spark, d)[0]
    return insights.with_signals(insights.session_behaviour(seqs), insights.session_signals(seqs))


def sequence_stats(spark, d):
    by = encoded_rows(spark, d)[0].groupBy("user_id").agg(F.count("*").alias("n"))
    return by.agg(F.count("*").alias("users"), F.sum("n").alias("events"), F.round(F.avg("n"), 9).alias("mean_len"), F.median("n").alias("median_len"))


def repeat_rate(spark, d):
    seqs = encoded_rows(spark, d)[0]
    first = seqs.groupBy("user_id", "item_id").agg(F.count("*").alias("n"))
    return first.agg(F.round((F.sum("n") - F.count("*")) / F.sum("n"), 9).alias("repeat_rate"))


def split_counts(spark, d):
    return split_summary(_split(spark, d))


def leakage_check(spark, d):
    return leakage_report(_split(spark, d))


def eval_instances(spark, d):
    return Experiment(spark, d).instances


def instance_summary(spark, d):
    return E.instance_summary(Experiment(spark, d).instances)


def instance_oov(spark, d):
    x = Experiment(spark, d)
    return E.oov_report(x.seqs, x.split.cutoff, PER_USER)


def history_lengths(spark, d):
    x = Experiment(spark, d)
    past = histories(x.instances, x.seqs, E.MAX_LEN, ["item_id", "ts"])
    return past.groupBy("instance_id").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.sum("item_id").alias("id_sum"))


def train_windows(spark, d):
    return features.train_windows(positioned(spark, d)[0], 20, 10)


def supervised_targets(spark, d):
    seqs, _ = positioned(spark, d)
    return features.supervised(seqs, features.train_windows(seqs, 20, 20)).groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("target") >= 2).alias("n_targets"), F.sum("target").alias("target_sum"))


def eval_popularity(spark, d):
    x = Experiment(spark, d)
    return evaluate([Popularity(x.counts)], x.instances, x.seqs, x.n_items)


def eval_repeat(spark, d):
    x = Experiment(spark, d)
    return evaluate([Repeat(x.counts)], x.instances, x.seqs, x.n_items)


def eval_itemknn(spark, d):
    x = Experiment(spark, d)
    return evaluate([ItemKnn(x.similar())], x.instances, x.seqs, x.n_items)


def eval_all(spark, d):
    """Every sparse scorer under one protocol."""
    x = Experiment(spark, d)
    return evaluate([Popularity(x.counts), Repeat(x.counts), ItemKnn(x.similar())], x.instances, x.seqs, x.n_items)


def optimistic_ranks(spark, d):
    """Ranks that count only items that score higher, of all sparse scorers."""
    x = Experiment(spark, d)
    parts = [s.ranks(x.instances, x.seqs, x.n_items).select(F.lit(s.name).alias("model"), "instance_id", "rank") for s in (Popularity(x.counts, True), Repeat(x.counts, True), ItemKnn(x.similar(), True))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def popularity_ranks(spark, d):
    x = Experiment(spark, d)
    return E.popularity_ranks(x.instances, x.counts, x.n_items).select("instance_id", "target", "rank")


def repeat_ranks(spark, d):
    x = Experiment(spark, d)
    return E.repeat_ranks(x.instances, x.seqs, x.counts, x.n_items).select("instance_id", "target", "rank")


def itemknn_ranks(spark, d):
    x = Experiment(spark, d)
    return E.knn_ranks(x.instances, x.seqs, x.similar(), x.n_items).select("instance_id", "target", "rank")


def cooccurrence(spark, d):
    return E.cooccurrence(positioned(spark, d)[0])


def itemknn_sim(spark, d):
    return E.similarity(E.cooccurrence(positioned(spark, d)[0]))


def itemknn_topk(spark, d):
    return E.nearest_items(E.similarity(E.cooccurrence(positioned(spark, d)[0])), 10)


def _last(seqs: DataFrame) -> DataFrame:
    """One question per user: what comes after the last event."""
    return seqs.groupBy("user_id").agg((F.max("pos") + 1).alias("pos")).withColumn("instance_id", F.col("user_id"))


def _recommended(spark, d, discover: bool) -> DataFrame:
    seqs, words = positioned(spark, d)
    asked = _last(seqs)
    scores = E.knn_scores(asked, seqs, E.nearest_items(E.similarity(E.cooccurrence(seqs))))
    past = histories(asked, seqs, E.MAX_LEN, ["item_id"]) if discover else None
    top = E.recommend(scores, 10, past)
    return top.join(words.select("item_id", "artist", "track"), "item_id").select(F.col("instance_id").alias("user_id"), "place", "item_id", "artist", "track", "score")


def recommend_topk(spark, d):
    return _recommended(spark, d, False)


def recommend_discovery(spark, d):
    return _recommended(spark, d, True)


def recommend_context(spark, d):
    seqs, _ = positioned(spark, d)
    return E.context_report(histories(_last(seqs), seqs, E.MAX_LEN, ["item_id"])).withColumnRenamed("instance_id", "user_id")


def _catalog(spark, d):
    rows = spark.read.parquet(f"{d}/track_catalog.parquet")
    return rows.groupBy("item_index").agg(F.min(F.struct("artist", "track", "genre", "tags")).alias("s")).select("item_index", "s.*")


def item_sentences(spark, d):
    c = _catalog(spark, d)
    return c.select("item_index", features.item_sentence(F.col("artist"), F.col("track"), features.split_tags(F.col("tags"))).alias("sentence"))


def _tagged(spark, d):
    c = _catalog(spark, d)
    items = c.select("item_index", F.concat(normalised(F.col("artist")), F.lit(SEPARATOR), normalised(F.col("track"))).alias("item_key"), normalised(F.col("artist")).alias("artist_key"), F.lower(F.trim("genre")).alias("genre"), features.split_tags(F.col("tags")).alias("own"))
    track = items.groupBy(F.col("item_key").alias("key")).agg(F.min("own").alias("tags"))
    artist = items.where("genre is not null").groupBy(F.col("artist_key").alias("key")).agg(F.array(F.min("genre")).alias("tags"))
    return features.lookup_tags(items.select("item_index", "item_key", "artist_key"), track, artist)


def tag_lookup(spark, d):
    return _tagged(spark, d).select("item_index", F.array_join("tags", "|").alias("tags"))


def tag_coverage(spark, d):
    return features.tag_coverage(_tagged(spark, d))


def _vectors(spark, d):
    return materialize(insights.item_vectors(spark.read.parquet(f"{d}/embeddings.parquet")), "item-vectors")


def drift_timeline(spark, d):
    seqs, words = encoded_rows(spark, d)
    labels = words.select("item_id", F.concat_ws(" - ", "artist", "track").alias("label"))
    return insights.drift_timeline(seqs, _vectors(spark, d), WINDOW_DAYS, MIN_EVENTS, labels=labels).withColumn("top_items", F.array_join("top_items", "|"))


def drift_summary(spark, d):
    return insights.drift_summary(insights.drift_timeline(encoded_rows(spark, d)[0], _vectors(spark, d), WINDOW_DAYS, MIN_EVENTS))


def session_vectors(spark, d):
    made = insights.session_vectors(sequences(spark, d)[0], _vectors(spark, d))
    return made.select("session_id", F.posexplode("vectors").alias("dim", "x")).select("session_id", F.col("dim").cast("int").alias("dim"), F.round("x", 6).alias("x"))


def _grouped(spark, d):
    """Sessions of the session table by a stand-in for clusters: the hour's quarter of the day."""
    rows = spark.read.parquet(f"{d}/session_table.parquet")
    once = rows.groupBy("session_id").agg(F.min(F.struct("user_id", "start_ts", "n_events", "n_unique", "repeat_frac", "median_gap", "hour_utc")).alias("s"), F.max("items").alias("items")).select("session_id", "s.*", "items")
    return once.withColumn("cluster", F.floor(F.col("hour_utc") / 6).cast("int"))


def cluster_profile(spark, d):
    out = insights.cluster_profile(_grouped(spark, d))
    return out.withColumn("hour_histogram", F.array_join(F.transform("hour_histogram", lambda x: x.cast("string")), ","))


def cluster_signals(spark, d):
    """Mean signals of each stand-in cluster, the session table's own signals joined onto its sessions."""
    rows = spark.read.parquet(f"{d}/session_table.parquet")
    signals = rows.groupBy("session_id").agg(F.max("mean_seconds").alias("mean_seconds"), F.max("skip_rate").alias("skip_rate"), F.max("shuffle_rate").alias("shuffle_rate"))
    return insights.signal_profile(insights.with_signals(_grouped(spark, d), signals))


def lift_labels(spark, d):
    plays = _grouped(spark, d).select("cluster", F.explode("items").alias("item")).where("item >= 2").select("cluster", F.col("item").cast("string").alias("label"))
    return insights.lift_labels(plays)


def latency_percentiles(spark, d):
    """Percentiles of the events' values, read as milliseconds."""
    e = spark.read.parquet(f"{d}/events.parquet")
    p = grouped_quantiles(e, "event_type", "value", [0.5, 0.95, 0.99])
    by = p.groupBy("event_type").agg(*[F.round(F.max(F.when(F.col("q") == q, F.col("value"))), 6).alias(c) for q, c in ((0.5, "p50_ms"), (0.95, "p95_ms"), (0.99, "p99_ms"))])
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_ms"), F.max("value").alias("max_ms")).join(by, "event_type")


def kmeans_archetypes(spark, d):
    """Kinds of sessions, profiled; no SQL, as k-means has none."""
    sessions = _grouped(spark, d).drop("cluster").join(spark.read.parquet(f"{d}/session_table.parquet").groupBy("session_id").agg(F.max("vectors").alias("vectors")), "session_id")
    model, _ = archetypes.choose_kinds(sessions)
    return insights.cluster_profile(archetypes.assign_kinds(sessions, model))


def vocab_strings(spark, d):
    """What a text model is shown for each number of the vocabulary."""
    return features.vocab_strings(build_vocab(keyed(spark, d), MIN_COUNT)).select("item_id", "text")


def embed_items(spark, d):
    """Vectors of every catalogue item's sentence, reported."""
    return scoring.embedding_report(scoring.embed_texts(item_sentences(spark, d), "sentence"))


#: The bounded sample the encoder is fitted on: so many users, in the order of a digest, and so many of each one's latest training events.
TRAIN_USERS, TRAIN_EVENTS = 100, 400


def _fitted(x: Experiment) -> tuple[encoder.Shape, dict]:
    """An encoder fitted on the latest ``TRAIN_EVENTS`` training events of at most ``TRAIN_USERS`` users."""
    some = x.train.select("user_id").distinct().orderBy(F.md5("user_id")).limit(TRAIN_USERS)
    recent = x.train.join(F.broadcast(some), "user_id", "left_semi")
    last = Window.partitionBy("user_id").orderBy(F.desc("pos"))
    rows = recent.withColumn("k", F.row_number().over(last)).where(F.col("k") <= TRAIN_EVENTS).select("user_id", "pos", "item_id", "ts").toPandas()
    sequences_ = [(g["item_id"].to_numpy(), g["ts"].to_numpy()) for _, g in rows.sort_values("pos").groupby("user_id")]
    shape = encoder.Shape(n_items=x.n_items + 2, dim=32, max_len=50)
    shorter, asked = train.held_out(sequences_)
    return shape, train.fit(shape, encoder.new_weights(shape), shorter, train.Config(epochs=3), validate=train.ndcg_validator(shape, asked))[0]


def eval_encoder(spark, d):
    """The sequence model under the protocol of the other scorers."""
    x = Experiment(spark, d)
    shape, weights = _fitted(x)
    return evaluate([scoring.Dense(shape, weights)], x.instances, x.seqs, x.n_items)


def attention_summary(spark, d):
    x = Experiment(spark, d)
    shape, weights = _fitted(x)
    return scoring.attention_summary(scoring.attention_traces(histories(x.instances, x.seqs, shape.max_len, ["item_id", "ts"]), shape, weights))


def recommend_requests(spark, d):
    """Every user's plays sent as a request of its own."""
    rows = keyed(spark, d)
    seqs, words = positioned(spark, d, rows)
    sim = E.nearest_items(E.similarity(E.cooccurrence(seqs)))
    asked = rows.select(F.col("user_id").alias("instance_id"), "artist", "track", "ts")
    return serving.recommend_histories(asked, words, sim, 10, unicode=False)[0]


QUERIES = {f.__name__: f for f in (
    eval_popularity, conform_events, validate_events, positive_events, corpus_summary, corpus_span, canonical_keys, canonical_keys_unicode, vocab, encoded_events, vocab_coverage, sessionize, gap_buckets, session_stats, session_signals,
    sequence_stats, repeat_rate, split_counts, leakage_check, eval_instances, instance_summary, history_lengths, train_windows, supervised_targets, eval_repeat, eval_itemknn, popularity_ranks, repeat_ranks, itemknn_ranks,
    cooccurrence, itemknn_sim, itemknn_topk, recommend_topk, recommend_discovery, recommend_context, item_sentences, tag_lookup, tag_coverage, drift_timeline, drift_summary, session_vectors, cluster_profile, lift_labels, latency_percentiles,
    vocab_strings, instance_oov, eval_all, optimistic_ranks, session_features, cluster_signals, kmeans_archetypes, embed_items, eval_encoder, attention_summary, recommend_requests,
)}


# the checks ------------------------------------------------------------------------------
_EVENTS = """
ev AS (SELECT DISTINCT user_id, ts, play_id AS seq, artist, track, ms_played, skipped, shuffle, offline, source FROM plays
  WHERE user_id IS NOT NULL AND ts > 0 AND artist IS NOT NULL AND track IS NOT NULL)"""
_KEYED = _EVENTS + f""",
pairs AS MATERIALIZED (SELECT artist, track, {sql_normalised('artist')} || ' :: ' || {sql_normalised('track')} AS item_key FROM (SELECT DISTINCT artist, track FROM ev)),
keyed AS MATERIALIZED (SELECT ev.*, item_key FROM ev JOIN pairs USING (artist, track) WHERE ms_played IS NULL OR ms_played >= 30000)"""
_VOCAB = _KEYED + f""",
words AS MATERIALIZED (SELECT row_number() OVER (ORDER BY cnt DESC, item_key) + 1 AS item_id, * FROM (
  SELECT item_key, count(*) AS cnt, first(artist ORDER BY user_id, ts, seq) AS artist, first(track ORDER BY user_id, ts, seq) AS track FROM keyed GROUP BY item_key HAVING count(*) >= {MIN_COUNT}))"""


def _numbered(source: str, name: str) -> str:
    """Positions, gaps and sessions of encoded rows."""
    return f"""
{name}_gaps AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, seq) - 1 AS pos, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, seq) AS gap_s FROM {source}),
{name} AS MATERIALIZED (SELECT *, sum(CASE WHEN gap_s IS NULL OR gap_s > 1800 THEN 1 ELSE 0 END) OVER (ORDER BY user_id, ts, seq ROWS UNBOUNDED PRECEDING) AS session_id FROM {name}_gaps)"""


def _sequences(rows: str, name: str) -> str:
    return f""",
{name}_rows AS (SELECT k.*, coalesce(w.item_id, 1) AS item_id FROM {rows} k LEFT JOIN words w USING (item_key)
  WHERE user_id IN (SELECT user_id FROM {rows} GROUP BY user_id HAVING count(*) >= {MIN_LEN})),""" + _numbered(f"{name}_rows", name)


_SEQS = _VOCAB + _sequences("keyed", "seqs")
_SPLIT = f""",
cut AS (SELECT cast(floor(quantile_cont(ts, {1 - TEST})) AS BIGINT) AS cutoff FROM keyed),
held AS (SELECT user_id FROM (SELECT DISTINCT user_id FROM keyed) ORDER BY md5('0:' || user_id), user_id LIMIT (SELECT cast(round_even(count(DISTINCT user_id) * {HOLDOUT}, 0) AS BIGINT) FROM keyed)),
past AS (SELECT keyed.* FROM keyed, cut WHERE ts < cutoff AND user_id NOT IN (SELECT user_id FROM held))"""
_EXPERIMENT = _SEQS + _SPLIT + _sequences("past", "train") + f""",
counts AS (SELECT item_id, count(*) AS cnt FROM train WHERE item_id >= 2 GROUP BY item_id),
asked AS (SELECT * FROM (SELECT seqs.*, row_number() OVER (PARTITION BY user_id ORDER BY md5('0:' || user_id || ':' || pos), pos) AS k FROM seqs, cut WHERE ts >= cutoff AND pos > 0) WHERE k <= {PER_USER} AND item_id > 1),
instances AS MATERIALIZED (SELECT user_id || ':' || pos AS instance_id, user_id, pos, ts, item_id AS target,
  EXISTS (SELECT 1 FROM seqs s WHERE s.user_id = a.user_id AND s.item_id = a.item_id AND s.pos < a.pos) AS is_repeat,
  user_id IN (SELECT user_id FROM held) AS is_cold_user, item_id NOT IN (SELECT item_id FROM train) AS is_cold_item FROM asked a)"""
_POP_RANKS = """,
catalog AS (SELECT item_id, coalesce(cnt, 0) AS cnt FROM (SELECT item_id FROM words) LEFT JOIN counts USING (item_id)),
ranked AS MATERIALIZED (SELECT i.*, (SELECT count(*) FROM catalog c WHERE c.cnt >= t.cnt) - 1 AS rank FROM instances i JOIN catalog t ON t.item_id = i.target)"""
_REPEAT_RANKS = """,
catalog AS (SELECT item_id, 0.15 * ln(1 + coalesce(cnt, 0)) / (SELECT ln(1 + max(cnt)) FROM counts) AS pop FROM (SELECT item_id FROM words) LEFT JOIN counts USING (item_id)),
hist AS (SELECT i.instance_id, s.pos, s.ts, s.item_id, s.session_id FROM instances i JOIN seqs s ON s.user_id = i.user_id AND s.pos < i.pos AND s.pos >= i.pos - 200),
ends AS (SELECT instance_id, max(ts) AS now, arg_max(session_id, pos) AS session FROM hist GROUP BY 1),
played AS (SELECT instance_id, item_id, sum(exp(-(ln(2.0) / (7.0 * 86400)) * (now - ts)) * CASE WHEN session_id = session THEN 1.5 ELSE 1.0 END) AS w FROM hist JOIN ends USING (instance_id) WHERE item_id >= 2 GROUP BY 1, 2),
scores AS (SELECT i.instance_id, c.item_id, round(c.pop + coalesce(p.w, 0), 9) AS s FROM instances i CROSS JOIN catalog c LEFT JOIN played p ON p.instance_id = i.instance_id AND p.item_id = c.item_id),
own AS (SELECT i.instance_id, s.s AS mine FROM instances i JOIN scores s ON s.instance_id = i.instance_id AND s.item_id = i.target),
places AS (SELECT instance_id, count(*) - 1 AS rank FROM scores JOIN own USING (instance_id) WHERE s >= mine GROUP BY 1),
ranked AS MATERIALIZED (SELECT i.*, rank FROM instances i JOIN places USING (instance_id))"""


def _similar(source: str) -> str:
    return f""",
apart AS (SELECT a.item_id AS i, b.item_id AS j FROM {source} a JOIN {source} b ON a.user_id = b.user_id AND b.pos - a.pos BETWEEN 1 AND 5 WHERE b.ts - a.ts <= 9000 AND a.item_id > 1 AND b.item_id > 1 AND a.item_id <> b.item_id),
co AS MATERIALIZED (SELECT i, j, count(*) AS n FROM (SELECT i, j FROM apart UNION ALL SELECT j, i FROM apart) GROUP BY i, j),
mass AS (SELECT i, sum(n) AS m FROM co GROUP BY i),
sims AS (SELECT co.i, co.j, round(n / sqrt(cast(a.m AS DOUBLE) * b.m), 9) AS sim FROM co JOIN mass a ON a.i = co.i JOIN mass b ON b.i = co.j),
near AS MATERIALIZED (SELECT i, j, sim FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY sim DESC, j) AS k FROM sims) WHERE k <= 200)"""


def _knn(asked: str) -> str:
    return f""",
recent AS (SELECT i.instance_id, s.item_id, row_number() OVER (PARTITION BY i.instance_id ORDER BY s.pos DESC) - 1 AS age FROM {asked} i JOIN seqs s ON s.user_id = i.user_id AND s.pos < i.pos AND s.pos >= i.pos - 30 WHERE s.item_id > 1),
kscores AS MATERIALIZED (SELECT instance_id, j AS item_id, round(sum(exp(-(ln(2.0) / 8.0) * age) * sim), 9) AS score FROM recent JOIN near ON near.i = recent.item_id GROUP BY 1, 2)"""


_KNN_RANKS = _similar("train") + _knn("instances") + """,
mine AS (SELECT i.instance_id, coalesce(k.score, 0) AS s FROM instances i LEFT JOIN kscores k ON k.instance_id = i.instance_id AND k.item_id = i.target),
places AS (SELECT m.instance_id, count(*) - 1 AS rank FROM mine m CROSS JOIN words w LEFT JOIN kscores k ON k.instance_id = m.instance_id AND k.item_id = w.item_id WHERE coalesce(k.score, 0) >= m.s GROUP BY 1),
ranked AS MATERIALIZED (SELECT i.*, rank FROM instances i JOIN places USING (instance_id))"""


def _metrics(model: str) -> str:
    columns = ", ".join(f"round(avg(CASE WHEN rank < {k} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 9) AS hr_{k}, round(avg(CASE WHEN rank < {k} THEN 1.0::DOUBLE / log2(rank + 2) ELSE 0.0::DOUBLE END), 9) AS ndcg_{k}, round(avg(CASE WHEN rank < {k} THEN 1.0::DOUBLE / (rank + 1) ELSE 0.0::DOUBLE END), 9) AS mrr_{k}" for k in E.KS)
    conditions = {"overall": "true", "repeat": "is_repeat", "novel": "NOT is_repeat", "cold_user": "is_cold_user", "cold_item": "is_cold_item", "cold_start": "is_cold_item AND NOT is_repeat"}
    parts = " UNION ALL ".join(f"SELECT *, '{s}' AS slice FROM ranked WHERE {c}" for s, c in conditions.items())
    return f"SELECT '{model}' AS model, slice, count(*) AS n, {columns} FROM ({parts}) GROUP BY slice"


_LAST = ",\nasked_last AS (SELECT user_id AS instance_id, user_id, max(pos) + 1 AS pos FROM seqs GROUP BY user_id)"
_CATALOG = "cat AS (SELECT item_index, s.artist AS artist, s.track AS track, s.genre AS genre, s.tags AS tags FROM (SELECT item_index, first({'artist': artist, 'track': track, 'genre': genre, 'tags': tags} ORDER BY artist NULLS FIRST, track NULLS FIRST, genre NULLS FIRST, tags NULLS FIRST) AS s FROM track_catalog GROUP BY item_index))"
_TAGS = "list_filter(list_transform(regexp_split_to_array(coalesce(tags, ''), '[,;]'), lambda t: lower(trim(t))), lambda t: t <> '')"
_TAGGED = f"""{_CATALOG},
own AS (SELECT item_index, {sql_normalised('artist')} AS artist_key, {sql_normalised('artist')} || ' :: ' || {sql_normalised('track')} AS item_key, lower(trim(genre)) AS genre, {_TAGS} AS own FROM cat),
byt AS (SELECT item_key, min(own) AS tags FROM own GROUP BY 1),
bya AS (SELECT artist_key, [min(genre)] AS tags FROM own WHERE genre IS NOT NULL GROUP BY 1),
tagged AS (SELECT item_index, CASE WHEN len(byt.tags) > 0 THEN byt.tags WHEN len(bya.tags) > 0 THEN bya.tags END AS tags FROM own LEFT JOIN byt USING (item_key) LEFT JOIN bya USING (artist_key))"""
_UNIT = """,
raw AS (SELECT vec_id + 2 AS item_id, generate_subscripts(embedding, 1) - 1 AS dim, cast(unnest(embedding) AS DOUBLE) AS raw FROM embeddings),
unit AS MATERIALIZED (SELECT item_id, dim, raw / greatest(sqrt(sum(raw * raw) OVER (PARTITION BY item_id)), 1e-12) AS x FROM raw)"""
_DRIFT = _SEQS + _UNIT + f""",
origin AS (SELECT min(ts) AS origin FROM seqs),
win AS (SELECT seqs.*, cast(floor((ts - origin) / ({WINDOW_DAYS} * 86400)) AS BIGINT) AS win, origin FROM seqs, origin),
byw AS (SELECT user_id, win, min(origin) AS origin, count(*) AS n_events, count(DISTINCT CASE WHEN item_id >= 2 THEN item_id END) AS n_unique, count(*) FILTER (item_id >= 2) AS n_real FROM win GROUP BY 1, 2),
means AS (SELECT user_id, win, dim, sum(x) / n_real AS m FROM win JOIN byw USING (user_id, win) JOIN unit USING (item_id) WHERE n_real >= {MIN_EVENTS} GROUP BY 1, 2, 3, n_real),
cent AS MATERIALIZED (SELECT user_id, win, dim, m / norm AS c FROM (SELECT *, sqrt(sum(m * m) OVER (PARTITION BY user_id, win)) AS norm FROM means) WHERE norm >= 1e-12),
placed AS (SELECT user_id, win, lag(win) OVER (PARTITION BY user_id ORDER BY win) AS previous, min(win) OVER (PARTITION BY user_id) AS firstw FROM (SELECT DISTINCT user_id, win FROM cent)),
steps AS (SELECT p.user_id, p.win, round(least(greatest(1 - sum(a.c * b.c), 0), 2), 6) AS step FROM placed p JOIN cent a ON a.user_id = p.user_id AND a.win = p.win JOIN cent b ON b.user_id = p.user_id AND b.win = p.previous AND b.dim = a.dim GROUP BY 1, 2),
moves AS (SELECT p.user_id, p.win, round(least(greatest(1 - sum(a.c * b.c), 0), 2), 6) AS displacement FROM placed p JOIN cent a ON a.user_id = p.user_id AND a.win = p.win JOIN cent b ON b.user_id = p.user_id AND b.win = p.firstw AND b.dim = a.dim WHERE p.win <> p.firstw GROUP BY 1, 2),
tops AS (SELECT user_id, win, string_agg(label, '|' ORDER BY k) AS top_items FROM (SELECT c.user_id, c.win, words.artist || ' - ' || words.track AS label, row_number() OVER (PARTITION BY c.user_id, c.win ORDER BY n DESC, c.item_id) AS k
  FROM (SELECT user_id, win, item_id, count(*) AS n FROM win WHERE item_id >= 2 GROUP BY 1, 2, 3) c JOIN placed USING (user_id, win) JOIN words ON words.item_id = c.item_id) WHERE k <= 5 GROUP BY 1, 2),
timeline AS (SELECT user_id, win AS "window", origin + win * {WINDOW_DAYS * 86400} AS start_ts, n_events, n_unique, firstw IS NULL AS sparse, step, CASE WHEN win = firstw THEN 0.0::DOUBLE ELSE displacement END AS displacement, win - previous AS since_previous, coalesce(top_items, '') AS top_items
  FROM byw LEFT JOIN placed USING (user_id, win) LEFT JOIN steps USING (user_id, win) LEFT JOIN moves USING (user_id, win) LEFT JOIN tops USING (user_id, win))"""
_BEHAVIOUR = """,
behaviour AS (SELECT session_id, user_id, min(ts) AS start_ts, count(*) AS n_events, count(*) FILTER (item_id >= 2) AS n_real, count(DISTINCT CASE WHEN item_id >= 2 THEN item_id END) AS n_unique,
  coalesce(median(CASE WHEN gap_s <= 1800 THEN gap_s END), 0.0::DOUBLE) AS median_gap FROM seqs GROUP BY 1, 2),
enough AS (SELECT * FROM behaviour WHERE n_events >= 3 AND n_real >= 3)"""
_GROUPED = """once AS (SELECT session_id, s.n_events AS n_events, s.n_unique AS n_unique, s.repeat_frac AS repeat_frac, s.median_gap AS median_gap, s.hour_utc AS hour_utc, items FROM (
  SELECT session_id, first({'n_events': n_events, 'n_unique': n_unique, 'repeat_frac': repeat_frac, 'median_gap': median_gap, 'hour_utc': hour_utc} ORDER BY user_id, start_ts, n_events, n_unique, repeat_frac, median_gap, hour_utc) AS s, max(items) AS items FROM session_table GROUP BY session_id)),
grouped AS (SELECT *, cast(floor(hour_utc / 6) AS INT) AS cluster FROM once)"""

ORACLES = {
    "conform_events": f"WITH {_EVENTS} SELECT * FROM ev",
    "validate_events": "SELECT count(*) AS n_rows, sum((user_id IS NULL OR ts IS NULL OR artist IS NULL OR track IS NULL)::INT)::BIGINT AS n_null, count(*) FILTER (ts <= 0) AS n_not_positive, count(*) FILTER (before > ts) AS n_out_of_order FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY play_id) AS before FROM plays)",
    "positive_events": f"WITH {_EVENTS} SELECT source, count(*) AS n, count(DISTINCT user_id) AS users, min(ts) AS first_ts, max(ts) AS last_ts FROM ev WHERE ms_played IS NULL OR ms_played >= 30000 GROUP BY source",
    "corpus_summary": f"WITH {_EVENTS} SELECT count(*) AS events, count(DISTINCT user_id) AS users, count(DISTINCT artist) AS artists, count(DISTINCT (artist, track)) AS tracks, min(ts) AS first_ts, max(ts) AS last_ts, bool_or(ms_played IS NOT NULL) AS has_ms FROM ev",
    "canonical_keys": f"WITH {_KEYED} SELECT artist, track, item_key FROM pairs",
    "vocab": f"WITH {_VOCAB} SELECT item_id, item_key, cnt, artist, track FROM words",
    "encoded_events": f"WITH {_VOCAB} SELECT user_id, ts, seq, coalesce(item_id, 1) AS item_id FROM keyed LEFT JOIN words USING (item_key)",
    "vocab_coverage": f"WITH {_VOCAB} SELECT round(avg((item_id IS NOT NULL)::INT), 9) AS coverage FROM keyed LEFT JOIN words USING (item_key)",
    "sessionize": f"WITH {_KEYED}, {_numbered('keyed', 'numbered')} SELECT user_id, ts, seq, pos, gap_s, session_id::BIGINT AS session_id FROM numbered",
    "gap_buckets": f"WITH {_KEYED}, {_numbered('keyed', 'numbered')} SELECT (CASE WHEN gap_s IS NULL THEN 1 ELSE 2 + len(list_filter({GAP_EDGES}, lambda e: e <= greatest(gap_s, 0))) END)::INT AS bucket, count(*) AS n FROM numbered GROUP BY 1",
    "session_stats": f"WITH {_SEQS}{_BEHAVIOUR} SELECT session_id::BIGINT AS session_id, user_id, start_ts, n_events, n_unique, round(1 - n_unique / n_real, 9) AS repeat_frac, median_gap, ((start_ts // 3600) % 24)::INT AS hour_utc FROM enough",
    "session_signals": f"WITH {_KEYED}, {_numbered('keyed', 'numbered')} SELECT session_id::BIGINT AS session_id, round(avg(ms_played::DOUBLE) / 1000, 9) AS mean_seconds, round(avg(skipped::INT::DOUBLE), 9) AS skip_rate, round(avg(shuffle::INT::DOUBLE), 9) AS shuffle_rate FROM numbered GROUP BY 1",
    "sequence_stats": f"WITH {_SEQS} SELECT count(*) AS users, sum(n)::BIGINT AS events, round(avg(n), 9) AS mean_len, median(n) AS median_len FROM (SELECT user_id, count(*) AS n FROM seqs GROUP BY 1)",
    "repeat_rate": f"WITH {_SEQS} SELECT round(avg((k > 1)::INT), 9) AS repeat_rate FROM (SELECT row_number() OVER (PARTITION BY user_id, item_id ORDER BY pos) AS k FROM seqs)",
    "split_counts": f"WITH {_KEYED}{_SPLIT} SELECT (SELECT count(*) FROM past) AS train_events, (SELECT count(DISTINCT user_id) FROM past) AS train_users, (SELECT count(*) FROM keyed, cut WHERE ts >= cutoff) AS test_events, (SELECT count(DISTINCT user_id) FROM keyed, cut WHERE ts >= cutoff) AS test_users, (SELECT count(*) FROM held) AS holdout_users, cutoff AS cutoff_ts FROM cut",
    "leakage_check": f"WITH {_KEYED}{_SPLIT} SELECT (SELECT max(ts) FROM past) AS max_train_ts, (SELECT min(ts) FROM keyed, cut WHERE ts >= cutoff) AS min_test_ts, (SELECT count(*) FROM past WHERE user_id IN (SELECT user_id FROM held)) AS holdout_events_in_train",
    "eval_instances": f"WITH {_EXPERIMENT} SELECT * FROM instances",
    "instance_summary": f"WITH {_EXPERIMENT} SELECT count(*) AS n, count(DISTINCT user_id) AS users, round(avg(is_repeat::INT), 9) AS repeat_frac, round(avg(is_cold_user::INT), 9) AS cold_user_frac, round(avg(is_cold_item::INT), 9) AS cold_item_frac FROM instances",
    "instance_oov": f"WITH {_EXPERIMENT}, taken AS (SELECT item_id FROM (SELECT seqs.*, row_number() OVER (PARTITION BY user_id ORDER BY md5('0:' || user_id || ':' || pos), pos) AS k FROM seqs, cut WHERE ts >= cutoff AND pos > 0) WHERE k <= {PER_USER}) SELECT count(*) AS n_taken, count(*) FILTER (item_id <= 1) AS n_oov, coalesce(round(avg((item_id <= 1)::INT), 9), 0.0) AS oov_frac FROM taken",
    "session_features": f"WITH {_SEQS}{_BEHAVIOUR}, signals AS (SELECT session_id, round(avg(ms_played::DOUBLE) / 1000, 9) AS mean_seconds, round(avg(skipped::INT::DOUBLE), 9) AS skip_rate, round(avg(shuffle::INT::DOUBLE), 9) AS shuffle_rate FROM seqs GROUP BY 1) SELECT session_id::BIGINT AS session_id, user_id, start_ts, n_events, n_unique, round(1 - n_unique / n_real, 9) AS repeat_frac, median_gap, ((start_ts // 3600) % 24)::INT AS hour_utc, mean_seconds, skip_rate, shuffle_rate FROM enough JOIN signals USING (session_id)",
    "cluster_signals": f"WITH {_GROUPED}, signals AS (SELECT session_id, max(mean_seconds) AS mean_seconds, max(skip_rate) AS skip_rate, max(shuffle_rate) AS shuffle_rate FROM session_table GROUP BY 1) SELECT cluster, round(avg(mean_seconds), 6) AS mean_seconds, round(avg(skip_rate), 6) AS skip_rate, round(avg(shuffle_rate), 6) AS shuffle_rate FROM grouped JOIN signals USING (session_id) GROUP BY cluster",
    "history_lengths": f"WITH {_EXPERIMENT} SELECT instance_id, count(*) AS n, min(s.pos) AS first_pos, min(s.ts) AS first_ts, max(s.ts) AS last_ts, sum(item_id)::BIGINT AS id_sum FROM instances i JOIN seqs s ON s.user_id = i.user_id AND s.pos < i.pos AND s.pos >= i.pos - 200 GROUP BY 1",
    "train_windows": f"WITH {_SEQS}, n AS (SELECT user_id, count(*) AS n FROM seqs GROUP BY 1 HAVING count(*) >= 3), e AS (SELECT user_id, unnest(generate_series(n - 1, 2, -10)) AS window_end FROM n) SELECT user_id, window_end, greatest(window_end - 20, 0) AS window_start, window_end - greatest(window_end - 20, 0) AS n_inputs FROM e",
    "supervised_targets": f"WITH {_SEQS}, n AS (SELECT user_id, count(*) AS n FROM seqs GROUP BY 1 HAVING count(*) >= 3), e AS (SELECT user_id, unnest(generate_series(n - 1, 2, -20)) AS window_end FROM n), p AS (SELECT s.user_id, CASE WHEN t.item_id >= 2 THEN t.item_id ELSE 0 END AS target FROM e JOIN seqs s ON s.user_id = e.user_id AND s.pos >= greatest(window_end - 20, 0) AND s.pos < window_end JOIN seqs t ON t.user_id = s.user_id AND t.pos = s.pos + 1) SELECT user_id, count(*) AS n, count(*) FILTER (target >= 2) AS n_targets, sum(target)::BIGINT AS target_sum FROM p GROUP BY 1",
    "eval_popularity": f"WITH {_EXPERIMENT}{_POP_RANKS} {_metrics('popularity')}",
    "eval_repeat": f"WITH {_EXPERIMENT}{_REPEAT_RANKS} {_metrics('repeat')}",
    "eval_itemknn": f"WITH {_EXPERIMENT}{_KNN_RANKS} {_metrics('itemknn')}",
    "popularity_ranks": f"WITH {_EXPERIMENT}{_POP_RANKS} SELECT instance_id, target, rank FROM ranked",
    "repeat_ranks": f"WITH {_EXPERIMENT}{_REPEAT_RANKS} SELECT instance_id, target, rank FROM ranked",
    "itemknn_ranks": f"WITH {_EXPERIMENT}{_KNN_RANKS} SELECT instance_id, target, rank FROM ranked",
    "cooccurrence": f"WITH {_SEQS}{_similar('seqs')} SELECT i, j, n FROM co",
    "itemknn_sim": f"WITH {_SEQS}{_similar('seqs')} SELECT i, j, sim FROM sims",
    "itemknn_topk": f"WITH {_SEQS}{_similar('seqs')} SELECT i, j, sim FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY sim DESC, j) AS k FROM sims) WHERE k <= 10",
    "recommend_topk": f"WITH {_SEQS}{_similar('seqs')}{_LAST}{_knn('asked_last')} SELECT instance_id AS user_id, place, item_id, artist, track, score FROM (SELECT *, row_number() OVER (PARTITION BY instance_id ORDER BY score DESC, item_id) AS place FROM kscores) JOIN words USING (item_id) WHERE place <= 10",
    "recommend_discovery": f"WITH {_SEQS}{_similar('seqs')}{_LAST}{_knn('asked_last')}, heard AS (SELECT DISTINCT a.instance_id, s.item_id FROM asked_last a JOIN seqs s ON s.user_id = a.user_id AND s.pos >= a.pos - 200) SELECT instance_id AS user_id, place, item_id, artist, track, score FROM (SELECT *, row_number() OVER (PARTITION BY instance_id ORDER BY score DESC, item_id) AS place FROM kscores ANTI JOIN heard USING (instance_id, item_id)) JOIN words USING (item_id) WHERE place <= 10",
    "recommend_context": f"WITH {_SEQS}{_LAST} SELECT a.user_id, count(*) AS history_length, count(*) FILTER (item_id >= 2) AS matched, round(avg((item_id >= 2)::INT), 9) AS coverage, avg((item_id >= 2)::INT) < 0.25 AS cold_start FROM asked_last a JOIN seqs s ON s.user_id = a.user_id AND s.pos >= a.pos - 200 GROUP BY 1",
    "item_sentences": f"WITH {_CATALOG}, t AS (SELECT item_index, trim(coalesce(track, '')) || ' by ' || trim(coalesce(artist, '')) AS plain, list_slice({_TAGS}, 1, 5) AS tags FROM cat) SELECT item_index, CASE WHEN len(tags) > 0 THEN plain || '. Genre: ' || array_to_string(tags, ', ') ELSE plain END AS sentence FROM t",
    "tag_lookup": f"WITH {_TAGGED} SELECT item_index, array_to_string(tags, '|') AS tags FROM tagged",
    "tag_coverage": f"WITH {_TAGGED} SELECT coalesce(round(avg(CASE WHEN len(tags) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 9), 0.0) AS coverage FROM tagged",
    "drift_timeline": f"WITH {_DRIFT} SELECT * FROM timeline",
    "drift_summary": f"WITH {_DRIFT} SELECT count(DISTINCT user_id) AS users, count(*) AS windows, count(*) FILTER (NOT sparse) AS placed, count(*) FILTER (sparse) AS sparse, round(avg(step), 8) AS mean_step, round(median(step), 7) AS median_step, round(avg(displacement), 8) AS mean_displacement, max(displacement) AS max_displacement FROM timeline",
    "session_vectors": f"WITH {_SEQS}{_BEHAVIOUR}{_UNIT}, m AS (SELECT session_id, dim, sum(x) AS m FROM seqs JOIN unit USING (item_id) WHERE session_id IN (SELECT session_id FROM enough) GROUP BY 1, 2), u AS (SELECT *, sqrt(sum(m * m) OVER (PARTITION BY session_id)) AS norm FROM m) SELECT session_id::BIGINT AS session_id, dim::INT AS dim, round(m / norm, 6) AS x FROM u WHERE norm >= 1e-12",
    "cluster_profile": f"WITH {_GROUPED}, h AS (SELECT cluster, h.h AS h, (SELECT count(*) FROM grouped g WHERE g.cluster = c.cluster AND g.hour_utc = h.h) AS n FROM (SELECT DISTINCT cluster FROM grouped) c CROSS JOIN (SELECT unnest(generate_series(0, 23)) AS h) h), hh AS (SELECT cluster, string_agg(n::VARCHAR, ',' ORDER BY h) AS hour_histogram, first(h ORDER BY n DESC, h)::INT AS peak_hour FROM h GROUP BY 1) SELECT cluster, count(*) AS n_sessions, round(count(*) / (SELECT count(*) FROM grouped), 6) AS share, round(avg(n_events), 6) AS mean_length, round(avg(n_unique), 6) AS mean_unique, round(avg(repeat_frac::DOUBLE), 6) AS mean_repeat_frac, round(median(median_gap::DOUBLE), 6) AS median_gap_s, peak_hour, hour_histogram FROM grouped JOIN hh USING (cluster) GROUP BY cluster, peak_hour, hour_histogram",
    "lift_labels": f"WITH {_GROUPED}, p AS (SELECT cluster, item::VARCHAR AS label FROM (SELECT cluster, unnest(items) AS item FROM grouped) WHERE item >= 2), c AS (SELECT cluster, label, count(*) AS count FROM p GROUP BY 1, 2), s AS (SELECT cluster, label, count, sum(count) OVER (PARTITION BY cluster) AS a, sum(count) OVER (PARTITION BY label) AS b, sum(count) OVER () AS t FROM c), r AS (SELECT cluster, label, round(count / a / (b / t), 3) AS lift, round(count / a, 4) AS share, count FROM s WHERE count >= 5) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY lift DESC, count DESC, label) AS place FROM r) WHERE place <= 5",
    "latency_percentiles": "SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS p50_ms, round(quantile_cont(value, 0.95), 6) AS p95_ms, round(quantile_cont(value, 0.99), 6) AS p99_ms, round(avg(value), 6) AS mean_ms, max(value) AS max_ms FROM events GROUP BY event_type",
}
ORACLES["eval_all"] = " UNION ALL ".join(f"SELECT * FROM ({ORACLES[q]})" for q in ("eval_popularity", "eval_repeat", "eval_itemknn"))
_HIGHER = {
    "popularity": _EXPERIMENT + _POP_RANKS.replace(">= t.cnt) - 1", "> t.cnt)"),
    "repeat": _EXPERIMENT + _REPEAT_RANKS.replace("count(*) - 1", "count(*) FILTER (s > mine)"),
    "itemknn": _EXPERIMENT + _KNN_RANKS.replace("count(*) - 1", "count(*) FILTER (coalesce(k.score, 0) > m.s)"),
}
ORACLES["optimistic_ranks"] = " UNION ALL ".join(f"SELECT * FROM (WITH {sql} SELECT '{m}' AS model, instance_id, rank FROM ranked)" for m, sql in _HIGHER.items())
ORACLES["recommend_requests"] = f"""WITH {_SEQS}{_similar('seqs')},
req AS (SELECT * FROM (SELECT user_id AS instance_id, coalesce(item_id, 1) AS item_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, keyed.artist DESC, keyed.track DESC) AS k FROM keyed LEFT JOIN words USING (item_key)) WHERE k <= {E.MAX_LEN}),
recent AS (SELECT instance_id, item_id, row_number() OVER (PARTITION BY instance_id ORDER BY k) - 1 AS age FROM req WHERE k <= 30 AND item_id > 1),
kscores AS (SELECT instance_id, j AS item_id, round(sum(exp(-(ln(2.0) / 8.0) * age) * sim), 9) AS score FROM recent JOIN near ON near.i = recent.item_id GROUP BY 1, 2),
best AS (SELECT *, row_number() OVER (PARTITION BY instance_id ORDER BY score DESC, item_id) AS place FROM kscores)
SELECT instance_id, place, item_id, artist, track, score, EXISTS (SELECT 1 FROM req r WHERE r.instance_id = best.instance_id AND r.item_id = best.item_id) AS is_repeat FROM best JOIN words USING (item_id) WHERE place <= 10"""
ORACLES["vocab_strings"] = f"WITH {_VOCAB} SELECT item_id, trim(track, ' ') || ' by ' || trim(artist, ' ') AS text FROM words UNION ALL SELECT unnest([0::BIGINT, 1::BIGINT]), ''"
ORACLES["embed_items"] = f"SELECT count(*) AS rows, 384 AS dim, count(*) FILTER (sentence = '') AS zero_rows, round(avg(CASE WHEN sentence = '' THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END), 6) AS mean_norm FROM ({ORACLES['item_sentences']})"
ORACLES["corpus_span"] = f"WITH {_EVENTS} SELECT source, strftime(make_timestamp(min(ts) * 1000000), '%Y-%m-%d %H:%M:%S') || '+00:00' AS first_play, strftime(make_timestamp(max(ts) * 1000000), '%Y-%m-%d %H:%M:%S') || '+00:00' AS last_play FROM ev GROUP BY source"
