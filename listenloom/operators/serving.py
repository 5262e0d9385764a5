"""Recommendations for histories that come with a request."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from listenloom.functions.canonical import with_item_key
from listenloom.operators.evaluation import MAX_LEN, context_report, knn_scores, recommend
from listenloom.operators.vocab import FIRST, encode


def encode_requests(histories: DataFrame, vocab: DataFrame, max_len: int = MAX_LEN, unicode: bool = True) -> DataFrame:
    """``instance_id, user_id, pos, ts, item_id, artist, track, known``: the latest ``max_len`` plays of each, unknown ones kept."""
    rows = encode(with_item_key(histories, unicode), vocab)
    w = Window.partitionBy("instance_id").orderBy(F.desc("ts"), F.desc("artist"), F.desc("track"))  # a request has at most 5,000 plays
    last = rows.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= max_len)
    pos = F.max("__k").over(Window.partitionBy("instance_id")) - F.col("__k")
    return last.select("instance_id", F.col("instance_id").alias("user_id"), pos.cast("bigint").alias("pos"), "ts", "item_id", "artist", "track", (F.col("item_id") >= FIRST).alias("known"))


def recommend_histories(histories: DataFrame, vocab: DataFrame, sim: DataFrame, k: int = 20, discover: bool = False, unicode: bool = True) -> tuple[DataFrame, DataFrame]:
    """``(recommendations, context)`` for ``instance_id, artist, track, ts``.

    Recommendations are ``instance_id, place, item_id, artist, track, score, is_repeat``;
    the context tells how much of each history is known, and whether that is too little.
    """
    past = encode_requests(histories, vocab, unicode=unicode)
    asked = past.groupBy("instance_id", "user_id").agg((F.max("pos") + 1).alias("pos"))
    heard = past.select("instance_id", "item_id").distinct()
    top = recommend(knn_scores(asked, past, sim), min(100, max(1, k)), heard if discover else None)
    named = top.join(vocab.select("item_id", "artist", "track"), "item_id")
    flagged = named.join(heard.withColumn("is_repeat", F.lit(True)), ["instance_id", "item_id"], "left")
    return flagged.select("instance_id", "place", "item_id", "artist", "track", "score", F.coalesce("is_repeat", F.lit(False)).alias("is_repeat")), context_report(past)
