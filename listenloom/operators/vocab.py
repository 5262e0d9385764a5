"""Item numbers: 0 pads, 1 is unknown, items follow from 2 by count and key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listenloom.operators.ordered import global_rank

PAD, OOV, FIRST = 0, 1, 2
MIN_MS = 30_000


def positives(events: DataFrame, min_ms: int = MIN_MS) -> DataFrame:
    """Events played long enough, or for an unknown time."""
    return events.where(F.col("ms_played").isNull() | (F.col("ms_played") >= min_ms))


def build_vocab(keyed: DataFrame, min_count: int = 5) -> DataFrame:
    """``item_id, item_key, cnt, artist, track`` of keys with at least ``min_count`` events.

    Numbered by falling count, then key. Artist and track are as in the key's first event
    in the order of user, time and ``seq``.
    """
    first = F.struct("user_id", "ts", "seq")
    counted = keyed.groupBy("item_key").agg(F.count("*").alias("cnt"), F.min_by("artist", first).alias("artist"), F.min_by("track", first).alias("track")).where(F.col("cnt") >= min_count)
    return global_rank(counted, [F.desc("cnt"), F.col("item_key")], "__k").select((F.col("__k") + FIRST).alias("item_id"), "item_key", "cnt", "artist", "track")


def encode(keyed: DataFrame, vocab: DataFrame) -> DataFrame:
    """``keyed`` with ``item_id``; what the vocabulary lacks is 1."""
    return keyed.join(vocab.select("item_key", "item_id"), "item_key", "left").withColumn("item_id", F.coalesce("item_id", F.lit(OOV).cast("bigint")))


def coverage(keys: DataFrame, vocab: DataFrame) -> DataFrame:
    """One row ``coverage``: the part of ``item_key`` rows the vocabulary has, 0 for no rows."""
    known = keys.join(vocab.select("item_key", F.lit(1).alias("known")), "item_key", "left")
    return known.agg(F.coalesce(F.avg(F.coalesce("known", F.lit(0))), F.lit(0.0)).alias("coverage"))


def long_enough(seqs: DataFrame, min_len: int = 5) -> DataFrame:
    """Events of users that have at least ``min_len`` of them here."""
    users = seqs.groupBy("user_id").agg(F.count("*").alias("__n")).where(F.col("__n") >= min_len).select("user_id")
    return seqs.join(users, "user_id", "left_semi")


def train_counts(train: DataFrame) -> DataFrame:
    """``item_id, cnt`` of the real items in training sequences."""
    return train.where(F.col("item_id") >= FIRST).groupBy("item_id").agg(F.count("*").alias("cnt"))


def vocab_differences(a: DataFrame, b: DataFrame) -> int:
    """How many numbers mean different keys in two vocabularies; 0 if they are the same."""
    both = a.select("item_id", F.col("item_key").alias("__a")).join(b.select("item_id", F.col("item_key").alias("__b")), "item_id", "full_outer")
    return both.where(~F.col("__a").eqNullSafe(F.col("__b"))).count()
