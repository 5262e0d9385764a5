"""Texts and tags of items, and windows to train on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listenloom.functions.canonical import SEPARATOR
from listenloom.operators.vocab import FIRST
from listenloom.runtime import spelled_out


def item_sentence(artist: Column, track: Column, tags: Column, max_tags: int = 5) -> Column:
    """``{track} by {artist}[. Genre: a, b]``; the first ``max_tags`` tags, of which blank ones are left out."""
    clean = F.filter(F.transform(F.slice(F.coalesce(tags, F.array().cast("array<string>")), 1, max_tags), F.trim), lambda t: t.isNotNull() & (t != ""))
    plain = F.concat(F.trim(F.coalesce(track, F.lit(""))), F.lit(" by "), F.trim(F.coalesce(artist, F.lit(""))))
    return F.when(F.size(clean) > 0, F.concat(plain, F.lit(". Genre: "), F.array_join(clean, ", "))).otherwise(plain)


def vocab_strings(vocab: DataFrame, tags: DataFrame | None = None, max_tags: int = 5) -> DataFrame:
    """``item_id, text``: a sentence for each number; empty for the reserved ones, which must never be scored.

    Names are those of the vocabulary where it has both ``artist`` and ``track``, else the two
    halves of ``item_key``. ``tags`` is ``item_key, tags``.
    """
    halves = F.split("item_key", SEPARATOR, 2)
    named = {"artist", "track"} <= set(vocab.columns)
    half = lambda c, i: F.coalesce(F.col(c), halves[i]) if named else halves[i]
    rows = vocab if tags is None else vocab.join(tags.select("item_key", "tags"), "item_key", "left")
    own = F.col("tags") if tags is not None else F.lit(None).cast("array<string>")
    real = rows.select(F.col("item_id").cast("bigint").alias("item_id"), item_sentence(half("artist", 0), half("track", 1), own, max_tags).alias("text"))
    return real.unionByName(vocab.sparkSession.range(FIRST).select(F.col("id").alias("item_id"), F.lit("").alias("text")))


def split_tags(tags: Column) -> Column:
    """Tags of a list written with commas or semicolons: trimmed, lower case, blank ones left out."""
    return F.filter(F.transform(F.split(F.coalesce(tags, F.lit("")), "[,;]"), lambda t: F.lower(F.trim(t))), lambda t: t != "")


def lookup_tags(items: DataFrame, track_tags: DataFrame, artist_tags: DataFrame) -> DataFrame:
    """``items`` (``item_key, artist_key``) with ``tags``: the track's if there are any, else the artist's.

    Both tables are ``key, tags``; an empty array is a known miss. Items without tags have null.
    """
    t = track_tags.select(F.col("key").alias("item_key"), F.col("tags").alias("__t"))
    a = artist_tags.select(F.col("key").alias("artist_key"), F.col("tags").alias("__a"))
    both = items.join(t, "item_key", "left").join(a, "artist_key", "left")
    return both.withColumn("tags", F.when(F.size("__t") > 0, F.col("__t")).when(F.size("__a") > 0, F.col("__a"))).drop("__t", "__a")


def tag_coverage(items: DataFrame) -> DataFrame:
    """One row ``coverage``: the part of items with a tag."""
    return items.agg(F.coalesce(F.round(F.avg(F.when(F.size("tags") > 0, 1.0).otherwise(0.0)), 9), F.lit(0.0)).alias("coverage"))


def uncached(items: DataFrame, cache: DataFrame, limit: int | None = None) -> DataFrame:
    """Distinct non-empty ``key`` values of ``items`` that the cache lacks; what a fetch loop still has to do."""
    todo = items.select("key").where(F.col("key") != "").distinct().join(cache.select("key"), "key", "left_anti")
    return todo if limit is None else todo.orderBy("key").limit(limit)


def train_windows(seqs: DataFrame, max_len: int = 200, stride: int | None = None, min_targets: int = 2) -> DataFrame:
    """``user_id, window_end, window_start, n_inputs``: windows of positions, back from the last in steps of ``stride``.

    The items at ``[start, end)`` are inputs, those at ``[start + 1, end]`` targets.
    """
    step = stride or max_len
    users = seqs.groupBy("user_id").agg((F.max("pos") + 1).alias("n")).where(F.col("n") >= min_targets + 1)
    ends = users.select("user_id", F.explode(F.sequence(F.col("n") - 1, F.lit(min_targets).cast("bigint"), F.lit(-step).cast("bigint"))).alias("window_end"))
    return ends.withColumn("window_start", F.greatest(F.col("window_end") - max_len, F.lit(0))).withColumn("n_inputs", F.col("window_end") - F.col("window_start"))


def supervised(seqs: DataFrame, windows: DataFrame) -> DataFrame:
    """``user_id, window_end, pos, item_id, target``: inputs and targets; only real items are targets (0 otherwise)."""
    nxt = seqs.select("user_id", (F.col("pos") - 1).alias("pos"), F.when(F.col("item_id") >= FIRST, F.col("item_id")).otherwise(0).alias("target"))
    pairs = seqs.select("user_id", "pos", "item_id").join(nxt.hint("merge"), ["user_id", "pos"])  # a row per event, whatever its files take
    spans = windows.select("user_id", "window_end", F.explode(F.sequence("window_start", F.col("window_end") - 1)).alias("pos"))
    return spelled_out(spans).join(pairs, ["user_id", "pos"]).select("user_id", "window_end", "pos", "item_id", "target")
