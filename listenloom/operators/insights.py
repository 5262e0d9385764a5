"""Drift of taste, sessions as vectors, and what sets a group of sessions apart."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listenloom.functions.time import hour_of_day, window_number
from listenloom.functions.vectors import TINY, cosine_distance, norm
from listenloom.operators.ordered import grouped_quantiles
from listenloom.operators.vocab import FIRST


def item_vectors(embeddings: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``item_id, x``: unit vectors as arrays; vector ``v`` is item ``v + 2``. Null vectors have no row."""
    rows = embeddings.where(F.col(vector).isNotNull()).select((F.col(key) + FIRST).alias("item_id"), F.col(vector).cast("array<double>").alias("raw"))
    return rows.withColumn("norm", F.greatest(norm(F.col("raw")), F.lit(TINY))).select("item_id", F.transform("raw", lambda v: v / F.col("norm")).alias("x"))


def centroids(weights: DataFrame, vectors: DataFrame, group: list[str]) -> DataFrame:
    """``group, c``: the mean unit vector of each group's items at length one, as an array.

    ``weights`` has ``group, item_id, n``. Items without a vector count as zero vectors, which
    doesn't turn the mean; a group whose vectors cancel out, or that has none, has no row.
    Vectors are added up where they are before they are sent, one array for a group.
    """
    joined = weights.join(vectors, "item_id").select(*group, "n", array_to_vector("x").alias("x"))
    mean = joined.groupBy(*group).agg(Summarizer.mean(F.col("x"), F.col("n")).alias("m")).select(*group, vector_to_array("m").alias("m"))
    return mean.withColumn("__norm", norm(F.col("m"))).where(F.col("__norm") >= TINY).select(*group, F.transform("m", lambda v: v / F.col("__norm")).alias("c"))


def _distance(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), F.round(cosine_distance(a, b), 6))


def drift_timeline(seqs: DataFrame, vectors: DataFrame, window_days: int = 90, min_events: int = 10, top: int = 5, labels: DataFrame | None = None) -> DataFrame:
    """``user_id, window, start_ts, n_events, n_unique, sparse, step, displacement, since_previous, top_items``.

    Windows of ``window_days`` from the earliest event of all. A window with fewer than
    ``min_events`` real items, or without a direction, is sparse and has no position. ``step``
    is the distance to the placed window before, ``displacement`` that to the user's first
    placed window (0 for itself), ``since_previous`` the number of windows in between plus one.
    ``labels`` (``item_id, label``) names the top items, by count, then number.
    """
    origin = seqs.agg(F.min("ts")).first()[0]
    placed_in = seqs.withColumn("origin", F.lit(origin).cast("bigint")).withColumn("window", window_number(F.col("ts"), F.col("origin"), window_days))
    real = F.col("item_id") >= FIRST
    by = placed_in.groupBy("user_id", "window").agg(F.min("origin").alias("origin"), F.count("*").alias("n_events"), F.countDistinct(F.when(real, F.col("item_id"))).alias("n_unique"), F.count_if(real).alias("n_real"))
    weights = placed_in.where(real).groupBy("user_id", "window", "item_id").agg(F.count("*").alias("n"))
    enough = by.where(F.col("n_real") >= min_events).select("user_id", "window")
    where = centroids(weights.join(enough, ["user_id", "window"], "left_semi"), vectors, ["user_id", "window"])
    w = Window.partitionBy("user_id").orderBy("window")  # a row per window of the calendar
    first, before = (lambda c: F.first(c).over(w)), (lambda c: F.lag(c).over(w))
    placed = where.select("user_id", "window", "c", before("window").alias("previous"), first("window").alias("first"), before("c").alias("__p"), first("c").alias("__f"))
    placed = placed.select("user_id", "window", "previous", "first", _distance(F.col("c"), F.col("__p")).alias("step"), _distance(F.col("c"), F.col("__f")).alias("displacement"))
    ranked = weights.join(placed.select("user_id", "window"), ["user_id", "window"], "left_semi")
    ranked = ranked.withColumn("k", F.row_number().over(Window.partitionBy("user_id", "window").orderBy(F.desc("n"), "item_id"))).where(F.col("k") <= top)
    named = ranked.join(labels, "item_id", "left") if labels is not None else ranked.withColumn("label", F.lit(None).cast("string"))
    tops = named.groupBy("user_id", "window").agg(F.array_sort(F.collect_list(F.struct("k", F.coalesce("label", F.col("item_id").cast("string")).alias("label")))).alias("t")).select("user_id", "window", F.transform("t", lambda x: x["label"]).alias("top_items"))
    out = by.join(placed, ["user_id", "window"], "left").join(tops, ["user_id", "window"], "left")
    return out.select(
        "user_id",
        "window",
        (F.col("origin") + F.col("window") * window_days * 86_400).cast("bigint").alias("start_ts"),
        "n_events",
        "n_unique",
        F.col("first").isNull().alias("sparse"),
        "step",
        F.when(F.col("window") == F.col("first"), F.lit(0.0)).otherwise(F.col("displacement")).alias("displacement"),
        (F.col("window") - F.col("previous")).alias("since_previous"),
        F.coalesce("top_items", F.array().cast("array<string>")).alias("top_items"),
    )


def drift_summary(timeline: DataFrame) -> DataFrame:
    """One row over all windows of a timeline."""
    return timeline.agg(
        F.countDistinct("user_id").alias("users"),
        F.count("*").alias("windows"),
        F.count_if(~F.col("sparse")).alias("placed"),
        F.count_if("sparse").alias("sparse"),
        F.round(F.avg("step"), 8).alias("mean_step"),
        F.round(F.median("step"), 7).alias("median_step"),
        F.round(F.avg("displacement"), 8).alias("mean_displacement"),
        F.max("displacement").alias("max_displacement"),
    )


def session_behaviour(seqs: DataFrame, min_len: int = 3) -> DataFrame:
    """``session_id, user_id, start_ts, n_events, n_unique, repeat_frac, median_gap, hour_utc`` of sessions with at least ``min_len`` real items."""
    real = F.col("item_id") >= FIRST
    inner = F.when(F.col("gap_s") <= 1800, F.col("gap_s"))
    by = seqs.groupBy("session_id", "user_id").agg(
        F.min("ts").alias("start_ts"), F.count("*").alias("n_events"), F.count_if(real).alias("n_real"), F.countDistinct(F.when(real, F.col("item_id"))).alias("n_unique"), F.coalesce(F.median(inner), F.lit(0.0)).alias("median_gap")
    )
    kept = by.where((F.col("n_events") >= min_len) & (F.col("n_real") >= min_len))
    return kept.select("session_id", "user_id", "start_ts", "n_events", "n_unique", F.round(1 - F.col("n_unique") / F.col("n_real"), 9).alias("repeat_frac"), "median_gap", hour_of_day(F.col("start_ts")).alias("hour_utc"))


def session_vectors(seqs: DataFrame, vectors: DataFrame, min_len: int = 3) -> DataFrame:
    """``session_id, vectors``: a unit vector for each session that has enough real items and a direction."""
    real = seqs.where(F.col("item_id") >= FIRST)
    enough = session_behaviour(seqs, min_len).select("session_id")
    weights = real.join(enough, "session_id", "left_semi").groupBy("session_id", "item_id").agg(F.count("*").alias("n"))
    return centroids(weights, vectors, ["session_id"]).withColumnRenamed("c", "vectors")


def session_signals(events: DataFrame) -> DataFrame:
    """``session_id, mean_seconds, skip_rate, shuffle_rate``; null where a session has no such value."""
    rate = lambda c: F.round(F.avg(F.col(c).cast("double")), 9)
    return events.groupBy("session_id").agg(F.round(F.avg(F.col("ms_played").cast("double")) / 1000, 9).alias("mean_seconds"), rate("skipped").alias("skip_rate"), rate("shuffle").alias("shuffle_rate"))


def with_signals(sessions: DataFrame, signals: DataFrame) -> DataFrame:
    """``sessions`` with the columns of :func:`session_signals`; null for a session that has none."""
    return sessions.drop("mean_seconds", "skip_rate", "shuffle_rate").join(signals, "session_id", "left")


def signal_profile(sessions: DataFrame, cluster: str = "cluster") -> DataFrame:
    """``cluster`` and the means of its sessions' signals, over those that have them."""
    mean = lambda c: F.round(F.avg(F.col(c).cast("double")), 6).alias(c)
    return sessions.groupBy(cluster).agg(mean("mean_seconds"), mean("skip_rate"), mean("shuffle_rate"))


def cluster_profile(sessions: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Size, share, means, and hours of each cluster of sessions; the peak hour is the lowest of the fullest."""
    total = sessions.count()
    hours = sessions.groupBy(cluster, "hour_utc").agg(F.count("*").alias("n"))
    histogram = hours.groupBy(cluster).agg(F.map_from_entries(F.collect_list(F.struct(F.col("hour_utc").cast("int"), "n"))).alias("h")).select(cluster, F.transform(F.sequence(F.lit(0), F.lit(23)), lambda i: F.coalesce(F.col("h")[i.cast("int")], F.lit(0)).cast("int")).alias("hour_histogram"))
    by = sessions.groupBy(cluster).agg(F.count("*").alias("n_sessions"), F.round(F.avg("n_events"), 6).alias("mean_length"), F.round(F.avg("n_unique"), 6).alias("mean_unique"), F.round(F.avg(F.col("repeat_frac").cast("double")), 6).alias("mean_repeat_frac"))
    middle = grouped_quantiles(sessions, cluster, "median_gap", [0.5]).select(cluster, F.round("value", 6).alias("median_gap_s"))
    out = by.join(middle, cluster, "left").join(histogram, cluster).withColumn("total", F.lit(total))
    return out.select(cluster, "n_sessions", F.round(F.col("n_sessions") / F.col("total"), 6).alias("share"), "mean_length", "mean_unique", "mean_repeat_frac", "median_gap_s", (F.array_position("hour_histogram", F.array_max("hour_histogram")) - 1).cast("int").alias("peak_hour"), "hour_histogram")


def lift_labels(plays: DataFrame, cluster: str = "cluster", label: str = "label", support: int = 5, top: int = 5) -> DataFrame:
    """``cluster, place, label, lift, share, count``: labels over-represented in a cluster, at most ``top`` each.

    Ordered by rounded lift, count and label.
    """
    counts = plays.groupBy(cluster, label).agg(F.count("*").alias("count"))
    of = counts.groupBy(cluster).agg(F.sum("count").alias("in_cluster"))
    every = counts.groupBy(label).agg(F.sum("count").alias("everywhere"))
    total = counts.agg(F.sum("count")).first()[0]
    scored = counts.where(F.col("count") >= support).join(of, cluster).join(every, label).withColumn("total", F.lit(total).cast("bigint"))
    share = F.col("count") / F.col("in_cluster")
    scored = scored.select(cluster, label, F.round(share / (F.col("everywhere") / F.col("total")), 3).alias("lift"), F.round(share, 4).alias("share"), "count")
    w = Window.partitionBy(cluster).orderBy(F.desc("lift"), F.desc("count"), label)
    return scored.withColumn("place", F.row_number().over(w)).where(F.col("place") <= top)
