"""Held-out targets, their ranks under sparse scorers, and metrics by slice.

A rank counts the items that score at least as high as the target, less one, over
the whole catalogue. No scorer fills a matrix of targets and items: each gives
scores to few items per target, and what all others score alike is counted in
closed form.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from listenloom.operators.ordered import histories, lagged_pairs
from listenloom.operators.vocab import FIRST, OOV
from listenloom.runtime import materialize

MAX_LEN = 200
KS = (5, 10, 20)
SLICES = ["overall", "repeat", "novel", "cold_user", "cold_item", "cold_start"]
DAY = 86_400


# instances -----------------------------------------------------------------------------
def _taken(seqs: DataFrame, cutoff: int, max_per_user: int, seed: int) -> DataFrame:
    eligible = seqs.where((F.col("ts") >= cutoff) & (F.col("pos") > 0))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), "user_id", F.lit(":"), F.col("pos").cast("string")))
    w = Window.partitionBy("user_id").orderBy("__d", "pos")  # Spark keeps only the first rows of each group while it shuffles
    return eligible.withColumn("__d", digest).withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= max_per_user)


def oov_report(seqs: DataFrame, cutoff: int, max_per_user: int = 50, seed: int = 0) -> DataFrame:
    """One row: ``n_taken, n_oov, oov_frac``: targets that :func:`eval_instances` takes, and those of them it leaves out as unknown."""
    unknown = F.col("item_id") <= OOV
    return _taken(seqs, cutoff, max_per_user, seed).agg(F.count("*").alias("n_taken"), F.count_if(unknown).alias("n_oov"), F.coalesce(F.round(F.avg(unknown.cast("int")), 9), F.lit(0.0)).alias("oov_frac"))


def eval_instances(seqs: DataFrame, cutoff: int, holdout: DataFrame, train_items: DataFrame, max_per_user: int = 50, seed: int = 0) -> DataFrame:
    """``instance_id, user_id, pos, ts, target, is_repeat, is_cold_user, is_cold_item``.

    Targets are events at or after the cutoff that aren't a user's first. Of a user with
    more than ``max_per_user`` those are taken that come first by a digest; unknown items
    are left out after that. ``is_repeat``: the item is at an earlier position.
    """
    taken = _taken(seqs, cutoff, max_per_user, seed).where(F.col("item_id") > OOV)
    first = seqs.groupBy("user_id", "item_id").agg(F.min("pos").alias("__first"))
    out = taken.join(first, ["user_id", "item_id"]).select("user_id", "pos", "ts", F.col("item_id").alias("target"), (F.col("__first") < F.col("pos")).alias("is_repeat"))
    cold = holdout.select("user_id", F.lit(True).alias("is_cold_user"))
    known = train_items.select(F.col("item_id").alias("target"), F.lit(False).alias("is_cold_item")).distinct()
    out = out.join(cold, "user_id", "left").join(known, "target", "left")
    return out.select(F.concat_ws(":", "user_id", "pos").alias("instance_id"), "user_id", "pos", "ts", "target", "is_repeat", F.coalesce("is_cold_user", F.lit(False)).alias("is_cold_user"), F.coalesce("is_cold_item", F.lit(True)).alias("is_cold_item"))


def instance_summary(instances: DataFrame) -> DataFrame:
    """One row: ``n, users`` and the parts that are repeats, of users held out, and of items not trained on."""
    part = lambda c: F.round(F.avg(F.col(c).cast("double")), 9)
    return instances.agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), part("is_repeat").alias("repeat_frac"), part("is_cold_user").alias("cold_user_frac"), part("is_cold_item").alias("cold_item_frac"))


# ranks ------------------------------------------------------------------------------------
def popularity_ranks(instances: DataFrame, counts: DataFrame, n_items: int, optimistic: bool = False) -> DataFrame:
    """``instances`` with ``rank`` by training count; items never trained on count 0. ``optimistic`` ranks count higher items only."""
    by = counts.groupBy("cnt").agg(F.count("*").alias("n"))  # at most about sqrt(2 * events) rows
    above = by.withColumn("at_least", F.sum("n").over(Window.orderBy(F.desc("cnt"))))
    known = counts.join(above, "cnt").select(F.col("item_id").alias("target"), (F.col("at_least") - F.col("n") if optimistic else F.col("at_least") - 1).alias("place"))
    unseen = counts.count() if optimistic else n_items - 1
    return instances.join(known, "target", "left").withColumn("rank", F.coalesce(F.col("place"), F.lit(unseen)).cast("bigint")).drop("place")


def repeat_scores(instances: DataFrame, seqs: DataFrame, counts: DataFrame, halflife_days: float = 7.0, boost: float = 1.5, pop_weight: float = 0.15, max_len: int = MAX_LEN) -> DataFrame:
    """``instance_id, item_id, pop, score``: played items of each instance's history.

    A play weighs ``2 ** -(age / halflife)`` against the last play of the history, times
    ``boost`` in its session; the item's log count adds up to ``pop_weight``.
    """
    past = histories(instances, seqs, max_len, ["ts", "item_id", "session_no"])
    last = past.groupBy("instance_id").agg(F.max("ts").alias("now"), F.max_by("session_no", "pos").alias("session"))
    decay = math.log(2.0) / (halflife_days * DAY)
    weight = F.exp(-F.lit(decay) * (F.col("now") - F.col("ts"))) * F.when(F.col("session_no") == F.col("session"), F.lit(boost)).otherwise(1.0)
    played = past.join(last, "instance_id").where(F.col("item_id") >= FIRST).groupBy("instance_id", "item_id").agg(F.sum(weight).alias("w"))
    return played.join(counts, "item_id", "left").select("instance_id", "item_id", _pop(F.coalesce("cnt", F.lit(0)), counts, pop_weight).alias("pop"), "w").select("instance_id", "item_id", "pop", F.round(F.col("pop") + F.col("w"), 9).alias("score"))


def _top_count(counts: DataFrame) -> int:
    return counts.agg(F.max("cnt")).first()[0] or 0


def _pop(cnt: Column, counts: DataFrame, pop_weight: float) -> Column:
    top = math.log1p(_top_count(counts)) or 1.0
    return F.lit(pop_weight) * F.log1p(cnt) / F.lit(top)


def repeat_ranks(instances: DataFrame, seqs: DataFrame, counts: DataFrame, n_items: int, optimistic: bool = False, **how) -> DataFrame:
    """``instances`` with ``rank`` and ``score`` by recency and habit.

    Of the items that weren't played only the number with a high enough count matters.
    """
    weight = how.get("pop_weight", 0.15)
    played = materialize(repeat_scores(instances, seqs, counts, **how), "repeat-scores")
    asked = instances.join(counts.select(F.col("item_id").alias("target"), "cnt"), "target", "left").withColumn("own_pop", _pop(F.coalesce("cnt", F.lit(0)), counts, weight)).drop("cnt")
    own = played.select("instance_id", F.col("item_id").alias("target"), F.col("score").alias("own_score"))
    asked = asked.join(own, ["instance_id", "target"], "left").withColumn("score", F.coalesce("own_score", F.round("own_pop", 9)))
    by = sorted((r.cnt, r.n) for r in counts.groupBy("cnt").agg(F.count("*").alias("n")).collect())  # at most about sqrt(2 * events) rows
    top = math.log1p(by[-1][0]) if by else 1.0
    pops = np.array([0.0, *[round(weight * math.log1p(c) / top, 9) for c, _ in by]])
    sizes = np.array([max(0, n_items - sum(n for _, n in by)), *[n for _, n in by]])
    at_least = np.r_[np.cumsum(sizes[::-1])[::-1], 0]

    @F.pandas_udf(LongType())
    def popular(score: pd.Series) -> pd.Series:
        return pd.Series(at_least[np.searchsorted(pops, score.to_numpy() + (1e-12 if optimistic else -1e-12), side="left")])

    against = played.join(asked.select("instance_id", F.col("score").alias("s")), "instance_id")
    beats = (lambda c: c > F.col("s")) if optimistic else (lambda c: c >= F.col("s"))
    beaten = against.groupBy("instance_id").agg(F.count_if(beats(F.round("pop", 9))).alias("by_pop"), F.count_if(beats(F.col("score"))).alias("by_score"))
    out = asked.join(beaten, "instance_id", "left")
    return out.withColumn("rank", popular("score") - F.coalesce("by_pop", F.lit(0)) + F.coalesce("by_score", F.lit(0)) - (0 if optimistic else 1)).drop("own_pop", "own_score", "by_pop", "by_score")


# item-to-item ----------------------------------------------------------------------------
def cooccurrence(train: DataFrame, window: int = 5, gap: int = 1800) -> DataFrame:
    """``i, j, n``: how often two items are at most ``window`` positions and ``window * gap`` seconds apart, both ways."""
    pairs = lagged_pairs(train, window, ["item_id", "ts"])
    ok = pairs.where((F.col("next_ts") - F.col("ts") <= gap * window) & (F.col("item_id") > OOV) & (F.col("next_item_id") > OOV) & (F.col("item_id") != F.col("next_item_id")))
    one = ok.groupBy(F.least("item_id", "next_item_id").alias("i"), F.greatest("item_id", "next_item_id").alias("j")).agg(F.count("*").alias("n"))
    return one.unionAll(one.select(F.col("j").alias("i"), F.col("i").alias("j"), "n"))


def similarity(co: DataFrame) -> DataFrame:
    """``i, j, sim``: counts over the root of both items' sums."""
    mass = co.groupBy("i").agg(F.sum("n").alias("m"))
    return co.join(mass, "i").join(mass.select(F.col("i").alias("j"), F.col("m").alias("mj")), "j").select("i", "j", F.round(F.col("n") / F.sqrt(F.col("m").cast("double") * F.col("mj")), 9).alias("sim"))


def nearest_items(sim: DataFrame, top: int = 200) -> DataFrame:
    """The ``top`` most similar items of each, ties by number."""
    w = Window.partitionBy("i").orderBy(F.desc("sim"), "j")
    return sim.withColumn("k", F.row_number().over(w)).where(F.col("k") <= top).drop("k")


def knn_scores(targets: DataFrame, seqs: DataFrame, sim: DataFrame, recent: int = 30, halflife: float = 8.0) -> DataFrame:
    """``instance_id, item_id, score`` of the items near each history's last ``recent`` plays."""
    past = histories(targets, seqs, recent, ["item_id"]).where(F.col("item_id") > OOV)
    newest = Window.partitionBy("instance_id").orderBy(F.desc("pos"))  # at most ``recent`` rows
    decay = math.log(2.0) / halflife
    weighed = past.withColumn("w", F.exp(-F.lit(decay) * (F.row_number().over(newest) - 1))).groupBy("instance_id", "item_id").agg(F.sum("w").alias("w"))
    return weighed.join(sim, weighed["item_id"] == sim["i"]).groupBy("instance_id", F.col("j").alias("item_id")).agg(F.round(F.sum(F.col("w") * F.col("sim")), 9).alias("score"))


def knn_ranks(instances: DataFrame, seqs: DataFrame, sim: DataFrame, n_items: int, optimistic: bool = False, **how) -> DataFrame:
    """``instances`` with ``rank`` and ``score``; items near nothing in the history score 0 and tie."""
    scores = materialize(knn_scores(instances, seqs, sim, **how), "knn-scores")
    own = scores.select("instance_id", F.col("item_id").alias("target"), F.col("score"))
    asked = instances.join(own, ["instance_id", "target"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    if optimistic:
        better = scores.join(asked.select("instance_id", F.col("score").alias("s")), "instance_id").where("score > s").groupBy("instance_id").agg(F.count("*").alias("n"))
        return asked.join(better, "instance_id", "left").withColumn("rank", F.coalesce(F.col("n"), F.lit(0)).cast("bigint")).drop("n")
    better = scores.join(asked.where("score > 0").select("instance_id", F.col("score").alias("s")), "instance_id").where("score >= s").groupBy("instance_id").agg(F.count("*").alias("n"))
    return asked.join(better, "instance_id", "left").withColumn("rank", F.coalesce(F.col("n"), F.lit(n_items)).cast("bigint") - 1).drop("n")


# metrics -----------------------------------------------------------------------------------
def sliced_metrics(ranked: DataFrame, model: str, ks: tuple[int, ...] = KS) -> DataFrame:
    """``model, slice, n`` and hit rate, NDCG and MRR at each k; empty slices have no row."""
    names = F.array_compact(
        F.array(
            F.lit("overall"),
            F.when(F.col("is_repeat"), "repeat").otherwise("novel"),
            F.when(F.col("is_cold_user"), "cold_user"),
            F.when(F.col("is_cold_item"), "cold_item"),
            F.when(F.col("is_cold_item") & ~F.col("is_repeat"), "cold_start"),
        )
    )
    rank = F.col("rank")
    metrics = []
    for k in ks:
        hit = rank < k
        metrics += [
            F.round(F.avg(F.when(hit, 1.0).otherwise(0.0)), 9).alias(f"hr_{k}"),
            F.round(F.avg(F.when(hit, 1.0 / F.log2(rank + 2.0)).otherwise(0.0)), 9).alias(f"ndcg_{k}"),
            F.round(F.avg(F.when(hit, 1.0 / (rank + 1.0)).otherwise(0.0)), 9).alias(f"mrr_{k}"),
        ]
    return ranked.withColumn("slice", F.explode(names)).groupBy("slice").agg(F.count("*").alias("n"), *metrics).withColumn("model", F.lit(model))


# recommendation ----------------------------------------------------------------------------
def recommend(scores: DataFrame, k: int = 20, history: DataFrame | None = None) -> DataFrame:
    """``instance_id, item_id, score, place``: the best ``k`` of each; with ``history`` (``instance_id, item_id``) none that was played."""
    open_ = scores if history is None else scores.join(history.select("instance_id", "item_id").distinct(), ["instance_id", "item_id"], "left_anti")
    w = Window.partitionBy("instance_id").orderBy(F.desc("score"), "item_id")
    return open_.withColumn("place", F.row_number().over(w)).where(F.col("place") <= max(1, k))


def context_report(past: DataFrame, floor: float = 0.25) -> DataFrame:
    """``instance_id, history_length, matched, coverage, cold_start`` of histories with ``item_id``."""
    n, m = F.count("*"), F.count_if(F.col("item_id") >= FIRST)
    return past.groupBy("instance_id").agg(n.alias("history_length"), m.alias("matched"), F.round(m / n, 9).alias("coverage"), (m / n < floor).alias("cold_start"))
