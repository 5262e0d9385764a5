"""Kinds of sessions by k-means, the number of kinds by silhouette."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listenloom.runtime import materialize


def choose_kinds(sessions: DataFrame, k_range: tuple[int, int] = (3, 8), sample: int = 50_000, starts: int = 3, seed: int = 0):
    """``(model, {k: silhouette})``, the model of the best k.

    Models are fitted on at most ``sample`` sessions, first in the order of a digest of
    their ids; of several starts for one k the one of least cost counts. Ties go to the lower k.
    """
    rows = sessions.where(F.col("vectors").isNotNull()).select("session_id", array_to_vector(F.transform("vectors", lambda x: x.cast("double"))).alias("features"))
    few = materialize(rows.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("session_id").cast("string")))).limit(sample), "kinds-sample")
    n = few.count()
    if n <= k_range[0]:
        raise ValueError("too few sessions to tell kinds apart")
    judge = ClusteringEvaluator(featuresCol="features", predictionCol="cluster")
    models, scores = {}, {}
    for k in range(k_range[0], min(k_range[1], n - 1) + 1):
        fitted = [KMeans(k=k, seed=seed + s, featuresCol="features", predictionCol="cluster").fit(few) for s in range(starts)]
        models[k] = min(fitted, key=lambda m: m.summary.trainingCost)
        placed = models[k].transform(few)
        scores[k] = judge.evaluate(placed) if placed.select("cluster").distinct().count() > 1 else -1.0
    return models[max(scores, key=lambda k: (scores[k], -k))], scores


def assign_kinds(sessions: DataFrame, model) -> DataFrame:
    """``sessions`` with ``cluster``; those without a vector are left out."""
    rows = sessions.where(F.col("vectors").isNotNull()).withColumn("features", array_to_vector(F.transform("vectors", lambda x: x.cast("double"))))
    return model.transform(rows).drop("features")


def kinds_summary(placed: DataFrame, total_sessions: int, scores: dict[int, float]) -> DataFrame:
    """One row: ``k, clustered_sessions, total_sessions, silhouette`` by k."""
    best = max(scores, key=lambda k: (scores[k], -k))
    by_k = F.create_map(*[F.lit(x) for k, v in sorted(scores.items()) for x in (int(k), float(v))])
    return placed.agg(F.lit(best).alias("k"), F.count("*").alias("clustered_sessions"), F.lit(total_sessions).cast("bigint").alias("total_sessions"), by_k.alias("silhouette"))
