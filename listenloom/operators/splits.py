"""Training and test events apart by time and by user."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listenloom.operators.ordered import exact_quantile, global_rank


@dataclass
class Split:
    train: DataFrame
    test: DataFrame
    cutoff: int
    holdout: DataFrame


def one_row(parts: list[DataFrame]) -> DataFrame:
    """Summaries of one row each, side by side."""
    rows = [p.withColumn("__one", F.lit(1)) for p in parts]
    out = rows[0]
    for r in rows[1:]:
        out = out.join(r, "__one")
    return out.drop("__one")


def half_even(x: float) -> int:
    return round(x)


def temporal_split(events: DataFrame, test_frac: float = 0.15, holdout_frac: float = 0.10, seed: int = 0) -> Split:
    """Test events lie at or after the cutoff; users held out have no training events at all.

    The cutoff is the ``1 - test_frac`` quantile of ``ts``, truncated. Users are held out in
    the order of a digest of seed and name, so the choice doesn't depend on the layout.
    """
    if not 0 < test_frac < 1:
        raise ValueError("test_frac must lie between 0 and 1")
    if not 0 <= holdout_frac < 1:
        raise ValueError("holdout_frac must be at least 0 and below 1")
    at = exact_quantile(events, "ts", 1 - test_frac)
    if at is None:
        raise ValueError("no events to split")
    users = events.select("user_id").distinct()
    total = users.count()
    wanted = half_even(total * holdout_frac)
    if wanted >= total:
        raise ValueError("the holdout would leave no user to train on")
    ranked = global_rank(users.withColumn("__d", F.md5(F.concat(F.lit(f"{seed}:"), "user_id"))), [F.col("__d"), F.col("user_id")], "__k")
    holdout = ranked.where(F.col("__k") < wanted).select("user_id")
    cutoff = int(at)
    past = events.where(F.col("ts") < cutoff)
    return Split(past.join(holdout, "user_id", "left_anti"), events.where(F.col("ts") >= cutoff), cutoff, holdout)


def split_summary(split: Split) -> DataFrame:
    """One row of counts of both sides, the cutoff and the users held out."""
    a = split.train.agg(F.count("*").alias("train_events"), F.countDistinct("user_id").alias("train_users"))
    b = split.test.agg(F.count("*").alias("test_events"), F.countDistinct("user_id").alias("test_users"))
    c = split.holdout.agg(F.count("*").alias("holdout_users"))
    return one_row([a, b, c]).withColumn("cutoff_ts", F.lit(split.cutoff).cast("bigint"))


def leakage_report(split: Split) -> DataFrame:
    """One row: last training and first test time, and training events of users held out."""
    a = split.train.agg(F.max("ts").alias("max_train_ts"))
    b = split.test.agg(F.min("ts").alias("min_test_ts"))
    c = split.train.join(split.holdout, "user_id", "left_semi").agg(F.count("*").alias("holdout_events_in_train"))
    return one_row([a, b, c])


def assert_no_leakage(split: Split) -> None:
    r = leakage_report(split).first()
    if r.max_train_ts is None or r.min_test_ts is None:
        raise ValueError("one side of the split is empty")
    if r.max_train_ts >= r.min_test_ts or r.holdout_events_in_train:
        raise AssertionError(f"training data reach into the test: {r.asDict()}")
