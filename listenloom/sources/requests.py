"""Histories that come with a request, and made-up ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MAX_PLAYS, MAX_NAME, MAX_BATCH = 5000, 512, 32
_SCHEMA = "instance_id string, artist string, track string, ts bigint"


def request_histories(spark: SparkSession, histories: list[list[tuple[str, str, int]]]) -> DataFrame:
    """``instance_id, artist, track, ts`` of up to 32 histories of up to 5,000 plays."""
    if not 1 <= len(histories) <= MAX_BATCH:
        raise ValueError(f"a request has 1 to {MAX_BATCH} histories")
    rows = []
    for i, history in enumerate(histories):
        if len(history) > MAX_PLAYS:
            raise ValueError(f"a history has at most {MAX_PLAYS} plays")
        for artist, track, ts in history:
            if not (1 <= len(artist) <= MAX_NAME and 1 <= len(track) <= MAX_NAME and ts > 0):
                raise ValueError("a play needs names of 1 to 512 characters and a positive time")
            rows.append((str(i), artist, track, int(ts)))
    return spark.createDataFrame(rows, _SCHEMA)


def sample_history(vocab: DataFrame, n: int = 20, now: int = 1_700_000_000) -> DataFrame:
    """``artist, track, ts``: the first ``n`` (1 to 200) items as if played in a row, with a longer break before every seventh."""
    n = max(1, min(n, 200))
    head = vocab.where(F.col("item_id").between(2, n + 1)).select("item_id", "artist", "track")
    gap = F.when((F.col("item_id") - 2) % 7 == 6, 9000).otherwise(210)
    order = Window.orderBy("item_id")  # at most 200 rows
    at = head.withColumn("at", F.sum(gap).over(order))
    return at.select("artist", "track", (F.lit(now) - F.max("at").over(Window.partitionBy()) + F.col("at")).cast("bigint").alias("ts"))


def random_histories(spark: SparkSession, n_items: int, requests: int = 100, length: int = 200, now: int = 1_700_000_000, seed: int = 0) -> DataFrame:
    """``instance_id, item_id, ts``: plays of random items 210 s apart, alike for one seed."""
    rows = spark.range(requests * length)
    item = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(max(1, n_items - 2))) + 2
    return rows.select(F.floor(F.col("id") / length).cast("string").alias("instance_id"), item.alias("item_id"), (F.lit(now) - (length - F.col("id") % length) * 210).cast("bigint").alias("ts"))
