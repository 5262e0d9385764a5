"""Tags of items from a service's replies, kept so that nothing is asked for twice.

How a reply is got is left to a function given from outside, which executors call; what
it means, what is kept and how an interrupted run goes on is here.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from listenloom.operators.features import uncached
from listenloom.runtime import hadoop_fs

#: Replies hold a list of tags, or one tag by itself.
_MANY = "struct<toptags: struct<tag: array<struct<name: string, count: string>>>>"
_ONE = "struct<toptags: struct<tag: struct<name: string, count: string>>>"
_CACHE = "key string, tags array<string>"


def tags_of(reply: Column, min_count: int = 1, most: int = 10) -> Column:
    """Names of a reply's tags: lower case, blank ones left out, at least ``min_count`` strong, the first ``most``.

    A null or unreadable reply gives an empty array; a strength that isn't a number is 0.
    """
    many, one = F.from_json(reply, _MANY)["toptags"]["tag"], F.from_json(reply, _ONE)["toptags"]["tag"]
    tags = F.coalesce(many, F.when(one["name"].isNotNull(), F.array(one)), F.array().cast("array<struct<name: string, count: string>>"))
    kept = F.filter(tags, lambda t: (F.trim(F.coalesce(t["name"], F.lit(""))) != "") & (F.coalesce(t["count"].try_cast("int"), F.lit(0)) >= min_count))
    return F.slice(F.transform(kept, lambda t: F.lower(F.trim(t["name"]))), 1, most)


class TagCache:
    """``key, tags`` under a folder; an empty array is a known miss. Every addition is a part of its own, which a cut-off write leaves out."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _parts(self) -> list[str]:
        fs, p = hadoop_fs(self.spark, self.path)
        if not fs.exists(p):
            return []
        found = [f.getPath().toString() for f in fs.listStatus(p) if f.isDirectory()]
        return sorted(x for x in found if fs.exists(hadoop_fs(self.spark, f"{x}/_SUCCESS")[1]))

    def read(self) -> DataFrame:
        """One row per key; of several additions the one with tags holds."""
        parts = self._parts()
        if not parts:
            return self.spark.createDataFrame([], _CACHE)
        return self.spark.read.schema(_CACHE).parquet(*parts).groupBy("key").agg(F.max("tags").alias("tags"))

    def add(self, tags: DataFrame) -> None:
        tags.select("key", F.col("tags").cast("array<string>").alias("tags")).write.parquet(f"{self.path}/{uuid.uuid4().hex}")


def fetch_tags(items: DataFrame, cache: TagCache, ask: Callable[[str], str | None], rate: float = 5.0, tasks: int = 1, step: int = 5000, limit: int | None = None, min_count: int = 1, most: int = 10) -> DataFrame:
    """The cache with the tags of ``items`` (``key``), asked for ``step`` keys at a time.

    ``ask`` gives the reply to a key, or None; one that raises is asked again by the next run.
    All tasks together ask at most ``rate`` times a second. What was fetched stays, so a
    run may be cut off and started again.
    """
    pause = tasks / rate if rate > 0 else 0.0

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            keys, replies = [], []
            for key in pdf["key"]:
                began = time.monotonic()
                try:
                    reply = ask(key)
                except Exception:  # a key that fails must not cost the others
                    continue
                keys.append(key)
                replies.append(reply)
                time.sleep(max(0.0, pause - (time.monotonic() - began)))
            yield pd.DataFrame({"key": pd.Series(keys, dtype=object), "reply": pd.Series(replies, dtype=object)})

    left = limit
    while left is None or left > 0:
        some = uncached(items, cache.read(), step if left is None else min(step, left))
        wanted = some.count()
        if not wanted:
            break
        before = cache.read().count()
        cache.add(some.repartition(tasks).mapInPandas(run, "key string, reply string").select("key", tags_of(F.col("reply"), min_count, most).alias("tags")))
        left = None if left is None else left - wanted
        if cache.read().count() == before:  # every one of them failed
            break
    return cache.read()
