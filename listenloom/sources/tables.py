"""Parquet datasets that know how they were made."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from listenloom.runtime import hadoop_fs, remove
from listenloom.sources.delimited import first_users

#: Raised when a change to a parser makes datasets of before invalid.
PARSER_VERSION = 1


def _sidecar(spark: SparkSession, path: str) -> dict | None:
    fs, p = hadoop_fs(spark, f"{path}.json")
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def cached_dataset(spark: SparkSession, folder: str, corpus: str, build: Callable[[], DataFrame], users: int | None = None, force: bool = False) -> DataFrame:
    """The dataset of a corpus and number of users, built unless a complete one is there.

    The sidecar beside the data is written last; without it, or with another parser
    version, the data count as unfinished.
    """
    path = f"{folder.rstrip('/')}/{corpus}-{users or 'all'}-v{PARSER_VERSION}"
    fs, p = hadoop_fs(spark, path)
    known = _sidecar(spark, path)
    if not force and fs.exists(p) and known and known.get("parser_version") == PARSER_VERSION:
        return spark.read.parquet(path)
    remove(spark, f"{path}.json")
    build().write.mode("overwrite").parquet(path)
    out = fs.create(hadoop_fs(spark, f"{path}.json")[1], True)
    out.write(bytearray(json.dumps({"corpus": corpus, "users": users, "parser_version": PARSER_VERSION, "rows": spark.read.parquet(path).count()}).encode()))
    out.close()
    return spark.read.parquet(path)


def read_events(spark: SparkSession, path: str, users: int | None = None) -> DataFrame:
    """A stored event table, or whole histories of its first users."""
    events = spark.read.parquet(path)
    return events if users is None else first_users(events, users)
