"""Queries p5 and p7, time stamps and sessions, and the same from streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listenloom.operators.session_table import SessionTable
from listenloom.operators.timestamps import normalise_timestamps
from listenloom.operators.usable import usable_plays
from listenloom.runtime import fresh_path
from listenloom.streaming.windows import keep_sessions
from listenloom.streaming.windows import stream_windows as calendar_windows


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``raw_id, ts_utc`` of every record whose stamp denotes a moment after 1970-01-01T00:00:00Z."""
    raw = spark.read.parquet(f"{sf_dir}/raw_plays.parquet").select("raw_id", "ts", "device_tz", "locale_code", "source")
    return normalise_timestamps(raw).where(F.col("raw_id").isNotNull() & (F.col("utc_seconds") > 0)).select("raw_id", F.col("utc_seconds").alias("ts_utc")).distinct()


#: Batches by time of arrival in which p7_found fills its session table.
BATCHES = 3


def p7_found(spark: SparkSession, sf_dir: str, batches: int = BATCHES) -> DataFrame:
    """``user_id, start_ts, end_ts, n_plays`` of every session of usable plays.

    The table is filled batch by batch in order of arrival, as a nightly job would.
    """
    plays = spark.read.parquet(f"{sf_dir}/plays.parquet")
    table = SessionTable(spark, fresh_path(spark, "sessions"))
    arrived, kind = F.col("ingested_at"), plays.schema["ingested_at"].dataType
    at = F.percentile_approx(F.unix_micros(arrived.cast("timestamp")), [i / batches for i in range(1, batches)], 1000)
    cuts = (plays.select(at).first()[0] or []) if batches > 1 else []
    # compared as stored, so that a batch reads only the row groups it is in
    edges = [None, *[F.timestamp_micros(F.lit(c)).cast(kind) for c in sorted(set(cuts))], None]
    for low, high in zip(edges, edges[1:]):
        part = plays
        if high is not None:
            part = part.where(arrived <= high if low is not None else (arrived <= high) | arrived.isNull())
        if low is not None:
            part = part.where(arrived > low)
        table.apply(usable_plays(part).select("play_id", "user_id", "ts"))
    return table.sessions().select(F.col("owner").alias("user_id"), F.col("start").alias("start_ts"), F.col("stop").alias("end_ts"), F.col("n").alias("n_plays"))


SESSIONS_SQL = """
WITH usable AS (
  SELECT DISTINCT play_id, user_id, ts FROM plays
  WHERE play_id IS NOT NULL AND user_id IS NOT NULL AND ts > 0 AND regexp_matches(artist, '[^\\s\\x{00a0}]') AND regexp_matches(track, '[^\\s\\x{00a0}]')
), marked AS (
  SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, play_id) <= 1800 THEN 0 ELSE 1 END AS opens FROM usable
), numbered AS (
  SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, play_id ROWS UNBOUNDED PRECEDING) AS k FROM marked
)
SELECT user_id, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS n_plays FROM numbered GROUP BY user_id, k
"""

WINDOW_DAYS = 90


def _play_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The play table, one file or a folder of them, as a stream of its files."""
    schema = spark.read.parquet(f"{sf_dir}/plays.parquet").schema
    # a pattern: Spark takes a plain path for a folder
    return usable_plays(spark.readStream.schema(schema).parquet(f"{sf_dir}/play[s].parquet"))


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`p7_found` from a stream whose micro-batches are applied to a session table."""
    table = SessionTable(spark, fresh_path(spark, "sessions"))
    keep_sessions(_play_stream(spark, sf_dir).select("play_id", "user_id", "ts"), table, fresh_path(spark, "progress")).awaitTermination()
    return table.sessions().select(F.col("owner").alias("user_id"), F.col("start").alias("start_ts"), F.col("stop").alias("end_ts"), F.col("n").alias("n_plays"))


def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries of usable plays by user and window of the calendar, from a stream."""
    out = fresh_path(spark, "windows")
    counted = calendar_windows(_play_stream(spark, sf_dir), WINDOW_DAYS).select("user_id", "window_start", "n_plays")
    spark.createDataFrame([], counted.schema).write.parquet(out)  # what a stream without a file leaves there
    query = counted.writeStream.outputMode("complete").foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out)).option("checkpointLocation", fresh_path(spark, "progress")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(counted.schema).parquet(out)


WINDOWS_SQL = f"""
SELECT user_id, ts // {WINDOW_DAYS * 86_400} * {WINDOW_DAYS * 86_400} AS window_start, count(*) AS n_plays FROM plays
WHERE play_id IS NOT NULL AND user_id IS NOT NULL AND ts > 0 AND regexp_matches(artist, '[^\\s\\x{{00a0}}]') AND regexp_matches(track, '[^\\s\\x{{00a0}}]') GROUP BY 1, 2
"""

QUERIES = {"p5_found": p5_found, "p7_found": p7_found, "stream_sessions": stream_sessions, "stream_windows": stream_windows}
ORACLES = {"p7_found": SESSIONS_SQL, "stream_sessions": SESSIONS_SQL, "stream_windows": WINDOWS_SQL}
