"""Sessions and calendar windows over a stream of plays.

Late plays are merged while their session's state is kept, that is until the
watermark has passed its end; older ones need the session table, which has no
such limit (``listenloom.operators.session_table``) and takes micro-batches by
``foreachBatch``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from listenloom.operators.session_table import SessionTable


def event_times(events: DataFrame, delay: str) -> DataFrame:
    return events.withColumn("at", F.timestamp_seconds("ts")).withWatermark("at", delay)


def stream_sessions(events: DataFrame, gap: int = 1800, delay: str = "7 days") -> DataFrame:
    """``user_id, start_ts, end_ts, n_plays``: a gap of more than ``gap`` whole seconds opens a session.

    The window asked for is half a second longer, so that it doesn't matter on which side of its end Spark counts.
    """
    by = event_times(events, delay).groupBy("user_id", F.session_window("at", f"{gap * 1000 + 500} milliseconds"))
    return by.agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count("*").alias("n_plays")).drop("session_window")


def stream_windows(events: DataFrame, days: int = 90, origin: int = 0, delay: str = "7 days") -> DataFrame:
    """``user_id, window_start, n_plays, n_tracks`` in windows of ``days`` from ``origin`` on."""
    width = days * 86_400
    by = event_times(events, delay).groupBy("user_id", F.window("at", f"{width} seconds", startTime=f"{origin % width} seconds"))
    return by.agg(F.count("*").alias("n_plays"), F.approx_count_distinct("track").alias("n_tracks")).select("user_id", F.unix_seconds("window.start").alias("window_start"), "n_plays", "n_tracks")


def keep_sessions(events: DataFrame, table: SessionTable, checkpoint: str, **columns: str) -> StreamingQuery:
    """Apply every micro-batch of what is there now to a session table, however late its plays.

    A batch that was applied but not yet acknowledged is applied again without effect,
    since the table's ledger knows its plays.
    """
    return events.writeStream.foreachBatch(lambda batch, _: table.apply(batch, **columns)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
