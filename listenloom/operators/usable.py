"""Which plays count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listenloom.functions.text import has_text


def usable_plays(plays: DataFrame) -> DataFrame:
    """Rows with a user, a positive time and an artist and a track that are neither null nor blank.

    Redeliveries of a ``play_id`` are still there; whoever counts must count an id once.
    """
    return plays.where(F.col("play_id").isNotNull() & F.col("user_id").isNotNull() & (F.col("ts") > 0) & has_text(F.col("artist")) & has_text(F.col("track")))
