"""Seconds, hours, windows and gaps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Seconds at which a gap enters the next bucket, from a second to a year.
GAP_EDGES = [1, 5, 10, 30, 60, 120, 300, 600, 1800, 3600, 7200, 21600, 43200, 86400, 172800, 604800, 1209600, 2592000, 7776000, 15552000, 31536000]


def to_unix_seconds(c: Column) -> Column:
    """Whole seconds of an ISO stamp, UTC where it names no zone; null where it can't be read. Rounded down."""
    return F.floor(F.unix_micros(F.try_to_timestamp(c)) / F.lit(1_000_000)).cast("bigint")


def display_stamp(ts: Column) -> Column:
    """``2011-03-01 07:00:00+00:00``, whatever zone the session is in."""
    moment = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=ts.cast("decimal(18,6)"))
    return F.concat(moment.cast("string"), F.lit("+00:00"))


def hour_of_day(ts: Column) -> Column:
    return F.pmod(F.floor(ts / F.lit(3600)), F.lit(24)).cast("int")


def window_number(ts: Column, origin: Column, days: int) -> Column:
    """Windows of ``days`` from ``origin``; negative before it."""
    return F.floor((ts - origin) / F.lit(days * 86_400)).cast("bigint")


def gap_bucket(gap: Column) -> Column:
    """1 for the first event of a user (null), else 2 plus the number of edges the gap has reached; negative gaps count as 0."""
    edges = F.array(*[F.lit(e).cast("bigint") for e in GAP_EDGES])
    return F.when(gap.isNull(), 1).otherwise(F.size(F.filter(edges, lambda e: e <= F.greatest(gap, F.lit(0).cast("bigint")))) + 2).cast("int")
