"""The canonical event table: columns, coercion and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENTS = T.StructType(
    [
        T.StructField("user_id", T.StringType(), False),
        T.StructField("ts", T.LongType(), False),
        T.StructField("artist", T.StringType(), False),
        T.StructField("track", T.StringType(), False),
        T.StructField("ms_played", T.LongType()),
        T.StructField("skipped", T.BooleanType()),
        T.StructField("shuffle", T.BooleanType()),
        T.StructField("offline", T.BooleanType()),
        T.StructField("source", T.StringType()),
    ]
)
REQUIRED = ["user_id", "ts", "artist", "track"]
OPTIONAL = ["ms_played", "skipped", "shuffle", "offline"]


class ConformError(ValueError):
    """The input can't be an event table."""


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], EVENTS)


def conform(df: DataFrame, source: str | None = None, keep: tuple[str, ...] = (), guard: float | None = 0.5) -> DataFrame:
    """``df`` with exactly the canonical columns (and those in ``keep``).

    Missing optional columns become null, values that can't be cast become null, rows
    that lack a required value or whose ``ts`` isn't positive are dropped. With ``guard``
    an input that would lose more than that part of its rows raises, as it was most
    likely read with the wrong columns; the check is one aggregate over the input.
    """
    missing = [c for c in REQUIRED if c not in df.columns]
    if missing:
        raise ConformError(f"missing columns: {', '.join(missing)}")
    cast = []
    for field in EVENTS:
        if field.name == "source":
            cast.append((F.lit(source) if source is not None else F.col("source") if "source" in df.columns else F.lit(None)).cast("string").alias("source"))
        elif field.name in df.columns:
            cast.append(F.col(f"`{field.name}`").try_cast(field.dataType).alias(field.name))
        else:
            cast.append(F.lit(None).cast(field.dataType).alias(field.name))
    typed = df.select(*cast, *[F.col(f"`{c}`") for c in keep])
    whole = F.col("user_id").isNotNull() & F.col("ts").isNotNull() & F.col("artist").isNotNull() & F.col("track").isNotNull() & (F.col("ts") > 0)
    if guard is not None:
        rows, good = typed.agg(F.count("*"), F.count_if(whole)).first()
        if rows and good < rows * (1 - guard):
            raise ConformError(f"{rows - good} of {rows} rows lack a required value")
    return typed.where(whole)


def validate_report(df: DataFrame, seq: str, slices: int = 10_000) -> DataFrame:
    """One row: ``n_rows, n_null, n_not_positive, n_out_of_order``; the last counts rows earlier than the one before in ``seq``.

    Rows are compared inside slices of ``seq``, and the last of a slice with the first of
    the user's next one, so that no task orders all rows of a user.
    """
    low, high = df.agg(F.min(seq), F.max(seq)).first()
    width = max(1, (high - low) // slices) if low is not None else 1
    part = F.coalesce(F.floor((F.col(seq) - F.lit(low)) / F.lit(width)), F.lit(-1)) if low is not None else F.lit(-1)
    null = F.greatest(*[F.col(c).isNull().cast("int") for c in REQUIRED])
    rows = df.select("user_id", "ts", F.col(seq).alias("seq"), null.alias("null"), part.alias("slice"))
    inside = rows.withColumn("back", F.lag("ts").over(Window.partitionBy("user_id", "slice").orderBy("seq")) > F.col("ts"))
    by = inside.groupBy("user_id", "slice").agg(F.count("*").alias("n"), F.sum("null").alias("null"), F.count_if(F.col("ts") <= 0).alias("low"), F.count_if("back").alias("back"), F.min_by(F.struct("ts"), F.coalesce("seq", F.lit(low))).alias("first"), F.max_by(F.struct("ts"), F.coalesce("seq", F.lit(low))).alias("last"))
    over = F.lag("last").over(Window.partitionBy("user_id").orderBy("slice"))  # at most ``slices`` rows a user
    met = by.withColumn("over", F.coalesce((over["ts"] > F.col("first.ts")).cast("int"), F.lit(0)))
    some = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return met.agg(some("n").alias("n_rows"), F.sum("null").cast("bigint").alias("n_null"), some("low").alias("n_not_positive"), (some("back") + some("over")).alias("n_out_of_order"))


def validate(df: DataFrame, seq: str) -> None:
    """Raise unless ``df`` is a valid event table in the order of ``seq``."""
    r = validate_report(df, seq).first()
    if r.n_rows and (r.n_null or r.n_not_positive or r.n_out_of_order):
        raise ConformError(f"not a valid event table: {r.asDict()}")
