"""Play logs as text with six tab-separated fields and no header or quotes."""

from __future__ import annotations

from pathlib import PurePath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listenloom.runtime import hadoop_fs
from listenloom.schema import conform

#: Name looked for in a folder.
DEFAULT_FILE = "userid-timestamp-artid-artname-traid-traname.tsv"
SOURCE = "lastfm-1k"
# Words that one common reader takes for null; only on request, as they are real names too.
NULL_WORDS = ("", "NA", "N/A", "NaN", "nan", "null", "NULL", "None", "n/a", "#N/A", "<NA>", "-nan", "-NaN", "1.#IND", "1.#QNAN", "#NA", "-1.#IND", "-1.#QNAN", "#N/A N/A")


def first_users(df: DataFrame, n: int) -> DataFrame:
    """Whole histories of the ``n`` users first in order."""
    some = df.select("user_id").distinct().orderBy("user_id").limit(n)
    return df.join(F.broadcast(some) if n <= 1_000_000 else some, "user_id", "left_semi")


def read_play_log(spark: SparkSession, path: str, limit: int | None = None, users: int | None = None, null_words: bool = False) -> DataFrame:
    """Canonical events and ``seq``, the place in the file.

    Fields are user, ``yyyy-MM-ddTHH:mm:ssZ``, artist id, artist, track id, track. Lines with
    more fields are skipped, missing ones are null; rows without time, artist or track are
    left out, repeated plays stay. ``limit`` takes the first lines, ``users`` the first users.
    """
    fs, p = hadoop_fs(spark, path)
    if not fs.exists(p):
        raise FileNotFoundError(path)
    if fs.getFileStatus(p).isDirectory() and fs.exists(hadoop_fs(spark, f"{path}/{DEFAULT_FILE}")[1]):
        path = f"{path}/{DEFAULT_FILE}"
    lines = spark.read.text(path).select("value", F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("k")).alias("at"))
    if limit is not None:
        lines = lines.orderBy("at").limit(limit)
    f = F.split("value", "\t", -1)
    field = lambda i: F.when(F.size(f) > i, F.nullif(f[i], F.lit("")))
    rows = lines.where(F.size(f) <= 6).select(field(0).alias("user_id"), F.unix_seconds(F.try_to_timestamp(field(1), F.lit("yyyy-MM-dd'T'HH:mm:ssX"))).alias("ts"), field(3).alias("artist"), field(5).alias("track"), "at")
    if null_words:
        rows = rows.withColumns({c: F.when(~F.col(c).isin(*NULL_WORDS), F.col(c)) for c in ("artist", "track")})
    rows = rows.where("ts is not null and artist is not null and track is not null")
    if users is not None:
        rows = first_users(rows, users)
    return conform(rows, SOURCE, keep=("at",)).withColumnRenamed("at", "seq")


def corpus_stem(path: str) -> str:
    """A name for outputs after the corpus they come from, so that two corpora don't overwrite each other."""
    return PurePath(path).stem.replace(" ", "_") or "corpus"
