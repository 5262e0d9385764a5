"""JSON histories as people download them, alone, in folders or in archives."""

from __future__ import annotations

import fnmatch
import io
import shutil
import zipfile
from collections.abc import Iterator
from pathlib import Path, PurePath

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from listenloom.functions.time import display_stamp, to_unix_seconds
from listenloom.operators.splits import one_row
from listenloom.operators.vocab import positives
from listenloom.runtime import hadoop_fs
from listenloom.schema import conform

# How export files are named.
EXTENDED = ("Streaming_History_Audio*.json", "endsong*.json")
ACCOUNT = ("StreamingHistory*.json",)
MAX_MEMBERS, MAX_BYTES, MAX_KEPT = 2000, 512 * 1024 * 1024, 20_000

_EXTENDED_SCHEMA = "ts string, ms_played bigint, master_metadata_track_name string, master_metadata_album_artist_name string, shuffle boolean, skipped boolean, offline boolean"
_ACCOUNT_SCHEMA = "endTime string, artistName string, trackName string, msPlayed bigint"


class ExportError(ValueError):
    """The export can't be read, for a reason its owner can be told."""


def find(spark: SparkSession, root: str, patterns: tuple[str, ...]) -> list[str]:
    """Files below ``root``, in any file system Spark reads, whose names fit, in order."""
    fs, p = hadoop_fs(spark, root)
    files, names = fs.listFiles(p, True), []
    while files.hasNext():
        names.append(files.next().getPath().toString())
    return [f for pattern in patterns for f in sorted(names) if fnmatch.fnmatch(PurePath(f).name, pattern)]


def _check_arrays(spark: SparkSession, files: list[str]) -> None:
    """Read the first bytes of each file."""
    for f in files:
        fs, p = hadoop_fs(spark, f)
        stream = fs.open(p)
        try:
            head = bytes(stream.readNBytes(4096)).decode("utf-8-sig", "replace").lstrip()
        finally:
            stream.close()
        if not head.startswith("["):
            raise ExportError(f"{PurePath(f).name} is no array of play records")


def _extended(rows: DataFrame, user: Column) -> DataFrame:
    return rows.select(user.alias("user_id"), to_unix_seconds(F.col("ts")).alias("ts"), F.col("master_metadata_album_artist_name").alias("artist"), F.col("master_metadata_track_name").alias("track"), "ms_played", "skipped", "shuffle", "offline")


def _account(rows: DataFrame, user: Column) -> DataFrame:
    """A play is told by its end; it began ``msPlayed`` earlier."""
    begun = to_unix_seconds(F.col("endTime")) - F.floor(F.coalesce("msPlayed", F.lit(0)) / F.lit(1000))
    return rows.select(user.alias("user_id"), begun.cast("bigint").alias("ts"), F.col("artistName").alias("artist"), F.col("trackName").alias("track"), F.col("msPlayed").alias("ms_played"))


def read_export(spark: SparkSession, path: str, user_id: str = "me") -> DataFrame:
    """Canonical events of a folder or a file; the extended history goes before the account's.

    Rows without a track (podcasts) are left out before the check on unusable rows.
    """
    fs, p = hadoop_fs(spark, path)
    if not fs.exists(p):
        raise FileNotFoundError(path)
    if not fs.getFileStatus(p).isDirectory():
        files, extended = [path], not PurePath(path).name.startswith("StreamingHistory")
    else:
        files = find(spark, path, EXTENDED)
        extended = bool(files)
        files = files or find(spark, path, ACCOUNT)
    if not files:
        raise FileNotFoundError(f"no history files below {path}")
    _check_arrays(spark, files)
    rows = spark.read.schema(_EXTENDED_SCHEMA if extended else _ACCOUNT_SCHEMA).option("multiLine", True).json(files)
    if rows.isEmpty():
        raise ExportError(f"no records in {len(files)} files")
    rows = (_extended if extended else _account)(rows, F.lit(user_id))
    return conform(rows.where("track is not null"), "spotify-extended" if extended else "spotify-account")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Canonical events of many archives at once, each unpacked where it is read; its name is the user.

    Of an archive that holds both kinds of history the extended one counts. An archive that
    can't be read, or unpacks to more than ``MAX_BYTES``, has no rows.
    """

    def unpack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for name, content in zip(pdf["path"], pdf["content"]):
                rows = []
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        members = [m for m in z.infolist() if not m.is_dir()]
                        if len(members) > MAX_MEMBERS or sum(m.file_size for m in members) > MAX_BYTES:
                            continue
                        for kind, patterns in (("extended", EXTENDED), ("account", ACCOUNT)):
                            fits = [m for m in members if any(fnmatch.fnmatch(PurePath(m.filename.replace("\\", "/")).name, p) for p in patterns)]
                            rows = rows or [(PurePath(name).stem, kind, z.read(m).decode("utf-8-sig", "replace")) for m in fits]
                except zipfile.BadZipFile:
                    continue
                yield pd.DataFrame(rows, columns=["user_id", "kind", "body"])

    bodies = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(unpack, "user_id string, kind string, body string")
    parts = []
    for kind, schema, shaped in (("extended", _EXTENDED_SCHEMA, _extended), ("account", _ACCOUNT_SCHEMA, _account)):
        fields = ", ".join(f"{n}: {t}" for n, t in (x.split() for x in schema.split(", ")))
        rows = bodies.where(F.col("kind") == kind).select("user_id", F.explode(F.from_json("body", f"array<struct<{fields}>>")).alias("r")).select("user_id", "r.*")
        parts.append(conform(shaped(rows, F.col("user_id")).where("track is not null"), f"spotify-{kind}", guard=None))
    return parts[0].unionByName(parts[1])


def extract_archive(archive: str, target: str) -> list[Path]:
    """JSON members of a ZIP archive, flattened into ``target``; everything else in it is skipped.

    Refuses archives with too many members, or that would unpack to too much.
    """
    out, total, written = Path(target), 0, []
    out.mkdir(parents=True, exist_ok=True)
    try:
        with zipfile.ZipFile(archive) as z:
            members = z.infolist()
            if len(members) > MAX_MEMBERS:
                raise ExportError(f"more than {MAX_MEMBERS} entries in the archive")
            for m in members:
                name = Path(m.filename.replace("\\", "/")).name
                if m.is_dir() or not name.lower().endswith(".json") or name.startswith("."):
                    continue
                total += m.file_size
                if total > MAX_BYTES:
                    raise ExportError(f"the archive unpacks to more than {MAX_BYTES >> 20} MB")
                with z.open(m) as src, (out / name).open("wb") as dst:
                    shutil.copyfileobj(src, dst)
                written.append(out / name)
    except zipfile.BadZipFile as e:
        raise ExportError("not a readable archive") from e
    if not written:
        raise ExportError("no history files in the archive")
    return written


def to_history(events: DataFrame, most: int = MAX_KEPT) -> DataFrame:
    """``artist, track, ts`` of the latest ``most`` plays that count, in order."""
    latest = positives(events).orderBy(F.desc("ts"), F.desc("artist"), F.desc("track")).limit(most)
    return latest.select("artist", "track", "ts").orderBy("ts", "artist", "track")


def read_upload(spark: SparkSession, path: str, workdir: str, user_id: str = "upload") -> DataFrame:
    """History of an uploaded archive or JSON file; every fault is an :class:`ExportError`."""
    p = Path(path)
    if zipfile.is_zipfile(p):
        extract_archive(path, f"{workdir}/extracted")
        source = f"{workdir}/extracted"
    elif p.suffix.lower() == ".json":
        source = path
    else:
        raise ExportError("neither an archive nor a JSON file")
    try:
        history = to_history(read_export(spark, source, user_id))
    except (FileNotFoundError, ValueError) as e:
        raise ExportError(str(e)) from e
    if history.isEmpty():
        raise ExportError("no plays are long enough")
    return history


def upload_stats(events: DataFrame, history: DataFrame) -> DataFrame:
    """One row: events in the file, plays that count, plays kept, their span and variety."""
    a = events.agg(F.count("*").alias("events_in_file"))
    b = positives(events).agg(F.count("*").alias("plays_after_filter"))
    c = history.agg(F.count("*").alias("retained"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.countDistinct(F.struct("artist", "track")).alias("distinct_tracks"), F.countDistinct("artist").alias("distinct_artists"))
    c = c.withColumns({"first_play": display_stamp(F.col("first_ts")), "last_play": display_stamp(F.col("last_ts"))})
    return one_row([a, b, c]).withColumn("truncated", F.col("plays_after_filter") > F.col("retained"))
