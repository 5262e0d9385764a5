"""Session-level helpers: where intermediate tables go, and how lineage is cut."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the one named in ``spark.checkpoint.dir``.

    Where a local session names none (tests, a laptop) a temporary folder of this
    machine is made once and written into the session. On a cluster that would be a
    folder of every machine's own, so there the setting is required.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that all machines of {master} share")
        named = "file://" + tempfile.mkdtemp(prefix="listenloom-")
        spark.conf.set("spark.checkpoint.dir", named)
        spark.sparkContext.setCheckpointDir(named)
    return named


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that no other call gets."""
    path = f"{shared_dir(spark)}/listenloom/{label}-{uuid.uuid4().hex}"
    for scope in _scopes:
        scope.append(path)
    return path


#: Makes a query delete its shuffle files where it ends; else they stay until the driver collects its garbage.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, label: str, partition_by: list[str] | None = None, onto: DataFrame | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts the lineage: a lost executor afterwards costs a re-read of committed
    files, not a re-run of what made them. Use it for what several later steps read.
    ``onto``: a table of this function, not partitioned, to which the rows are added.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label) if onto is None else onto._written_to
    writer = df.write.mode("errorifexists" if onto is None else "append")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        writer.parquet(path)
    finally:
        spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of :func:`materialize` that nothing will read any more; other data frames are left alone."""
    for t in tables:
        if (path := getattr(t, "_written_to", None)) is not None:
            remove(t.sparkSession, path)


def broadcast_small(df: DataFrame, limit: int = 1_000_000) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``limit`` rows, else as it is, to be joined by a shuffle.

    Counting runs the plan of ``df``, so that should be cheap or materialised.
    """
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def spelled_out(df: DataFrame) -> DataFrame:
    """``df``, made by ``explode``, to be joined by a shuffle only.

    Spark takes such a table for as small as what it was made from and would broadcast it
    through the driver, however many rows it has.
    """
    return df.hint("merge")


_scopes: list[list[str]] = []


@contextmanager
def intermediates(spark: SparkSession) -> Iterator[None]:
    """Delete at the end what was written to the shared folder inside; results have to be consumed before."""
    _scopes.append(made := [])
    try:
        yield
    finally:
        _scopes.remove(made)
        for path in made:
            remove(spark, path)


def clear_intermediates(spark: SparkSession) -> None:
    """Delete all that was ever written to the shared folder; results that were not yet computed can't be any more."""
    remove(spark, f"{shared_dir(spark)}/listenloom")


def hadoop_fs(spark: SparkSession, path: str):
    """(file system, path object) of Hadoop for ``path``."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder of the shared file system if it is there."""
    fs, p = hadoop_fs(spark, path)
    if fs.exists(p):
        fs.delete(p, True)
