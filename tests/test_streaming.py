from pyspark.sql import functions as F

from listenloom.operators.session_table import SessionTable
from listenloom.runtime import fresh_path
from listenloom.streaming.windows import keep_sessions, stream_sessions, stream_windows

DATA = "/root/testdata/sf0.001/plays.parquet"


def _stream(spark, tmp_path):
    plays = spark.read.parquet(DATA).where("ts > 0 and user_id is not null").dropDuplicates(["play_id"]).select("play_id", "user_id", "ts", "track")
    plays.repartition(3).write.parquet(str(tmp_path / "in"))
    read = spark.readStream.schema(plays.schema)
    # files in no order: what comes one by one is later than any watermark allows
    return plays, read.parquet(str(tmp_path / "in")), read.option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def _complete(df, name, tmp_path):
    q = df.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(240)
    return df.sparkSession.table(name)


def test_sessions_and_windows_match_the_batch(spark, tmp_path):
    plays, stream, by_file = _stream(spark, tmp_path)
    got = _complete(stream_sessions(stream), "sessions", tmp_path)
    table = SessionTable(spark, fresh_path(spark, "t"))
    table.apply(plays)
    want = table.sessions().select(F.col("owner").alias("user_id"), F.col("start").alias("start_ts"), F.col("stop").alias("end_ts"), F.col("n").alias("n_plays"))
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
    windows = _complete(stream_windows(stream), "windows", tmp_path)
    assert windows.agg(F.sum("n_plays")).first()[0] == plays.count()
    kept = SessionTable(spark, fresh_path(spark, "t2"))
    keep_sessions(by_file, kept, str(tmp_path / "ck")).awaitTermination(240)
    assert sorted(map(tuple, kept.sessions().collect())) == sorted(map(tuple, table.sessions().collect()))
