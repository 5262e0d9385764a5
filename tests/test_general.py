import pytest
from pyspark.sql import functions as F

from listenloom.plans.general import p7_found, stream_sessions, stream_windows

DATA = "/root/testdata/sf0.001/plays.parquet"


@pytest.mark.parametrize("layout", ["file", "folder", "parts"])
def test_streams_read_a_table_however_it_is_laid_out(spark, tmp_path, layout):
    table = tmp_path / "plays.parquet"
    if layout == "file":
        table.symlink_to(DATA)
    else:
        spark.read.parquet(DATA).repartition(1 if layout == "folder" else 3).write.parquet(str(table))
    windows = stream_windows(spark, str(tmp_path))
    usable = spark.read.parquet(DATA).where("play_id is not null and user_id is not null and ts > 0 and artist rlike '[^\\\\s\\u00a0]' and track rlike '[^\\\\s\\u00a0]'")
    assert windows.agg(F.sum("n_plays")).first()[0] == usable.count() > 0
    assert sorted(map(tuple, stream_sessions(spark, str(tmp_path)).collect())) == sorted(map(tuple, p7_found(spark, str(tmp_path)).collect()))


def test_a_stream_without_files_gives_no_windows(spark, tmp_path):
    spark.read.parquet(DATA).limit(0).write.parquet(str(tmp_path / "plays.parquet"))
    assert stream_windows(spark, str(tmp_path)).count() == 0
    assert stream_sessions(spark, str(tmp_path)).count() == 0
