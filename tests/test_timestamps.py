import pytest

from listenloom.operators.timestamps import normalise_timestamps

SCHEMA = "raw_id bigint, ts string, device_tz string, locale_code string, source string, reading string, posterior double, utc_status string"


def _read(spark, rows, **how):
    df = spark.createDataFrame([(i, *r, "clash", 0.5, "clash") for i, r in enumerate(rows)], SCHEMA)
    return [(r.utc_seconds, r.utc_status) for r in normalise_timestamps(df, **how).orderBy("raw_id").collect()]


CASES = [
    ("2009-05-04T23:08:57Z", "Asia/Tokyo", "en_US", 1241478537),
    ("2009-05-04 23.08", None, "sv_SE", 1241478480),
    ("2009-05-04T23:08:57.999+02:00", None, "de_DE", 1241471337),
    ("2009-05-04 23:08:57 CEST", "Europe/Berlin", "de_DE", 1241471337),
    ("2009-05-04T23:08:57+02:00[Europe/Berlin]", None, None, 1241471337),
    ("Mon, 04 May 2009 23:08:57 GMT", None, "en_GB", 1241478537),
    ("04-May-2009 23:08:57", "Asia/Kolkata", "fr_FR", 1241458737),
    ("May 4, 2009 11:08:57 PM", None, "en_US", 1241478537),
    ("05/04/2009 23:08:57", None, "en_US", 1241478537),
    ("04/05/2009 23:08:57", None, "en_GB", 1241478537),
    ("5/4/2009 12:08 am", None, "en-US", 1241395680),
    ("04.05.2009 23:08", None, "de_DE", 1241478480),
    ("20090504T230857Z", None, None, 1241478537),
    ("20090504230857", "Asia/Tokyo", "ja_JP", 1241446137),
    ("1241478537", "Asia/Tokyo", "ja_JP", 1241478537),
    ("1241478537.99", None, "ja_JP", 1241478537),
    ("1241478537123", None, "ja_JP", 1241478537),
    (" 1241478537123456 ", None, "ja_JP", 1241478537),
    ("2019-03-31 02:30:00", "Europe/Berlin", "de_DE", 1553995800),  # skipped: offset before the change
    ("2019-10-27 02:30:00", "Europe/Berlin", "de_DE", 1572136200),  # twice: the earlier
    ("1970-01-01T00:00:00Z", None, None, 0),
]
JUNK = [None, "", "  ", "2015-06", "12:45:10", "2013-02-30 10:15:00", "31/02/2012 14:20", "2016-04-12 25:61:00", "0000-00-00 00:00:00", "yesterday", "0", "-1", "13/05/2009 10:00", "x" * 100_000, "9" * 400]


def test_notations(spark):
    got = _read(spark, [(t, z, loc, "s") for t, z, loc, _ in CASES])
    assert [g[0] for g in got] == [w for *_, w in CASES]


def test_junk(spark):
    assert {s for _, s in _read(spark, [(t, None, "en_US", None) for t in JUNK])} == {"none"}


def test_unknown_zone_is_marked_unless_the_stamp_has_its_own(spark):
    assert _read(spark, [("2009-05-04 23:08", "Mars/Base", "de_DE", "s"), ("2009-05-04 23:08Z", "Mars/Base", "de_DE", "s"), ("2009-05-04 23:08", " ", "de_DE", "s")]) == [(None, "unknown_zone"), (1241478480, "resolved"), (1241478480, "resolved")]


def test_without_locale_the_source_decides_or_stays_ambiguous(spark):
    clear = [(f"{d:02d}/03/2011 10:00:00", None, None, "dayfirst") for d in range(13, 29)]
    got = _read(spark, [*clear, ("04/05/2011 10:00:00", None, None, "dayfirst"), ("04/05/2011 10:00:00", None, None, "unclear")])
    assert got[-2] == (1304503200, "resolved") and got[-1] == (None, "ambiguous")


def test_rows_and_columns_are_kept(spark):
    df = spark.createDataFrame([(1, "1241478537", None, None, None, "a", 0.1, "b")] * 2, SCHEMA)
    out = normalise_timestamps(df)
    assert out.count() == 2 and out.columns == [*[c for c in df.columns if c != "utc_status"], "utc_seconds", "utc_notation", "utc_posterior", "utc_status"]
    assert normalise_timestamps(df.limit(0)).count() == 0


@pytest.mark.parametrize("rows", [0, 10])
def test_posteriors_without_broadcast(spark, rows):
    assert _read(spark, [("1241478537", None, "de_DE", "s")], broadcast_rows=rows) == [(1241478537, "resolved")]
