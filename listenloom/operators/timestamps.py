"""One UTC second for stamps in many notations, zones and precisions.

A stamp is read under every notation that it fits. Where more than one reading
holds, expectation-maximisation over the notations of its source weighs them:
each stamp adds likelihood to its valid readings, the posterior picks one, and
what stays below ``certainty`` is marked ambiguous instead of guessed.

All parsing is Spark SQL expressions. The mixture is fitted on counts per
(source, order of day and month, set of valid readings), a few rows per source.
"""

from __future__ import annotations

import zoneinfo

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listenloom.functions.text import strip
from listenloom.runtime import materialize

_TIME = r"(\d{1,2})[:.](\d{2})(?:[:.](\d{2})(?:[.,]\d{1,9})?)?(?:\s*([AaPp])\.?[Mm]\.?)?"
_ZONE = r"\s*(Z|z|[+-]\d{2}:?\d{2}|[+-]\d{2}|[A-Za-z]{2,5})?(?:\[([A-Za-z0-9_+/-]+)\])?"

#: Notations with a written date: name, pattern, order of year, month, day, hour, minute, second, half of day, zone, bracketed zone.
NOTATIONS = [
    ("ymd", rf"^(\d{{4}})([-/.])(\d{{1,2}})\2(\d{{1,2}})(?:[Tt]|,?\s+){_TIME}{_ZONE}$", "$1|$3|$4|$5|$6|$7|$8|$9|$10"),
    ("numeric", rf"^(\d{{1,2}})([-/.])(\d{{1,2}})\2(\d{{4}})(?:[Tt]|,?\s+){_TIME}{_ZONE}$", "$4|$3|$1|$5|$6|$7|$8|$9|$10"),
    ("day_name", rf"^(?:[A-Za-z]{{2,9}}\.?,?\s+)?(\d{{1,2}})[-\s.]+([^\W\d_]{{3,9}})\.?[-\s,]+(\d{{4}})(?:[Tt]|,?\s+){_TIME}{_ZONE}$", "$3|$2|$1|$4|$5|$6|$7|$8|$9"),
    ("name_day", rf"^(?:[A-Za-z]{{2,9}}\.?,\s+)?([^\W\d_]{{3,9}})\.?\s+(\d{{1,2}}),?\s+(\d{{4}})(?:[Tt]|,?\s+){_TIME}{_ZONE}$", "$3|$1|$2|$4|$5|$6|$7|$8|$9"),
    ("basic", rf"^(\d{{4}})(\d{{2}})(\d{{2}})[Tt](\d{{2}})(\d{{2}})(\d{{2}})?(?:[.,]\d{{1,9}})?{_ZONE}$", "$1|$2|$3|$4|$5|$6||$7|$8"),
]
_DIGITS = r"^(\d{9,19})(?:\.\d+)?$"
_RUN_ON = r"^(\d{4})(\d{2})(\d{2})(\d{2})(\d{2})(\d{2})?$"

# Month names by their first letters, in English, German, French, Spanish and Swedish.
MONTHS = {
    "jan": 1, "ene": 1, "feb": 2, "fév": 2, "mar": 3, "mär": 3, "apr": 4, "avr": 4, "abr": 4, "may": 5, "mai": 5, "maj": 5,
    "jun": 6, "juin": 6, "jul": 7, "juil": 7, "aug": 8, "aoû": 8, "ago": 8, "sep": 9, "oct": 10, "okt": 10, "nov": 11, "dec": 12, "déc": 12, "dez": 12, "dic": 12,
}
# Minutes east of UTC of zone names that mean one offset.
ZONE_MINUTES = {
    "Z": 0, "UTC": 0, "GMT": 0, "UT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "MEZ": 60, "MESZ": 120, "EET": 120, "EEST": 180, "MSK": 180, "JST": 540, "KST": 540, "NPT": 345,
    "AEST": 600, "AEDT": 660, "ACST": 570, "ACDT": 630, "AWST": 480, "NZST": 720, "NZDT": 780, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600,
}
#: Names that mean another offset in some regions: (name, how the device's zone begins) -> minutes.
ZONE_MINUTES_NEAR = {("CST", "Asia/"): 480, ("IST", "Asia/"): 330, ("IST", "Europe/"): 60, ("EST", "Australia/"): 600, ("EDT", "Australia/"): 660, ("CST", "Australia/"): 570, ("CDT", "Australia/"): 630}
#: Territories that write the month before the day.
MONTH_FIRST = ("US", "PH", "PW", "FM", "MH", "GU", "AS", "MP", "PR", "VI", "BZ")

_LATEST = 4_102_444_800  # 2100-01-01
_EARLIEST_LIKELY = 946_684_800  # 2000-01-01
_UNLIKELY = 1e-6
_READINGS = ["s", "ms", "us", "ns", "run_on", "dmy", "mdy"]


def _compute(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with more columns that are computed once.

    A predicate on them isn't moved below them: Catalyst would put the whole
    parser into the predicate, once per mention.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))


def _as_map(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def _days(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01, null where no such date exists."""
    feb = F.when((y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0)), 29).otherwise(28)
    longest = F.when(m == 2, feb).when(m.isin(4, 6, 9, 11), 30).otherwise(31)
    ok = (y >= 1) & m.between(1, 12) & (d >= 1) & (d <= longest)
    # counted from March, so that a leap day ends a year
    yy, mm = F.when(m <= 2, y - 1).otherwise(y), F.when(m <= 2, m + 9).otherwise(m - 3)
    n = yy * 365 + F.floor(yy / 4) - F.floor(yy / 100) + F.floor(yy / 400) + F.floor((mm * 153 + 2) / 5) + d - 1
    return F.when(ok, n.cast("bigint") - 719_468)


def _int(c: Column) -> Column:
    return F.when(c != "", c).try_cast("bigint")


def _fit(certainty: float, rounds: int):
    """EM on the counts of one source."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        like = np.zeros((len(pdf), len(_READINGS)))
        for i, (mask, order) in enumerate(zip(pdf["mask"], pdf["order"])):
            for part in mask.split(","):
                name, mark = part[:-1], part[-1]
                allowed = name not in ("dmy", "mdy") or order in (None, name) or order != order
                like[i, _READINGS.index(name)] = allowed * (1.0 if mark == "+" else _UNLIKELY)
        count, weight = pdf["n"].to_numpy(float), np.full(len(_READINGS), 1 / len(_READINGS))
        for _ in range(rounds):
            r = like * weight
            total = r.sum(1, keepdims=True)
            r = np.divide(r, total, out=np.zeros_like(r), where=total > 0)
            weight = (r * count[:, None]).sum(0) + 0.5
            weight /= weight.sum()
        r = like * weight
        total = r.sum(1, keepdims=True)
        r = np.divide(r, total, out=np.zeros_like(r), where=total > 0)
        best = r.argmax(1)
        top = r[np.arange(len(r)), best]
        return pd.DataFrame({"source": pdf["source"], "order": pdf["order"], "mask": pdf["mask"], "reading": [_READINGS[b] if t > 0 else None for b, t in zip(best, top)], "posterior": top})

    return run


def normalise_timestamps(df: DataFrame, ts: str = "ts", device_tz: str = "device_tz", locale: str = "locale_code", source: str = "source", certainty: float = 0.9, rounds: int = 40, broadcast_rows: int = 100_000) -> DataFrame:
    """``df`` with ``utc_seconds, utc_notation, utc_posterior, utc_status``.

    ``utc_status`` is ``resolved``; ``ambiguous`` (no reading reaches ``certainty``, no
    second is given); ``unknown_zone`` (a local time whose zone doesn't exist); or
    ``none`` (null, empty, no such moment, without date, hour or minute). A stamp's own
    offset or zone prevails over ``device_tz``, which prevails over UTC. A local time that
    occurs twice means the earlier moment; a skipped one is read with the offset before
    the change. ``locale`` decides whether the day or the month comes first; where it is
    null the source's posterior does. Fractions are dropped downwards. Repeated rows stay
    repeated, an empty table stays empty. Columns of ``df`` with one of the four names
    are replaced, all others are kept.
    """
    out = ["utc_seconds", "utc_notation", "utc_posterior", "utc_status"]
    base = df.drop(*out)
    own = base.columns
    s = F.col("__s")
    rows = base.withColumn("__s", strip(F.col(f"`{ts}`").cast("string")))
    name, parts = F.lit(None).cast("string"), F.lit(None).cast("string")
    for notation, pattern, _ in reversed(NOTATIONS):
        name = F.when(s.rlike(pattern), notation).otherwise(name)
    rows = _compute(rows, __notation=F.when(s.rlike(_DIGITS), "digits").otherwise(name))
    for notation, pattern, order in NOTATIONS:
        parts = F.when(F.col("__notation") == notation, F.regexp_replace(s, pattern, order)).otherwise(parts)
    rows = _compute(rows, __p=F.split(parts, r"\|", -1))

    # written dates
    p = [F.col("__p")[i] for i in range(9)]
    letters = F.lower(p[1])
    month = F.coalesce(_int(p[1]), F.element_at(_as_map(MONTHS), F.substring(letters, 1, 4)), F.element_at(_as_map(MONTHS), F.substring(letters, 1, 3)).cast("int")).cast("bigint")
    hour, minute, second = _int(p[3]), _int(p[4]), F.coalesce(_int(p[5]), F.lit(0))
    half = F.lower(p[6])
    hour = F.when(half == "", hour).when(hour.between(1, 12), hour % 12 + F.when(half == "p", 12).otherwise(0))
    clock = F.when(hour.between(0, 23) & minute.between(0, 59) & second.between(0, 59), hour * 3600 + minute * 60 + second)
    rows = _compute(rows, __clock=clock, __y=_int(p[0]), __m=month, __d=_int(p[2]), __zone=p[7], __bracket=p[8])
    y, m, d = F.col("__y"), F.col("__m"), F.col("__d")

    # bare numbers
    digits = F.when(F.col("__notation") == "digits", F.regexp_extract(s, r"^(\d+)", 1))
    number = digits.try_cast("decimal(20,0)")
    run_on = F.split(F.when(digits.rlike(_RUN_ON), F.regexp_replace(digits, _RUN_ON, "$1|$2|$3|$4|$5|$6")), r"\|", -1)
    rows = _compute(rows, __n=number, __r=run_on, __ymd=_days(y, m, d) * 86_400 + F.col("__clock"), __ydm=F.when(F.col("__notation") == "numeric", _days(y, d, m) * 86_400 + F.col("__clock")))
    r = [_int(F.col("__r")[i]) for i in range(6)]
    r_clock = F.when(r[3].between(0, 23) & r[4].between(0, 59) & F.coalesce(r[5], F.lit(0)).between(0, 59), r[3] * 3600 + r[4] * 60 + F.coalesce(r[5], F.lit(0)))
    numeric = F.col("__notation") == "numeric"
    value = {
        **{u: F.floor(F.col("__n") / F.lit(k)).try_cast("bigint") for u, k in (("s", 1), ("ms", 1000), ("us", 1_000_000), ("ns", 1_000_000_000))},
        "run_on": _days(r[0], r[1], r[2]) * 86_400 + r_clock,
        "dmy": F.when(numeric, F.col("__ymd")),
        "mdy": F.col("__ydm"),
    }
    rows = _compute(rows, **{f"__u_{k}": v for k, v in value.items()})
    rows = _compute(rows, __v=F.struct(*[F.when((F.col(f"__u_{k}") > 0) & (F.col(f"__u_{k}") < _LATEST), F.col(f"__u_{k}")).alias(k) for k in value]))
    marks = [F.when(F.col(f"__v.{k}") >= _EARLIEST_LIKELY, f"{k}+").when(F.col(f"__v.{k}").isNotNull(), f"{k}-") for k in _READINGS]
    territory = F.upper(F.regexp_extract(F.col(f"`{locale}`").cast("string"), r"^[A-Za-z]{2,3}[-_]([A-Za-z]{2})", 1))
    rows = _compute(rows, __mask=F.concat_ws(",", *marks), __order=F.when(F.col(f"`{locale}`").isNull() | F.lower(F.col(f"`{locale}`")).isin("", "c", "posix"), None).when(territory.isin(*MONTH_FIRST), "mdy").otherwise("dmy"), __source=F.coalesce(F.col(f"`{source}`").cast("string"), F.lit("")))

    # parsed once, for the mixture and for its use
    rows = materialize(rows.select(*[F.col(f"`{c}`") for c in own], "__v", "__ymd", "__mask", "__order", "__source", "__notation", "__zone", "__bracket"), "parsed")

    # the mixture
    counts = rows.where(F.col("__mask") != "").groupBy(F.col("__source").alias("source"), F.col("__order").alias("order"), F.col("__mask").alias("mask")).agg(F.count("*").alias("n"))
    fitted = counts.groupBy("source").applyInPandas(_fit(certainty, rounds), "source string, order string, mask string, reading string, posterior double")
    fitted = materialize(fitted, "stamps")
    few = fitted.limit(broadcast_rows + 1).count() <= broadcast_rows
    fitted = fitted.select(F.col("source").alias("__source"), F.col("order").alias("__o"), F.col("mask").alias("__mask"), F.col("reading").alias("__reading"), F.col("posterior").alias("__posterior"))
    on = (rows["__source"] == fitted["__source"]) & rows["__order"].eqNullSafe(fitted["__o"]) & (rows["__mask"] == fitted["__mask"])
    rows = rows.join(F.broadcast(fitted) if few else fitted, on, "left").drop(fitted["__source"]).drop(fitted["__mask"])

    reading = F.col("__reading")
    chosen = F.coalesce(*[F.when(reading == k, F.col(f"__v.{k}")) for k in _READINGS])
    plain = (F.col("__mask") == "") & F.col("__notation").isin("ymd", "day_name", "name_day", "basic")
    posterior = F.when(plain, 1.0).otherwise(F.col("__posterior"))
    moment = F.when(plain, F.col("__ymd")).otherwise(chosen)
    absolute = reading.isin("s", "ms", "us", "ns")

    # zones
    zone, bracket, device = F.col("__zone"), F.col("__bracket"), F.col(f"`{device_tz}`").cast("string")
    upper = F.upper(zone)
    sign = F.when(zone.startswith("-"), -1).otherwise(1)
    hhmm = F.regexp_replace(zone, r"[^0-9]", "")
    written = F.when(zone.rlike(r"^[+-]"), sign * (F.substring(hhmm, 1, 2).try_cast("int") * 60 + F.coalesce(F.when(F.length(hhmm) > 2, F.substring(hhmm, 3, 2)).try_cast("int"), F.lit(0))))
    near = F.lit(None).cast("int")
    for (n, begins), minutes in ZONE_MINUTES_NEAR.items():
        near = F.when((upper == n) & F.coalesce(device, F.lit("")).startswith(begins), minutes).otherwise(near)
    named = F.coalesce(near, F.element_at(_as_map(ZONE_MINUTES), upper))
    has_zone = F.coalesce(zone, F.lit("")) != ""
    rows = _compute(
        rows,
        __moment=moment,
        __post=posterior,
        __abs=F.coalesce(absolute, F.lit(False)),
        __has_zone=has_zone,
        __offset=F.coalesce(written, named),
        __region=F.when(F.coalesce(bracket, F.lit("")) != "", bracket).otherwise(F.coalesce(F.when(F.trim(device) != "", F.trim(device)), F.lit("UTC"))),
    )
    zones = sorted(z for z in zoneinfo.available_timezones() if z not in ("Factory", "localtime"))
    rows = _compute(rows, __known=F.col("__region").isin(*zones) | F.col("__region").rlike(r"^[+-](0\d|1[0-7]):[0-5]\d$"))
    known, offset = F.col("__known"), F.col("__offset")
    status = (
        F.when(F.col("__moment").isNull(), "none")
        .when(F.col("__post") < certainty, "ambiguous")
        .when(~F.col("__abs") & F.when(F.col("__has_zone"), offset.isNull()).otherwise(~known), "unknown_zone")
        .otherwise("resolved")
    )
    local = F.unix_seconds(F.to_utc_timestamp(F.timestamp_seconds(F.col("__moment")), F.when(known, F.col("__region")).otherwise("UTC")))
    utc = F.when(F.col("__abs"), F.col("__moment")).when(F.col("__has_zone"), F.col("__moment") - offset * 60).when(known, local)
    rows = _compute(rows, __status=status, __utc=utc)
    status = F.col("__status")
    return rows.select(
        *[F.col(f"`{c}`") for c in own],
        F.when(status == "resolved", F.col("__utc")).cast("bigint").alias("utc_seconds"),
        F.when(F.col("__moment").isNotNull(), F.coalesce(reading, F.col("__notation"))).alias("utc_notation"),
        F.when(F.col("__moment").isNotNull(), F.col("__post")).alias("utc_posterior"),
        status.alias("utc_status"),
    )
