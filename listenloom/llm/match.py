"""Listings and catalog items that name one recording, with no key in common.

A cascade of rules, strongest first; each pass is an exact join on a weaker
combination of attributes over the listings that no earlier pass resolved:

1. ``exact``         artist, title and version as written (spelling folded);
2. ``artist_variant`` the artist shortened, run together, with one slip, or standing in
   the other field, its title and version as written;
3. ``title_slip``    as before, on the title with one letter left out;
4. ``title_slips``   as before, on the title's beginning or its end with one letter left out;
5. ``cut_title``     a title cut off at its end, on how it begins with one letter left out.

Artists are resolved once, among distinct names, so no pass pairs up a whole
artist's listings with a whole artist's items; nor does a pass pair titles that share
no more than a common word.

A rule's confidence is its precision on the matches it gives. They are labelled by the
year, which no rule looks at: within one year of each other is right. Years agree by
chance and are off by mistake, so the share that agrees is read between the share
expected of random pairs and that of the surest ones (``exact``, durations agreeing).
It is smoothed per source towards the rule's share, and that towards the surest.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from listenloom.llm.recording import folded, osa, parse_artist, parse_track, titles_alike, versions_alike
from listenloom.runtime import materialize, spelled_out

RULES = ["exact", "artist_variant", "title_slip", "title_slips", "cut_title"]
_READING = "id bigint, reading int, artist_key string, artist_core string, title string, version string, kinds string, cut boolean"
_SPLIT = re.compile(r"\s+[-–—]\s+")


def core_of(artist_key: str) -> str:
    """What is left of an artist's key when it is shortened: no article, no company."""
    core = artist_key.removeprefix("the ").split(" and ")[0].strip()
    for tail in (" trio", " quartet", " band", " orchestra", " ensemble"):
        core = core.removesuffix(tail)
    return core or artist_key


def _kinds(version: str) -> str:
    return "|".join(v.partition(":")[0] for v in version.split("|")) if version else ""


def _read(listing: bool):
    def of(i, reading, artist, track):
        title, version, cut = parse_track(track)
        key = parse_artist(artist)
        return (i, reading, key, core_of(key), title, version, _kinds(version), cut) if key and title else None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for i, a, t in zip(pdf["id"], pdf["artist"], pdf["track"]):
                a, t = a if isinstance(a, str) and a.strip() else None, t if isinstance(t, str) and t.strip() else None
                if a and t:
                    out.append(of(i, 0, a, t))
                    if listing:
                        out.append(of(i, 1, t, a))
                elif listing and (a or t):  # both names in one field
                    parts = _SPLIT.split(a or t)
                    if len(parts) > 1:
                        out.append(of(i, 2, parts[0], " - ".join(parts[1:])))
                        out.append(of(i, 3, parts[-1], " - ".join(parts[:-1])))
            yield pd.DataFrame([x for x in out if x], columns=["id", "reading", "artist_key", "artist_core", "title", "version", "kinds", "cut"])

    return run


def _less_one(c: Column) -> Column:
    """``c`` and all it can be with one letter left out."""
    n = F.length(c)
    shorter = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.concat(c.substr(F.lit(1), i - 1), c.substr(i + 1, n)))
    return F.array_distinct(F.concat(F.array(c), F.when(n > 3, shorter).otherwise(F.array())))


@F.pandas_udf(IntegerType())
def _artist_osa(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([osa(x, y, 2) for x, y in zip(a, b)])


def _artist_slips(a: str, b: str) -> Column:
    """Slips up to 2, else 3. Two edits with swaps are four without at most, which is told before Python."""
    return F.when(F.levenshtein(a, b, 4) < 0, 3).otherwise(_artist_osa(a, b))


def _ladder(n: Column) -> Column:
    """How many letters of a title of ``n`` tell it apart from both ends: the same for lengths that hardly differ."""
    out = F.lit(2)
    for k in (3, 4, 6, 8, 12, 16, 24):
        out = F.when(n >= 2 * k, k).otherwise(out)
    return out


def _ends(c: Column, reach: int) -> Column:
    """Beginning and end of a title with one letter left out, at the lengths fit for titles up to ``reach`` letters longer or shorter.

    Of two slips in a title one half has one at most, so near titles share a form.
    """
    n = F.length(c)
    cuts = F.array_distinct(F.array(*[_ladder(n + d) for d in range(-reach, reach + 1)]))
    one = lambda side, part: F.transform(_less_one(part), lambda x: F.concat(F.lit(side), x))
    return F.array_distinct(F.flatten(F.transform(cuts, lambda k: F.concat(one("<", F.substring(c, F.lit(1), k)), one(">", F.right(c, k))))))


#: Letters at the beginning of a cut title that are looked up: as many of these as it has.
_BEGINNINGS = (6, 10, 16, 24)


#: Added to the slips of a title with two in one word: such a match needs durations that agree.
_DOUBTFUL = 10


@F.pandas_udf(IntegerType())
def _title_slips(a: pd.Series, b: pd.Series) -> pd.Series:
    """Slips, at most one for every second word and one more; 99 otherwise."""

    def one(x, y):
        if x == y or osa(x, y, 1) == 1:
            return int(x != y)
        p, q = x.split(), y.split()
        if len(p) != len(q):
            return 99
        slips = [osa(u, v, 2 if len(v) > 5 else 1) if u != v else 0 for u, v in zip(p, q)]
        if any(s > (2 if len(v) > 5 else 1) for s, v in zip(slips, q)) or sum(slips) > max(2, 1 + len(p) // 2):
            return 99
        return sum(slips) + _DOUBTFUL * (max(slips) > 1)

    return pd.Series([one(x, y) for x, y in zip(a, b)])


@F.pandas_udf(IntegerType())
def _begins(a: pd.Series, b: pd.Series) -> pd.Series:
    """Slips between a title that was cut off and how the other begins; 99 if more than one."""
    return pd.Series([min(osa(x, y[: max(0, len(x) + k)], 1) for k in (-1, 0, 1)) if len(y) >= len(x) - 1 and osa(x, y[: len(x)], 2) <= 2 else 99 for x, y in zip(a, b)]).where(lambda v: v <= 1, 99)


@F.pandas_udf(IntegerType())
def _version_slips(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([versions_alike(x, y) for x, y in zip(a, b)])


def _once(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One row per key: of rows that differ, the least by all columns."""
    rest = [c for c in columns if c != key]
    return df.where(F.col(f"`{key}`").isNotNull()).groupBy(F.col(f"`{key}`").alias("id")).agg(F.min(F.struct(*[F.col(f"`{c}`") for c in rest])).alias("s")).select("id", *[F.col(f"s.`{c}`").alias(c) for c in rest])


def match_recordings(listings: DataFrame, catalog: DataFrame, tolerance: float = 0.05, prior: tuple[float, float] = (1.0, 1.0), strength: float = 20.0) -> DataFrame:
    """``ext_id, item_index, source, rule, confidence``: at most one item per listing.

    Listings need ``ext_id, source, artist, track, duration_ms, release_year``, items
    ``item_index, artist, track, duration_ms, release_ts``; other columns are ignored.
    Repeated rows count once; of rows with one id that differ the least holds. A row
    without a name (null or blank in both fields), and one whose only field doesn't
    hold both names, can't be matched. Null durations and years neither support nor
    contradict a match; weaker rules than ``exact`` reject contradicting durations. Of
    several candidates the one with fewest slips holds, then the nearest in duration,
    then the lowest ``item_index``. Empty tables give no match. Years only label matches;
    without any the confidence of every rule is that of the prior's smoothing.
    """
    left = materialize(_once(listings, "ext_id", ["ext_id", "source", "artist", "track", "duration_ms", "release_year"]), "listings")
    right = materialize(_once(catalog, "item_index", ["item_index", "artist", "track", "duration_ms", "release_ts"]), "catalog")
    a = materialize(left.select("id", "artist", "track").mapInPandas(_read(True), _READING), "readings")
    b = materialize(right.select("id", "artist", "track").mapInPandas(_read(False), _READING), "items").drop("reading")
    item = [F.col(c).alias(f"i_{c}") for c in b.columns]
    facts_l = left.select(F.col("id").alias("ext_id"), "source", F.col("duration_ms").cast("double").alias("d"), F.col("release_year").alias("y"))
    facts_r = right.select(F.col("id").alias("item_index"), F.col("duration_ms").cast("double").alias("e"), F.year(F.timestamp_seconds("release_ts")).alias("z"))

    passes: list[DataFrame] = []

    def settle(rule: str, pairs: DataFrame) -> None:
        """Pairs ``id, i_id, slips`` of one pass: facts joined, contradictions marked, one item per listing."""
        known = pairs.select(F.col("id").alias("ext_id"), F.col("i_id").alias("item_index"), F.col("slips").cast("int").alias("slips")).join(facts_l, "ext_id").join(facts_r, "item_index")
        off = F.abs(F.col("d") - F.col("e")) / F.greatest(F.col("e"), F.lit(1.0))
        known = known.withColumn("off", off).withColumn("agrees", F.col("off") <= tolerance)
        best = known.groupBy("ext_id", "source").agg(F.min_by(F.struct("item_index", "agrees", "slips", (F.abs(F.col("y") - F.col("z")) <= 1).alias("year")), F.struct((~F.coalesce("agrees", F.lit(True))).alias("c"), "slips", F.coalesce("off", F.lit(1.0)).alias("o"), "item_index")).alias("m"))
        held = best.where(F.coalesce("m.agrees", F.col("m.slips") < _DOUBTFUL) | F.lit(rule == "exact"))
        passes.append(materialize(held.select("ext_id", "source", "m.item_index", "m.agrees", "m.year", F.lit(rule).alias("rule")), f"match-{rule}"))

    def open_readings() -> DataFrame:
        rest = a
        for done in passes:
            rest = rest.join(done.select(F.col("ext_id").alias("id")), "id", "left_anti")
        return rest

    plain = a.where("reading in (0, 2)")
    settle("exact", plain.join(b.select(*item), [plain[c] == F.col(f"i_{c}") for c in ("artist_key", "title", "version")]).select("id", "i_id", F.lit(0).alias("slips")))

    # whose names are whose, among distinct names
    rest = materialize(open_readings(), "open")
    # spread out by hand: what is small here is a row for each form in the next step
    tasks = int(listings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    theirs = b.select("artist_key", "artist_core").repartition(tasks, "artist_key").distinct()
    ours = rest.select("artist_key", "artist_core").repartition(tasks, "artist_key").distinct()

    def spelled(df: DataFrame, p: str) -> DataFrame:
        form = F.explode(F.array_distinct(F.concat(_less_one(F.col("artist_key")), _less_one(F.col("artist_core")), F.array(F.replace("artist_key", F.lit(" "), F.lit(""))))))
        return df.select(F.col("artist_key").alias(f"{p}_key"), F.col("artist_core").alias(f"{p}_core"), form.alias("form"))

    near = spelled(ours, "o").join(spelled_out(spelled(theirs, "t")), "form").select("o_key", "o_core", "t_key", "t_core").distinct()
    run_together = F.when(F.replace("o_key", F.lit(" "), F.lit("")) == F.replace("t_key", F.lit(" "), F.lit("")), 1)
    slips = F.least(_artist_slips("o_key", "t_key"), 1 + _artist_slips("o_core", "t_core"), run_together)
    near = materialize(near.withColumn("a_slips", slips).where("a_slips <= 2").select(F.col("o_key").alias("artist_key"), "t_key", "a_slips"), "near")

    def two_words(df: DataFrame, p: str) -> DataFrame:
        """Names by their first two words, each with one letter left out."""
        w = F.filter(F.split("artist_core", " "), lambda x: F.length(x) > 3)
        pairs = F.flatten(F.transform(_less_one(w[0]), lambda u: F.transform(_less_one(w[1]), lambda v: F.xxhash64(u, v))))
        return df.where(F.size(w) >= 2).select(F.col("artist_key").alias(f"{p}_key"), F.col("artist_core").alias(f"{p}_core"), F.explode(F.array_distinct(pairs)).alias("form"))

    others = two_words(ours.join(near.select("artist_key").distinct(), "artist_key", "left_anti").repartition(tasks, "artist_key"), "o")
    twice = others.join(spelled_out(two_words(theirs, "t")), "form").select("o_key", "o_core", "t_key", "t_core").distinct().withColumn("a_slips", F.least(_artist_slips("o_key", "t_key"), _artist_slips("o_core", "t_core") + 1)).where("a_slips <= 3")
    artists = materialize(near.unionByName(twice.select(F.col("o_key").alias("artist_key"), "t_key", "a_slips")), "artists")
    named = materialize(rest.join(artists, "artist_key").withColumn("a_slips", F.col("a_slips") + F.when(F.col("reading") % 2 == 1, 1).otherwise(0)), "named")

    items = b.select(*item)
    settle("artist_variant", named.join(items, [named["t_key"] == F.col("i_artist_key"), named["title"] == F.col("i_title"), named["version"] == F.col("i_version")]).select("id", "i_id", F.col("a_slips").alias("slips")))

    def judged(pairs: DataFrame, least: int, most: int) -> DataFrame:
        scored = pairs.select("id", "i_id", "title", "i_title", "version", "i_version", "a_slips").distinct().where(F.levenshtein("title", "i_title") <= 2 * F.greatest(F.lit(2), 1 + F.floor(F.size(F.split("title", " ")) / 2))).withColumn("t", _title_slips("title", "i_title")).withColumn("v", _version_slips("version", "i_version"))
        return scored.where(F.col("t").between(least, most) & (F.col("v") <= 1)).select("id", "i_id", (F.col("t") + F.col("v") + F.col("a_slips")).alias("slips"))

    def still_open(rows: DataFrame) -> DataFrame:
        return materialize(rows.join(passes[-1].select(F.col("ext_id").alias("id")), "id", "left_anti"), "open")

    def on_forms(l: DataFrame, r: DataFrame, form_l: Column, form_r: Column, same: list[str]) -> DataFrame:
        """Pairs of one artist that share a form and the columns ``same``; only what an open listing may meet is spelled out, and only hashes travel."""
        keys = ["t_key", *same]
        theirs = ["i_artist_key", *[f"i_{c}" for c in same]]
        r = r.join(l.select(*[F.col(c).alias(f"i_{c}") if c != "t_key" else F.col(c).alias("i_artist_key") for c in keys]).distinct(), theirs, "left_semi").repartition(tasks)
        ours = l.withColumn("form", F.explode(form_l)).withColumn("form", F.xxhash64(*keys, "form"))
        met = r.select("i_id", *theirs, F.explode(form_r).alias("form")).select("i_id", F.xxhash64(*theirs, "form").alias("form"))
        pairs = ours.join(spelled_out(met), "form").drop("form").distinct()
        return pairs.join(r, [pairs["i_id"] == r["i_id"], *[pairs[c] == r[d] for c, d in zip(keys, theirs)]]).drop(r["i_id"])

    left_over = still_open(named)
    settle("title_slip", judged(on_forms(left_over, items, _less_one(F.col("title")), _less_one(F.col("i_title")), ["kinds"]), 0, 1))

    left_over = still_open(left_over)
    size = lambda df, c: df.withColumn(c.replace("title", "words"), F.size(F.split(c, " ")))
    settle("title_slips", judged(on_forms(size(left_over, "title"), size(items, "i_title"), _ends(F.col("title"), 0), _ends(F.col("i_title"), 3), ["kinds", "words"]), 0, _DOUBTFUL + 4))

    # a long title may be cut off without a sign of it; unless that is inside a word, it needs durations that agree
    left_over = still_open(left_over)
    known = F.lit(_BEGINNINGS[0])
    for k in _BEGINNINGS[1:]:
        known = F.when(F.length("title") >= k, k).otherwise(known)
    cut = left_over.where((F.col("cut") & (F.length("title") >= 6)) | (F.length("title") >= 15)).withColumn("reach", known)
    whole = items.withColumn("i_reach", F.explode(F.array(*map(F.lit, _BEGINNINGS)))).where(F.length("i_title") >= F.col("i_reach") - 1)
    start = lambda title, reach: _less_one(F.substring(F.col(title), F.lit(1), F.col(reach)))
    begun = on_forms(cut, whole, start("title", "reach"), start("i_title", "i_reach"), ["reach"])
    begun = begun.where((F.col("kinds") == F.col("i_kinds")) | (F.col("kinds") == "")).select("id", "i_id", "title", "i_title", "kinds", "i_kinds", "cut", "a_slips").distinct().where(F.levenshtein(F.col("title"), F.substring(F.col("i_title"), F.lit(1), F.length("title")), 4) >= 0).withColumn("t", _begins("title", "i_title")).where("t <= 1")
    # the cut may have taken the version with it: one that isn't needed for the match costs
    settle("cut_title", begun.select("id", "i_id", (F.col("a_slips") + F.col("t") + F.when(F.col("kinds") == F.col("i_kinds"), 0).otherwise(3) + F.when(F.col("cut"), 0).when(F.substring(F.col("i_title"), F.length("title") + 1, F.lit(1)).isin(" ", ""), _DOUBTFUL).otherwise(5)).alias("slips")))

    every = passes[0]
    for p in passes[1:]:
        every = every.unionByName(p)
    every = materialize(every, "matches")
    return _with_confidence(every, _year_chance(facts_l, facts_r), prior, strength)


def _year_chance(listings: DataFrame, items: DataFrame) -> float:
    """How often the years of a random listing and a random item are within one of each other."""
    l = listings.where("y is not null").groupBy("y").agg(F.count("*").alias("n"))
    r = items.where("z is not null").groupBy("z").agg(F.count("*").alias("m"))
    near = l.select(F.explode(F.array(F.col("y") - 1, F.col("y"), F.col("y") + 1)).alias("z"), "n").join(r, "z").agg(F.sum(F.col("n").cast("double") * F.col("m"))).first()[0]
    all_l, all_r = l.agg(F.sum("n")).first()[0], r.agg(F.sum("m")).first()[0]
    return near / (all_l * all_r) if near and all_l and all_r else 0.0


def _with_confidence(matches: DataFrame, chance: float, prior: tuple[float, float], strength: float) -> DataFrame:
    """Matches with the precision of their rule, read from how often the years agree."""
    sure = matches.where("rule = 'exact' and agrees").agg(F.count_if("year").alias("right"), F.count("year").alias("n")).first()
    best = max((sure.right + prior[0]) / (sure.n + sum(prior)), chance + 0.05)
    labelled = matches.groupBy("rule", "source").agg(F.count_if("year").cast("double").alias("right"), F.count("year").alias("n"))
    rules = labelled.groupBy("rule").agg(((F.sum("right") + strength * best) / (F.sum("n") + strength)).alias("overall"))
    labelled = labelled.withColumnRenamed("source", "of").withColumnRenamed("rule", "by")
    out = matches.join(F.broadcast(rules), "rule")  # a row per rule
    out = out.join(labelled, (F.col("rule") == F.col("by")) & F.col("source").eqNullSafe(F.col("of")), "left")
    share = (F.coalesce("right", F.lit(0.0)) + strength * F.col("overall")) / (F.coalesce("n", F.lit(0)) + strength)
    confidence = F.least(F.greatest((share - chance) / F.lit(best - chance), F.lit(0.0)), F.lit(1.0))
    return out.select("ext_id", "item_index", "source", "rule", confidence.alias("confidence"))
