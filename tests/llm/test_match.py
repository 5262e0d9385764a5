import pytest

from listenloom.llm.match import core_of, match_recordings

LISTING = "ext_id bigint, source string, artist string, track string, duration_ms bigint, release_year int, album string, item_index string, id int"
ITEM = "item_index bigint, artist string, track string, genre string, tags string, duration_ms bigint, release_ts bigint, source string"

CATALOG = [
    (0, "The Fanipo Sparrows", "Scarlet Cinder", 200_000),
    (1, "The Fanipo Sparrows", "Scarlet Cinder (Live)", 210_000),
    (2, "Zokuto & the Harvesters", "Feather, Broken Feather", 186_000),
    (3, "Movuli-Kise", "Engine of Butiti", 165_000),
    (4, "Fehopi", "No River for Nopi, Pt. 2", 240_000),
    (5, None, None, 1),
    (6, "Dobare", "Repair the Silent Cinder", 215_000),
]


def _match(spark, listings, catalog=CATALOG):
    left = spark.createDataFrame([(i, s, a, t, d, (*year, 2001)[0], "x", "clash", 3) for i, s, a, t, d, *year in listings], LISTING)
    right = spark.createDataFrame([(i, a, t, "g", "t", d, 1_000_000_000, "clash") for i, a, t, d in catalog], ITEM)
    return match_recordings(left, right)


CASES = [
    ("Fanipo Sparrows, The", "SCARLET  CINDER.", 201_000, 0, "exact"),
    ("The Fanipo Sparrows", "Scarlet Cinder [live recording]", None, 1, "exact"),
    ("Fanipo Sparrows", "Scarlet Cinder - Radio Edit", 200_000, 0, "artist_variant"),
    ("Scarlet Cinder", "The Fanipo Sparows", 200_000, 0, "artist_variant"),
    (None, "Zokuto - Feather, Broken Feather", 186_000, 2, "artist_variant"),
    ("Movuli-Kise", "Engnie of Butiti", 165_000, 3, "title_slip"),
    ("Movuil-Kisse", "Engine of Butiti", 165_000, 3, "artist_variant"),
    ("Fehopi", "No Rievr fr Nopi (Part Two)", 241_000, 4, "title_slips"),
    ("Dobare", "Repair the Silent Ci…", None, 6, "cut_title"),
    ("Dobare", "Repair the Silent Ci", None, 6, "cut_title"),
    ("Dobare", "Repair the Silent", None, None, None),
    ("Movuli-Kise", "Engine of Butiti - 20…", 165_000, 3, "exact"),
    ("The Fanipo Sparrows", "Scarlet Cinder (Karaoke)", 200_000, None, None),
    ("The Fanipo Sparrows", "Scarlet Cinder, Pt. 3", 200_000, None, None),
    ("Somebody Else", "Scarlet Cinder", 200_000, None, None),
    ("Movuli-Kise", "Engnie of Butiti", 300_000, None, None),
    (None, None, None, None, None),
    ("", "  ", None, None, None),
    ("x" * 3000, "y" * 30_000, None, None, None),
]


def test_every_rule(spark):
    rows = [(i, "shop", a, t, d) for i, (a, t, d, *_) in enumerate(CASES)]
    got = {r.ext_id: (r.item_index, r.rule) for r in _match(spark, rows + rows[:3] + [(None, "shop", "Fehopi", "x", 1)]).collect()}
    assert got == {i: (w, rule) for i, (*_, w, rule) in enumerate(CASES) if w is not None}


def test_confidence_is_read_from_years_that_no_rule_looks_at(spark):
    name = ("Fehopi", "No River for Nopi, Pt. 2", 240_000)
    rows = [(i, "a", *name, 2001) for i in range(30)] + [(100 + i, "b", *name, 1990) for i in range(10)] + [(200, "c", *name, None)]
    rows += [(300 + i, "a", "Somebody Else", "Unknown", None, 1950 + i) for i in range(35)]
    c = {r.source: r.confidence for r in _match(spark, rows).collect()}
    chance, best = 30 / 75, 31 / 42
    overall = (30 + 20 * best) / 60
    read = lambda share: min(1.0, max(0.0, (share - chance) / (best - chance)))
    assert c["a"] == pytest.approx(read((30 + 20 * overall) / 50))
    assert c["b"] == pytest.approx(read(20 * overall / 30))
    assert c["c"] == pytest.approx(read(overall)) and c["b"] < c["c"] <= c["a"]


@pytest.mark.parametrize(("listings", "catalog"), [([], CATALOG), ([(1, "a", "Fehopi", "x", 1)], []), ([], [])])
def test_empty_tables(spark, listings, catalog):
    assert _match(spark, listings, catalog).count() == 0


def test_best_of_several_candidates_and_ties(spark):
    twins = [(1, "Ana", "Harbour", 300_000), (2, "Ana", "Harbour", 200_000), (3, "Ana", "Harbour", 200_000)]
    assert [r.item_index for r in _match(spark, [(9, "a", "Ana", "Harbour", 201_000)], twins).collect()] == [2]


def test_titles_of_a_large_artist_meet_only_near_ones(spark):
    words = ["harbour", "lantern", "kettle", "meadow", "window", "ribbon", "copper", "thicket"]
    catalog = [(i, "Ana", f"Love {words[i % 8]} {words[i // 8 % 8]} {words[i // 64]}", None) for i in range(512)]
    listings = [(i, "a", "Ana", f"Lvoe {words[i % 8][:-1]} {words[i // 8 % 8]} {words[i // 64]}", None) for i in range(0, 512, 5)]
    got = {r.ext_id: (r.item_index, r.rule) for r in _match(spark, listings, catalog).collect()}
    assert got == {i: (i, "title_slips") for i in range(0, 512, 5)}


def test_core():
    assert core_of("the x and the ys") == "x" and core_of("dosani ziho trio") == "dosani ziho" and core_of("and") == "and"
