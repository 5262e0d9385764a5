import itertools
import random

import pytest

from listenloom.llm import runs as R
from listenloom.llm.recording import parse_artist, parse_track

SCHEMA = "play_id bigint, user_id string, ts bigint, artist string, track string, week string, opens int"


def _plays(spark, rows):
    return spark.createDataFrame([(*r, "clash", 0) for r in rows], SCHEMA)


def _runs(spark, rows, **how):
    return sorted((r.user_id, r.first_play_id, r.last_play_id, r.n_plays) for r in R.repeated_runs(_plays(spark, rows), **how).collect())


def test_spellings_make_one_run_and_versions_do_not(spark):
    names = ["Scarlet Cinder", "Scarlet Cindre", "SCARLET  CINDER ", "Scarlet Cinder (Remastered 2003)", "Scarlet Cinder (feat. Ana)", "Scarlet Cinder [Demo]", "Scarlet Cinder [Deemo]", "Scarlet Cinder, Pt. 2", "Scarlet Cinder (Live)", "Scarlet Cinder - Live at Vonaro Hall"]
    rows = [(i, "u", 1000 + 100 * i, "The Fanipo Sparrows", t) for i, t in enumerate(names)]
    assert _runs(spark, rows) == [("u", 0, 4, 5), ("u", 5, 6, 2)]


def test_gap_ties_redelivery_and_unusable_plays(spark):
    a = ("A", "Song")
    rows = [(1, "u", 10, *a), (2, "u", 1810, *a), (2, "u", 1810, *a), (3, "u", 3611, *a), (4, "u", 3611, *a), (5, "u", 3612, None, "Song"), (6, "u", 3613, "A", "  "), (7, "u", -5, *a), (8, None, 3614, *a), (9, "u", 3615, *a), (10, "v", 3616, *a)]
    assert _runs(spark, rows) == [("u", 1, 2, 2), ("u", 3, 9, 3)]


def test_runs_over_week_ends_do_not_depend_on_the_layout(spark):
    r = random.Random(5)
    rows, ts = [], 600_000
    for i in range(400):
        ts += r.choice([50, 300, 900, 1700, 2500, 90_000])
        rows.append((i, r.choice("uv"), ts, "Artist", r.choice(["Morning Harbour", "Morning Habour", "Evening Lantern"])))
    whole = _runs(spark, rows, week_seconds=10**9)
    assert whole == _runs(spark, rows, week_seconds=4000) == _runs(spark, rows)
    assert len(whole) > 20


def _whole(rows, gap=1800):
    """Brute force: each user's plays, cut where a pause or unlike neighbours force it, every division tried."""
    out = []
    for user in {r[1] for r in rows}:
        plays = sorted((r for r in rows if r[1] == user), key=lambda r: (r[2], r[0]))
        names = [(parse_artist(r[3]), *parse_track(r[4])[:2]) for r in plays]
        cuts = [0, *[i + 1 for i in range(len(plays) - 1) if plays[i + 1][2] - plays[i][2] > gap or not R._linkable(names[i], names[i + 1])], len(plays)]
        for s, e in zip(cuts, cuts[1:]):
            out += [(user, plays[s + i][0], plays[s + j - 1][0], j - i) for i, j in _cheapest(names[s:e], 1.0) if j - i > 1]
    return sorted(out)


def _cheapest(names, boundary):
    """Runs of the cheapest division, then the fewest, then the longest last run."""
    done = {0: (0.0, 0, ())}
    for j in range(1, len(names) + 1):
        options = []
        for i in range(j):
            near = [sum(R.unlikeness(r, x) for x in names[i:j]) for r in set(names) if all(R.unlikeness(r, x) < 9 for x in names[i:j])]
            if near:
                options.append((round(done[i][0] + min(near) + boundary, 9), done[i][1] + 1, i))
        cost, n, i = min(options)
        done[j] = (cost, n, (*done[i][2], (i, j)))
    return done[len(names)][2]


def test_a_stretch_over_a_week_end_is_segmented_whole(spark):
    names = ["Lanterna", "Lantern", "Antern"]
    for at in (5000, 3950, 3850, 3750):  # weeks of 4000 s: inside one, and with the border after each play
        rows = [(i, "u", at + 100 * i, "Artist", t) for i, t in enumerate(names)]
        assert _runs(spark, rows, week_seconds=4000) == [("u", 0, 2, 3)]


def test_near_spellings_over_week_ends_match_brute_force(spark):
    r = random.Random(11)
    rows, ts = [], 600_000
    for i in range(260):
        ts += r.choice([50, 300, 300, 900, 1700, 2500])
        rows.append((i, r.choice("uuv"), ts, r.choice(["Artist", "Artist", "Artits"]), r.choice(["Lanterna", "Lantern", "Antern", "Latern", "Lanternas", "Kettle"])))
    want = _whole(rows)
    assert len(want) > 20
    for week in (2000, 4000, 10**9):
        assert _runs(spark, rows, week_seconds=week) == want


@pytest.mark.parametrize("rows", [[], [(1, "u", 5, "A", "x")], [(1, None, None, None, None)]])
def test_nothing_repeated(spark, rows):
    assert _runs(spark, rows) == []


def test_very_long_names(spark):
    t = "Harbour " * 20_000
    assert _runs(spark, [(1, "u", 5, "A", t), (2, "u", 9, "A", t.upper())]) == [("u", 1, 2, 2)]


def _brute(names, boundary):
    best = (float("inf"), 99, None)
    for cuts in itertools.product([0, 1], repeat=len(names) - 1):
        edges = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(names)]
        cost = 0.0
        for a, b in zip(edges, edges[1:]):
            cost += boundary + min(sum(R.unlikeness(r, x) for x in names[a:b]) if all(R.unlikeness(r, x) < 9 for x in names[a:b]) else float("inf") for r in names)
        best = min(best, (round(cost, 9), len(edges) - 1, tuple(edges)))
    return best[:2]


def test_segmentation_is_optimal():
    r = random.Random(7)
    words = ["morning harbour", "morning harbuor", "mrning harbour", "morning harbours", "evening lantern", "evning lantern"]
    for _ in range(60):
        names = [("artist", r.choice(words), "") for _ in range(r.randint(1, 8))]
        cuts = R.segment(names, [1] * len(names), 1.0)
        assert [c[0] for c in cuts[1:]] == [c[1] for c in cuts[:-1]]
        cost = sum(1.0 + min(sum(R.unlikeness(k, x) for x in names[a:b]) for k in names) for a, b in cuts)
        assert (round(cost, 9), len(cuts)) == _brute(names, 1.0)


@pytest.mark.parametrize(
    ("text", "title", "version"),
    [
        ("Kettle - Acoustic - 1999 Remaster", "kettle", "acoustic:"),
        ("No River for Nopi (Part Two)", "no river for nopi", "part:2"),
        ("Humid Hammer (Duridi Remix) (Feat. Ana) - 2012 Remaster", "humid hammer", "remix:duridi"),
        ("Zipulawafu (Lagoon) [Mono Version]", "zipulawafu lagoon", ""),
        ("Ｋｅｙｈｏｌｅ （Ｌｉｖｅ）", "keyhole", "live:"),
        ("07. Window", "window", ""),
        ("", "", ""),
        ("(Live)", "live", ""),
    ],
)
def test_track_names(text, title, version):
    assert parse_track(text)[:2] == (title, version)


def test_artist_names():
    assert {parse_artist(a) for a in ("Fanipo Sparrows, The", "THE  FANIPO SPARROWS ", "The Fanipo Sparrows feat. Lumil")} == {"the fanipo sparrows"}
    assert parse_artist("Gakini & the Sparrows") == parse_artist("gakini and the sparrows")


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        (("letovopi", "gupapabafe", ""), ("letovui", "gupapabafe", ""), True),
        (("x", "distat togopegadu", ""), ("x", "ditsant togopegadu", ""), True),
        (("x", "northern pocket", ""), ("x", "northern jacket", ""), False),
        (("x", "yard", ""), ("x", "yarn", ""), True),
        (("letovopi", "quarry", ""), ("letovui", "quary", ""), False),
        (("x", "quarry", "live:"), ("x", "quarry", "live:mukite hall"), False),
        (("x", "quarry", "part:2"), ("x", "quarry", "part:3"), False),
        (("x", "quarry", "remix:safale"), ("x", "quarry", "remix:safael"), True),
    ],
)
def test_slips(a, b, same):
    assert (R.unlikeness(a, b) < 1) == same == (R.unlikeness(b, a) < 1)
