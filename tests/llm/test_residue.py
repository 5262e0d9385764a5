import pytest

from listenloom.llm.residue import learned_vocabulary, mark_residue, residue_kind, without_residue

RESIDUE = {
    "placeholder": ["Hello {{ user.name }}, welcome.", "Tonight at <%= host %>.", "&lt;%= artist %&gt; was formed in X.", "By ${artist}, #{city}", "[object Object] spielt", "Doors [INSERT DATE HERE].", "on {releaseYear} and {0}", "*|ALBUM|*", "XX_CITY_XX", "__DATE__ said", "%(venue)s by", "People who file [[label|default]] under ambient.", "Hallo {% if host %}", "[liner note] goes here", "<insert artist> by", "[TODO: album] mix", "{ label | upper }"],
    "error": ["404 Not Found", "Menu\nSearch\nSign in\nPage not found\n(c) all rights reserved", "Oops! Something went wrong on our side. Try again in a few minutes.", "Traceback (most recent call last):\n  File \"/app/x.py\", line 9, in render\nKeyError: 'artist'", '{"error": {"code": 404, "message": "track not found", "request_id": "ab12cd"}}', "Seite nicht gefunden. Die angeforderte Seite existiert nicht mehr.", "Gateway time-out. The upstream server did not respond in 30 s.", "<html><head><title>503 error</title></head><body><h1>503</h1></body></html>"],
    "script": ["Please enable JavaScript to continue.", "Home | Charts | About us | Help\nVeuillez activer JavaScript pour afficher cette page.", "<noscript>This page needs JavaScript to show the track list.</noscript>", "Enable JS and disable any ad blocker."],
    "filler": ["Lorem ipsum dolor sit amet, consectetur adipiscing elit.", "Biography\nLorem ipsum labore et nostrud.", "asdf asdf qwer jkl", "bla bla bla, biography bla bla", "Your biography goes here.", "Blindtext für die Vorschau, bitte ersetzen (review).", "tbd tbd tbd"],
}
REAL = [
    "For my files I use the naming pattern {{artist}} - {{title}} and it has never let me down.",
    "My tagger writes folders as `<%= artist %>`, which suits box sets.",
    "Capo 2: {C} {G} [Am] {F}, then hold. {slow} [Chorus x2] [laughs]",
    "In the template language you write {{ name }} where the variable goes.",
    "```\nprint('{{ artist }}')\n```\nThat is how the page is made.",
    "Every time I search for this band I land on a 404 page.",
    "The new single is called Page Not Found, and Nadupa means it.",
    "Since the update the player says JavaScript is disabled, although it is not.",
    "The sleeve is printed with lorem ipsum instead of lyrics, a joke about filler tracks.",
    "After 22 listens I still cannot tell the clarinet from the organ.\nError: related tracks not available.",
    "The script for the video required three drafts, and an error in the mix was left in on purpose.",
    "first", "ok", "great!", "+1", "$5 on the door, 50% off at the merch table", "Sliver of Tavo [Demo]",
    "", "   ", None,
]


@pytest.mark.parametrize(("kind", "text"), [(k, t) for k, texts in RESIDUE.items() for t in texts])
def test_residue(kind, text):
    assert residue_kind(text) == kind


@pytest.mark.parametrize("text", REAL)
def test_real_text_stays(text):
    assert residue_kind(text) is None


def test_placeholder_deep_in_a_long_text():
    body = "The mix is muddy and I would not change a thing. " * 20_000
    assert residue_kind(body) is None and residue_kind(body + "By {{artist}}.") == "placeholder"


@pytest.mark.parametrize(
    "text",
    [
        "Hi {{ user\n.name }}, welcome.",
        "By {{ artist of the month, whoever that may be. Ask the desk? They know. Otherwise leave it empty and go on with the " + "next " * 40 + "}}.",
        "The notes mention templates.\nTonight at {{ venue }} with friends of the house.",
    ],
)
def test_placeholders_over_lines_and_beside_talk(text):
    assert residue_kind(text) == "placeholder"


@pytest.mark.parametrize(
    "text",
    [
        "A tour of the template syntax, one variable a line:\n{{artist}}\n{{title}}\n- {{album}}\nThat was all.",
        "Our docs list these placeholders:\n\n* {{ venue }}\n* <%= date %>",
    ],
)
def test_lists_of_placeholders_belong_to_what_introduces_them(text):
    assert residue_kind(text) is None


def test_messages_in_words_that_no_list_has(spark):
    def page(k):
        return f"404: the flumox you grelled was not found. Kindly brintle the flumox{' again' * (k % 2)}."

    plain = ["Side one opens with a slow waltz and a cough.", "I heard a flute, then nothing was quite as loud again.", "The second error in the mix was left in on purpose, they say."]
    rows = [(i, page(i)) for i in range(60)] + [(100 + i, plain[i % 3]) for i in range(300)] + [(900, "404 Not Found")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {"flumox", "grelled", "brintle"} <= learned_vocabulary(df).message
    assert {r.doc_id for r in mark_residue(df).where("residue = 'error'").collect()} == {*range(60), 900}
    assert residue_kind(page(0)) is None


def test_rows_are_kept(spark):
    rows = [(1, "404 Not Found", "x", 5), (1, "404 Not Found", "x", 5), (2, None, None, 6), (None, "A fine record, this.", "y", 7)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, residue string, sentence int")
    assert sorted((str(r.doc_id), r.sentence, r.residue) for r in mark_residue(df).collect()) == [("1", 5, "error"), ("1", 5, "error"), ("2", 6, None), ("None", 7, None)]
    assert without_residue(df).count() == 2
    assert mark_residue(df.limit(0)).count() == 0
