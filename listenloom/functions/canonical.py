"""The identity of an item: artist and track with credits and packaging set aside.

A name is read as pieces. Every bracket opens a piece; one whose content announces a
guest, or is a phrase of packaging with or without a year, goes. What is left is read as
segments between dashes: all from a guest credit on go, and packaging at the end. Signs
that hold names together are taken off the edges. This is done until nothing changes.

The rule comes three times from one set of words: as an expression for Spark, as SQL for
the checks, and in Python with NFKC and case folding, which Spark has no function for,
for distinct names only. They agree on text without compatibility characters.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

SEPARATOR = " :: "
# Words that announce a guest, in brackets or after a dash, and in brackets only.
CREDITS = ("feat", "ft", "featuring")
BRACKET_CREDITS = (*CREDITS, "with")
# Packaging that doesn't make another recording, as one word or as two that may be run together.
PACKAGING_WORDS = ("remaster", "remastered", "re-master", "deluxe", "explicit", "clean")
PACKAGING_PAIRS = (("remastered", "version"), ("radio", "edit"), ("single", "version"), ("album", "version"), ("original", "mix"), ("mono", "version"), ("stereo", "version"), ("deluxe", "edition"), ("bonus", "track"))
# Signs that mean nothing at the edges of a name.
EDGE_SIGNS = " -–—_.,;:"
#: How often a name is read over at most.
ROUNDS = 8

PHRASES = (*PACKAGING_WORDS, *(gap.join(pair) for pair in PACKAGING_PAIRS for gap in (" ", "")))
#: A word of packaging has a dash of its own; it is hidden while dashes separate.
_DASHED, _HIDDEN = "re-master", "re\u0001master"
_DIGITS = "0123456789"


# in Python ------------------------------------------------------------------------------
def _first_word(s: str) -> str:
    s = s.lstrip()
    end = next((i for i, c in enumerate(s) if not (c.isalnum() or c == "_")), len(s))
    return s[:end]


def _is_year(s: str) -> bool:
    return len(s) == 4 and all(c in _DIGITS for c in s)


def _is_packaging(s: str) -> bool:
    s = s.strip()
    if _is_year(s[:4]) and s[4:]:
        s = s[4:].lstrip()
    if _is_year(s[-4:]) and s[:-4]:
        s = s[:-4].rstrip()
    return s.replace("\u0001", "-") in PHRASES


def _read_over(text: str) -> str:
    pieces, at = [], 0
    for i, c in enumerate(text):
        if c in "([" and i > at:
            pieces.append(text[at:i])
            at = i
    kept = ""
    for piece in [*pieces, text[at:]]:
        close = min((k for k in (piece.find(")"), piece.find("]")) if k >= 0), default=-1)
        inner = piece[1:close] if piece[:1] in ("(", "[") and close > 0 else None
        if inner is not None and (_first_word(inner.lower()) in BRACKET_CREDITS or _is_packaging(inner.lower())):
            kept, piece = kept.rstrip(), piece[close + 1 :]
        kept += piece
    segments = kept.split("-")
    credit = next((i for i, s in enumerate(segments) if i and _first_word(s.lower()) in CREDITS), len(segments))
    segments = segments[:credit]
    if len(segments) > 1 and _is_packaging(segments[-1].lower()):
        segments.pop()
        if len(segments) > 1 and _is_year(segments[-1].strip()):
            segments.pop()
    return "-".join(segments).strip(EDGE_SIGNS)


def normalised_text(text: str | None) -> str:
    """The rule with all of Unicode."""
    if text is None or isinstance(text, float):
        return ""
    text = " ".join(unicodedata.normalize("NFKC", str(text)).split())
    text = _hide(text)
    for _ in range(ROUNDS):
        shorter = _read_over(text)
        if shorter == text:
            break
        text = shorter
    return " ".join(text.replace("\u0001", "-").split()).casefold()


def _hide(text: str) -> str:
    low, at, out = text.lower(), 0, []
    if len(low) != len(text):
        return text
    while (k := low.find(_DASHED, at)) >= 0:
        out += [text[at : k + 2], "\u0001"]
        at = k + 3
    return "".join([*out, text[at:]])


# in Spark -------------------------------------------------------------------------------
def _let(c: Column, f) -> Column:
    """``f`` of ``c``, which is evaluated once."""
    return F.transform(F.array(c), f)[0]


def _words(values: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _packaging(c: Column) -> Column:
    """Whether lower-case ``c`` is packaging, with or without years around it."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.trim(c), r"^\d{4}(?=.)", ""), r"(?<=.)\d{4}$", ""))
    return F.array_contains(_words(PHRASES), F.replace(bare, F.lit("\u0001"), F.lit("-")))


def _opening(c: Column) -> Column:
    return F.regexp_extract(c, r"^\s*(\w*)", 1)


def _pieces(text: Column) -> Column:
    def judged(piece: Column) -> Column:
        inner = F.lower(F.regexp_extract(piece, r"^[(\[]([^)\]]*)[)\]]", 1))
        goes = piece.rlike(r"^[(\[][^)\]]*[)\]]") & (F.array_contains(_words(BRACKET_CREDITS), _opening(inner)) | _packaging(inner))
        return F.struct(goes.alias("goes"), F.when(goes, F.substring(piece, F.length(inner) + 3, F.length(piece))).otherwise(piece).alias("rest"))

    parts = F.transform(F.regexp_extract_all(text, F.lit(r"[(\[]?[^(\[]+|[(\[]"), F.lit(0)), judged)
    return F.aggregate(parts, F.lit(""), lambda kept, p: F.concat(F.when(p["goes"], F.rtrim(kept)).otherwise(kept), p["rest"]))


def _segments(text: Column) -> Column:
    def cut(all_: Column) -> Column:
        credit = F.transform(all_, lambda s, i: (i > 0) & F.array_contains(_words(CREDITS), _opening(F.lower(s))))
        return F.slice(all_, 1, F.when(F.array_contains(credit, F.lit(True)), F.array_position(credit, F.lit(True)) - 1).otherwise(F.size(all_)).cast("int"))

    def shorter(s: Column) -> Column:
        n = F.size(s)
        packaged = (n > 1) & _packaging(F.lower(F.element_at(s, -1)))
        dated = packaged & (n > 2) & F.trim(F.try_element_at(s, F.lit(-2))).rlike(r"^\d{4}$")
        return F.array_join(F.slice(s, 1, n - F.when(dated, 2).when(packaged, 1).otherwise(0)), "-")

    return F.btrim(_let(_let(F.split(text, "-"), cut), shorter), F.lit(EDGE_SIGNS))


def normalised(c: Column, rounds: int = ROUNDS) -> Column:
    """The rule as an expression; null gives an empty string."""
    text = F.trim(F.regexp_replace(F.translate(F.coalesce(c, F.lit("")), " ", " "), r"\s+", " "))
    shorter = F.regexp_replace(text, "(?i)(re)-(master)", "$1\u0001$2")
    # brackets all go at once, so only dashes may need another look
    over = lambda t, k: F.when((k == 0) | F.contains(t, F.lit("-")), _segments(_pieces(t))).otherwise(t)
    shorter = F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), shorter, over)
    # most names have no sign that makes another piece, and one look tells
    suspect = text.rlike(r"[(\[-]") | (F.btrim(text, F.lit(EDGE_SIGNS)) != text)
    return F.lower(F.when(suspect, F.trim(F.regexp_replace(F.replace(shorter, F.lit("\u0001"), F.lit("-")), r"\s+", " "))).otherwise(text))


@F.pandas_udf(StringType())
def _normalised_udf(s: pd.Series) -> pd.Series:
    return s.map(normalised_text)


def with_item_key(df: DataFrame, unicode: bool = True, name: str = "item_key") -> DataFrame:
    """``df`` with ``item_key``, computed once per distinct pair of artist and track.

    The pairs are joined back by value; null counts as empty.
    """
    pairs = df.select("artist", "track").distinct()
    key = (lambda c: _normalised_udf(c)) if unicode else normalised
    keyed = pairs.select(F.col("artist").alias("__a"), F.col("track").alias("__t"), F.concat(key(F.col("artist")), F.lit(SEPARATOR), key(F.col("track"))).alias(name))
    return df.drop(name).join(keyed, F.col("artist").eqNullSafe(F.col("__a")) & F.col("track").eqNullSafe(F.col("__t")), "left").drop("__a", "__t")


# in the SQL of the checks -----------------------------------------------------------------
def sql_normalised(c: str, rounds: int = ROUNDS) -> str:
    def listed(values: tuple[str, ...]) -> str:
        return "[" + ", ".join(f"'{v}'" for v in values) + "]"

    def packaging(x: str) -> str:
        bare = f"trim(regexp_replace(regexp_replace(trim({x}), '^\\d{{4}}(.)', '\\1'), '(.)\\d{{4}}$', '\\1'))"
        return f"list_contains({listed(PHRASES)}, replace({bare}, chr(1), '-'))"

    def opening(x: str) -> str:
        return f"regexp_extract({x}, '^\\s*(\\w*)', 1)"

    inner = "lower(regexp_extract(p, '^[(\\[]([^)\\]]*)[)\\]]', 1))"
    goes = f"(regexp_matches(p, '^[(\\[][^)\\]]*[)\\]]') AND (list_contains({listed(BRACKET_CREDITS)}, {opening(inner)}) OR {packaging(inner)}))"
    # a mark before what follows a piece that goes, so that white space before it goes too
    piece = f"CASE WHEN {goes} THEN chr(2) || substr(p, length({inner}) + 3) ELSE p END"
    pieces = f"regexp_replace(array_to_string(list_transform(regexp_extract_all(t, '[(\\[]?[^(\\[]+|[(\\[]'), lambda p: {piece}), ''), ' *' || chr(2), '', 'g')"
    credit = f"coalesce(list_position(list_transform(s, lambda x, i: i > 1 AND list_contains({listed(CREDITS)}, {opening('lower(x)')})), true), 0)"
    cut = f"CASE WHEN {credit} > 0 THEN s[1:{credit} - 1] ELSE s END"
    packaged = f"(len(u) > 1 AND {packaging('lower(u[-1])')})"
    dated = f"({packaged} AND len(u) > 2 AND regexp_matches(trim(u[-2]), '^\\d{{4}}$'))"
    shorter = f"array_to_string(u[1:len(u) - CASE WHEN {dated} THEN 2 WHEN {packaged} THEN 1 ELSE 0 END], '-')"
    over = f"trim(list_transform([list_transform([string_split({pieces}, '-')], lambda s: {cut})[1]], lambda u: {shorter})[1], '{EDGE_SIGNS}')"
    text = f"regexp_replace(trim(regexp_replace(replace(coalesce({c}, ''), chr(160), ' '), '\\s+', ' ', 'g')), '(?i)(re)-(master)', '\\1' || chr(1) || '\\2', 'g')"
    for k in range(rounds):
        text = f"list_transform([{text}], lambda t: {over if not k else f'CASE WHEN contains(t, chr(45)) THEN {over} ELSE t END'})[1]"
    return f"lower(trim(regexp_replace(replace({text}, chr(1), '-'), '\\s+', ' ', 'g')))"
