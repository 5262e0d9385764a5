"""What recording a written artist and track name: spelling set aside, versions kept.

``parse_artist`` and ``parse_track`` bring names to comparable keys. A track's
trailing parts, in brackets or after a dash, are read word by word: guest credits
and packaging are dropped, versions become a marker of their own (``live:mukite
hall``, ``remix:vinina``, ``part:2``), anything else belongs to the title. Words are
recognised with one slip of the pen.
"""

from __future__ import annotations

import re
import unicodedata

# Words of packaging, guest credits and versions.
PACKAGING = ("remaster", "remastered", "remastering", "radio", "edit", "single", "version", "album", "explicit", "clean", "deluxe", "edition", "mono", "stereo", "expanded", "anniversary", "bonus", "track", "digital", "digitally", "original", "reissue", "special", "standard", "collectors", "lyrics", "official", "audio", "video", "feature")
GUEST = ("feat", "featuring", "ft", "with")
VERSIONS = {"live": "live", "acoustic": "acoustic", "unplugged": "acoustic", "instrumental": "instrumental", "inst": "instrumental", "demo": "demo", "remix": "remix", "remixed": "remix", "rmx": "remix", "mix": "remix", "rework": "remix", "dub": "dub", "karaoke": "karaoke", "orchestral": "orchestral", "cover": "cover", "tribute": "cover", "acapella": "acapella", "session": "session", "sessions": "session", "medley": "medley", "nightcore": "remix", "slowed": "remix"}
FILLING = ("version", "recording", "recorded", "at", "in", "from", "the", "take", "performance", "mix", "of", "by", "style")
NUMBERS = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "i": 1, "ii": 2, "iii": 3, "iv": 4, "v": 5, "vi": 6, "vii": 7, "viii": 8, "ix": 9, "x": 10}
PART = ("pt", "part", "vol", "volume", "no", "chapter")
PACKAGING_ALONE = frozenset(w for w in PACKAGING if w not in ("single", "track", "original", "special", "standard", "radio", "video", "clean", "feature", "album"))

_DASHES = re.compile("[‐‑‒–—―−]")
_QUOTES = re.compile("[’‘`´ʼ′\"“”]")
_TRACK_NO = re.compile(r"^\s*\d{1,3}\s*[.)]\s+")
_TAIL = re.compile(r"^(.*?)\s*[(\[{]([^()\[\]{}]*)[)\]}]?[\s.,;:-]*$", re.S)
_DASH_TAIL = re.compile(r"^(.*)\s-+(?:\s+([^()\[\]{}]*?))?[\s.,;:]*$", re.S)
_GUEST_WORD = re.compile(r"\s+[(\[]?([a-z]{2,12})(\.?)(?=\s)")
_NUMBER_TAIL = re.compile(r"^(.*\S)[\s,]+(?:(?:pt|part|vol|volume)\.?\s*(\w+)|(ii|iii|iv|v|vi|vii|viii|ix|x))[\s.]*$", re.S)
_WORD = re.compile(r"[a-z0-9]+")
_PLAIN = re.compile(r"[A-Za-z' ]+")


def folded(s: str) -> str:
    """Case, width, accents, dashes, quotes and runs of white space set aside."""
    if not s.isascii():
        s = unicodedata.normalize("NFKC", s)
        s = _QUOTES.sub("'", _DASHES.sub("-", s))
        s = "".join(c for c in unicodedata.normalize("NFKD", s.casefold()) if not unicodedata.combining(c))
    else:
        s = s.lower()
    return " ".join(s.split())


def osa(a: str, b: str, most: int = 2) -> int:
    """Edits (insert, delete, replace, swap of neighbours) from ``a`` to ``b``; ``most + 1`` if more."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    lo, n = 0, min(len(a), len(b))
    while lo < n and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < n - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    a, b = a[lo : len(a) - hi], b[lo : len(b) - hi]
    if not a or not b:
        return min(len(a) + len(b), most + 1)
    if len(a) == len(b) == 1:
        return 1
    older, old = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            c = min(old[j] + 1, new[j - 1] + 1, old[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                c = min(c, older[j - 2] + 1)
            new.append(c)
        if min(new) > most:
            return most + 1
        older, old = old, new
    return min(old[-1], most + 1)


def _deletes(w: str) -> set[str]:
    return {w} | ({w[:i] + w[i + 1 :] for i in range(len(w))} if len(w) > 3 else set())


_LEXICON: dict[str, set[str]] = {}
for _w in {*PACKAGING, *GUEST, *VERSIONS, *PART}:
    for _d in _deletes(_w):
        _LEXICON.setdefault(_d, set()).add(_w)


def known_word(w: str) -> str | None:
    """The listed word that ``w`` is, allowing one slip in words of four letters and more."""
    if w in _LEXICON and w in _LEXICON[w]:
        return w
    if len(w) < 3:
        return None
    for d in _deletes(w) if len(w) > 3 else {w}:
        for k in sorted(_LEXICON.get(d, ())):
            if len(k) > 3 and osa(w, k, 1) <= 1:
                return k
    return None


def _is_credit(w: str, dotted: bool) -> bool:
    """Whether ``w`` announces a guest, as listed or by a slip that hardly makes another word.

    Such a slip brings in no letter; without a full stop it also keeps the first and the last one and loses none.
    """
    for k in GUEST:
        if w == k and k != "with":
            return True
        if len(k) > 3 and k != "with" and set(w) <= set(k) and osa(w, k, 1) <= 1 and (dotted or (w[0], w[-1], set(w)) == (k[0], k[-1], set(k))):
            return True
    return False


def _without_guests(s: str) -> str:
    """``s`` up to the first word that announces a guest."""
    for m in _GUEST_WORD.finditer(s):
        if _is_credit(m[1], bool(m[2])):
            return s[: m.start()]
    return s


def _is_article(w: str) -> bool:
    """``the``, as written or with two neighbours swapped."""
    return w == "the" or sorted(w) == sorted("the") and osa(w, "the", 1) == 1


def _number(w: str) -> int | None:
    return int(w) if w.isdigit() and len(w) < 3 else NUMBERS.get(w)


def classify(part: str, bracketed: bool) -> tuple[str, str] | None:
    """``("drop", "")``, ``(version, detail)`` or None where the part belongs to the title."""
    words = _WORD.findall(part.replace("'", ""))
    if not words:
        return ("drop", "")
    known = [known_word(w) for w in words]
    if known[0] in GUEST and (known[0] != "with" or bracketed) and (len(words) > 1 or known[0] != "with"):
        return ("drop", "")
    if known[0] in PART and len(words) == 2 and known[0] != "no" and _number(words[1]):
        return ("part", str(_number(words[1])))
    kinds = [VERSIONS[k] for k in known if k in VERSIONS]
    if kinds:
        at = next(i for i, k in enumerate(known) if k in VERSIONS)
        detail = [w for i, w in enumerate(words) if i != at and w not in FILLING and known[i] not in ("version", "recording", "edit") and not (known[i] in PACKAGING and i)]
        return (kinds[0], " ".join(detail))
    names = [w for w, k in zip(words, known) if k not in PACKAGING and not w.isdigit() and not re.fullmatch(r"\d+(st|nd|rd|th)|\d{2,4}\w?|\w?\d{2,4}|the|for", w)]
    if not names and any(k in PACKAGING for k in known):
        return ("drop", "")
    if known[-1] == "edit" and len(names) == len(words) - 1:
        return ("remix", " ".join(names))
    return None


def _cut_word(part: str) -> tuple[str, str] | None:
    """What a name that was cut off after ``part`` went on with."""
    words = _WORD.findall(part)
    if not words:
        return ("drop", "")
    found = classify(part, True)
    if found:
        return found
    if all(w.isdigit() for w in words):  # the year of an edition
        return ("drop", "")
    w = words[-1]
    if len(words) == 1 or known_word(words[0]) in (*GUEST, *PACKAGING):
        for k in (*GUEST, *PACKAGING):
            if k.startswith(w):
                return ("drop", "")
        for k, v in VERSIONS.items():
            if k.startswith(w):
                return (v, "")
    return None


def parse_track(track: str) -> tuple[str, str, bool]:
    """``(title key, version key, cut)`` of a track's name; ``cut`` if it ends in an ellipsis."""
    if _PLAIN.fullmatch(track):
        title, versions, cut = track.lower(), [], False
        m = _NUMBER_TAIL.match(title)
        if m and not m[2]:
            title, versions = m[1], [f"part:{_number(m[3])}"]
        title = title.replace("'", "")
    else:
        s = _TRACK_NO.sub("", folded(track))
        versions, cut = [], False
        if s.endswith(("…", "...")):
            s, cut = s.rstrip(".… "), True
            m = re.match(r"^(.*?)\s*[(\[]([^()\[\]]*)$", s) or re.match(r"^(.*\S)\s+-\s*([^-]*)$", s)
            if m and m[1] and (found := _cut_word(m[2])):
                s = m[1]
                if found[0] != "drop":
                    versions.append(":".join(found))
        while True:
            shorter = _without_guests(s)
            m = _NUMBER_TAIL.match(shorter)
            if m and (n := _number(m[2] or m[3])):
                s = m[1]
                versions.append(f"part:{n}")
                continue
            if shorter != s and shorter.strip():
                tail = s[len(shorter) :]
                s = shorter
                for other in re.findall(r"\s-\s+([^-]+)|[)\]]\s*[(\[]([^()\[\]]*)[)\]]", tail):
                    if (found := classify(other[0] or other[1], True)) and found[0] != "drop":
                        versions.append(":".join(found))
                continue
            m, bracketed = _TAIL.match(s), True
            if not m:
                m, bracketed = _DASH_TAIL.match(s), False
            if not m or not m[1].strip():
                break
            found = classify(m[2] or "", bracketed)
            if not found:
                break
            s = m[1]
            if found[0] != "drop":
                versions.append(":".join(found))
        title = s.replace("'", "")
    words = _WORD.findall(title) or re.findall(r"\w+", title)
    return " ".join(words), "|".join(sorted(set(versions))), cut


def parse_artist(artist: str) -> str:
    """Key of an artist's name: guests dropped, ``X, The`` turned round, ``&`` written out."""
    s = folded(artist)
    s = _without_guests(s) or s
    head, comma, tail = s.rpartition(", ")
    if comma and _is_article(tail):
        s = f"the {head}"
    s = s.replace("&", " and ").replace("'", "")
    words = _WORD.findall(s) or re.findall(r"\w+", s)
    return " ".join(words)


def versions_alike(a: str, b: str) -> int:
    """Slips between two version keys, 9 if they mean different versions."""
    if a == b:
        return 0
    x, y = a.split("|"), b.split("|")
    if len(x) != len(y) or not a or not b:
        return 9
    total = 0
    for p, q in zip(x, y):
        k, _, d = p.partition(":")
        l, _, e = q.partition(":")
        if k != l or k == "part" and d != e or bool(d) != bool(e):
            return 9
        total += osa(d, e, 1) if d != e else 0
    return total if total <= 1 else 9


def titles_alike(a: str, b: str) -> int:
    """Slips between two keys: 0 or 1; 2 where two words have one each, or one word of six letters or more has two and keeps its ends; 9 for other names."""
    d = osa(a, b, 2)
    if d <= 1:
        return d
    if d == 2:
        x, y = a.split(), b.split()
        if len(x) == len(y):
            other = [(p, q) for p, q in zip(x, y) if p != q]
            if len(other) == 2 and all(osa(p, q, 1) <= 1 for p, q in other):
                return 2
            if len(other) == 1 and min(map(len, other[0])) >= 6 and other[0][0][0] == other[0][1][0] and other[0][0][-1] == other[0][1][-1]:
                return 2
    return 9
