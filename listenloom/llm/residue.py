"""Documents that are residue of a template or a page that didn't load.

A document is residue if a placeholder was left unfilled anywhere in it, or if its
whole text is filler, an error message or page, or a notice that scripts are required.

Placeholders are found by a grammar per kind of delimiter. Those in code don't count, nor
do those whose surroundings talk about naming patterns, templates and the like: the
sentence around them, and for lines that hold little else than placeholders the sentence
that introduces them.

Whole texts are judged by density, sentence by sentence. A sentence is marked by the
phrase of a message; it is residue if at least ``DENSE`` of its words belong to the
vocabulary of such messages, and a text is if nothing else stands in it. The vocabulary
starts from listed words and is corrected by the corpus: words come in that recur in
residue and are rare in plain texts, or stand in a good part of all residue, and go out
if plain texts have them and residue never does.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from listenloom.runtime import discard, materialize

# Names of fields that templates fill in, for delimiters that are also used otherwise.
FIELDS = set("artist title album track name host city genre label date venue duration user year curator playlist count firstname lastname email price order id url country region price amount total company product category author subject address phone time month day week release trackcount username artistname playlistname tracktitle releaseyear text description headline body content value item items message link image number".split())

_NAME = r"[A-Za-z_$][\w$]*(?:\.\w+)*"
#: Delimiters that only templates use, with what may stand between them.
STRICT = [
    r"\{\{\{?\s*[#/^&>!~]?\s*(?:each |if |unless |with )?[^{}]*?\}?\}\}",
    r"\{%-?\s*\w[^%]*%\}",
    r"<%[=\-@]?\s*[^%]+?%>",
    r"<\?(?:=|php)\s*[^?]+?\?>",
    rf"[$#]\{{\s*{_NAME}\s*\}}",
    rf"\[\[\s*{_NAME}\s*(?:\|[^\[\]]*)?\]\]",
    rf"@@{_NAME}@@",
    r"\b__[A-Z][A-Z0-9_.]*?__(?!\w)",
    r"\bXX_[A-Z][A-Z0-9_.]*_XX\b",
    r"\*\|[A-Z][\w.:]*\|\*",
    r"(?<![\w$])\$[A-Z][A-Z0-9_.]+\$(?!\w)",
    rf"%\({_NAME}\)[sdif]",
    rf"<<\s*{_NAME}\s*>>",
    r"\[object Object\]",
    r"\[\s*(?:INSERT|Insert|insert|ENTER|Enter|enter)\s[^\[\]]+\]",
    r"<\s*(?:insert|INSERT|Insert|enter|your)\s[^<>]+>",
    r"\[\s*(?:TODO|FIXME|TBD|TBC)\b[^\[\]]*\]",
    r"\[\s*(?:your|Your|YOUR)\s[^\[\]]+\]",
    r"\[[A-Za-zÀ-ÿ ]{3,40}\]\s+(?:goes here|still missing|tbc|tbd|to follow|pending)\b",
    r"(?<!\{)\{\d{1,2}\}(?!\})",
    rf"(?<!\{{)\{{\s*{_NAME}\s*\|\s*\w[^{{}}]*\}}(?!\}})",
]
#: Delimiters that need a name that looks like a field's.
LOOSE = [rf"(?<![{{$#])\{{({_NAME})\}}(?!\}})", r"(?<![\w%])%([A-Za-z][A-Za-z_.]+)%(?!\w)"]
_STRICT, _LOOSE = re.compile(rf"(?=[{{<\[@_*$%#X])(?:{'|'.join(STRICT)})"), [re.compile(p) for p in LOOSE]
_DELIMITERS = re.compile(r"[{<\[@_*$%]|XX_")
#: Words by which a sentence talks about placeholders instead of leaving one.
TALK = re.compile(
    r"\b(?:file ?names?|naming|renam\w+|folders?|format (?:field|string)|patterns?|mask|tagger|tag editor|export tool|templates? (?:engine|language|syntax|tag|variable)s?|templating|placeholders?|syntax|snippets?|tutorials?|documentation|docs|regex\w*|config\w*|jinja|mustache|handlebars|liquid|printf|f-strings?|escap\w+|curly|brackets?|braces|dialog|variables?|platzhalter|dateinam\w+|marcador\w*|variables? de)\b",
    re.I,
)
_CODE = re.compile(r"```.*?(?:```|\Z)|~~~.*?(?:~~~|\Z)|<(code|pre|kbd|samp)\b[^>]*>.*?</\1>|`[^`\n]+`", re.S | re.I)
_SENTENCE = re.compile(r"(?<=[.!?…])\s+|\n+")

# Words to start from, of error messages, notices about scripts, filler, and what stands around them.
ERROR_WORDS = set("""
error errors err code status http https page pages not found could be been requested you the at this address exist exists does behind link is are no longer here has have removed moved failed
to load loading looking for were tried open document track tracks playlist playlists profile review resource artist album song list content bio item article unavailable available service
temporarily internal server servers met an a unexpected condition bad gateway forbidden access denied permission don't dont your request was blocked ray reference too many requests rate limited
retry after seconds second minutes minute session expired please reload sign in again try later something went wrong on our side we hit snag lost thread couldn't couldnt can't cant reached
connection reset refused check and refresh sorry oops whoops hmm uh oh ups that did work nothing loaded few go back or search return start contact support team told having moment moments time out
timeout timed upstream respond s ms response from backend down maintenance under player establishing database site isn't isnt followed may broken checking browser while reading trace detail
message id null read properties of undefined index division by zero memory exhausted stack overflow cannot line uncaught fatal warning notice exception connect uri url method allowed gone
when as it its with there seems wait happened problem technical difficulties
seite nicht gefunden die der das angeforderte existiert mehr interner serverfehler bitte versuchen sie es minuten erneut diese dieser dieses rezension inhalt wurde konnte geladen werden ist
verfügbar fehler leider zugriff verweigert später noch einmal sekunden
introuvable le la les contenu demandé n'existe plus ou été déplacé erreur interne du serveur veuillez réessayer tard impossible de charger ne répond pas accès refusé n'est disponible cette
página no encontrada el contenido que buscas ya existe del servidor inténtelo nuevo más tarde se pudo cargar recurso está disponible acceso denegado esta lo sentimos error
""".split())
SCRIPT_WORDS = set("""
javascript js script scripts scripting client-side client side enable enabled enabling disable activate activated allow allowed turn turned switch switched on off to continue required is are view this
page it and reload you need needs run running app application your browser browsers does do support supported not or they blocked by an extension extensions sorry web player will work works with
disabled looks like in any ad blocker blockers requires require has have cookies cookie must be use using site website settings order load kindly please first before open appears unavailable
could executed lyrics library charts our track list lists playlist depends stays empty until cannot can't shown show without the a for of if properly correctly content display displayed see
bitte aktivieren sie um diese dieser seite anzuzeigen anwendung funktioniert nur mit eingeschaltetem ohne skripten skripte skript aktivierte aktiviertes lässt sich nicht anzeigen ist keine
anzeige möglich der die das player ihren ihrem im browser
veuillez activer pour afficher cette nécessite l'exécution de les sont désactivés contenu indisponible rechargez le la lecteur ne peut pas démarrer activez votre navigateur bloque et ce
activa active activar para ver esta página es necesario habilitar usar el reproductor su navegador tiene desactivado continuar lista este sitio necesita y recargue los del en
""".split())
FILLER_WORDS = set("""
placeholder dummy stub template replace me edit this text do not publish example only copy for layout sample body headline subheadline coming soon your own goes here type insert enter put write
add a an short below in box before publishing pending tbc tbd tba to follow still missing description of the be added is paragraph and will filled later test testing entry with some content
blindtext platzhalter für die der das vorschau bitte ersetzen texte factice à remplacer avant publication texto de relleno sustituir antes publicar
biography biografie biografía biographie bio critique review artist statement liner note notes playlist title artist album lyrics
""".split())
LOREM = set("lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum lipsum".split())
NONSENSE = set("text test asdf sdfg qwer qwert qwerty jkl hjkl uiop yxcv zxcv foo bar baz bla blah blabla xx xxx xxxx xxxxx xxxxxx x tbd tbc dummy lorem lipsum aaa abc abcd body copy sample placeholder".split())
_ERROR_CORE = re.compile(
    r"not found|(?:could|can) ?not be (?:found|loaded|reached|displayed|shown)|couldn't (?:load|find|open)|\berrors?\b|\berr\b|unavailable|denied|forbidden|bad gateway|time-?d?[ -]?out|expired|too many requests|rate limited|went wrong|hit a snag|can't be reached|connection (?:was )?(?:reset|refused)|not available|isn't available|no longer (?:here|available|exists?)|been removed|failed to load|request failed|does not exist|exception|traceback|having a moment|nothing could be loaded|lost the thread|did not work|request was blocked|blocked|checking your browser|status code|http \d{3}|unexpected condition|don't have permission|down for maintenance|may be broken|bad response|server error|^(?:fatal|warning|notice|exception)\b.* (?:at|in) \S+"
    r"|nicht gefunden|serverfehler|\bfehler\b|nicht mehr verfügbar|existiert nicht|nicht geladen|verweigert|introuvable|n'existe plus|\berreur\b|impossible de charger|ne répond pas|refusé|no encontrad|ya no existe|no se pudo|no está disponible|denegado"
)
_SCRIPT_CORE = re.compile(r"\b(?:javascript|js|scripts?|scripting|skripte?n?)\b")
_FILLER_CORE = re.compile(r"placeholder|dummy|\bstub\b|template|goes here|coming soon|replace (?:this|me)|to be added|\btype\b|\binsert\b|\benter\b|\bput\b|\bwrite\b|\badd\b|pending|\btbc\b|\btbd\b|to follow|still missing|blindtext|platzhalter|factice|relleno|sample text|test entry|body copy|^headline$|^subheadline$|do not publish")
_MENU = re.compile(r"(?:menu|menü|menú|search|suche|recherche|buscar|sign in|log ?in|sign up|register|home|start|startseite|accueil|inicio|help|hilfe|aide|ayuda|about|contact|contact support|contact us|imprint|impressum|privacy|terms|cookies?|cookie settings|back|back to (?:the )?(?:start|home) ?page|go back|skip to content|©.*|\(c\).*|.*all rights reserved\.?|\[?[0-9a-f]{4,}\]?|[-=_*#.•\s]+)")
_HEADING = re.compile(r"(?:biography|biografie|biografía|biographie|biografia|bio|review|rezension|reseña|critique|liner notes?|artist statement|playlist|playlist description|description|beschreibung|headline|title|about|lyrics|notes?|news|error|fehler|erreur)")
_TRACE = re.compile(r"(?:file \"[^\"]+\", line \d+.*|at [\w.$<>/]+\(.*\)|[\w.]*(?:error|exception)(?::.*)?|traceback \(most recent call last\):?|(?:proxy|nginx|apache|server)/[\d.]+.*|#\d+ .*)")
_CODE_TOKEN = re.compile(r"(?:/?[\w.\-]+/)+[\w.\-]*|\w+(?:\.\w+)+(?::\d+)?|\w+\(\)(?::\d+)?|\w+:\d+|\w*_\w+")
_TOKEN = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_TAG = re.compile(r"</?[a-zA-Z!][^<>]*>")
#: A stray term of one message may stand in another.
_MESSAGE_WORDS = ERROR_WORDS | SCRIPT_WORDS


def _placeholders(text: str) -> list[tuple[int, int]]:
    """Where the placeholders of a text stand, in order, whatever lies between their delimiters."""
    found = [m.span() for m in _STRICT.finditer(text)]
    for pattern in _LOOSE:
        for m in pattern.finditer(text):
            name = m[1]
            if name.lower().replace("_", "").split(".")[0] in FIELDS or "_" in name or "." in name.strip(".") or re.search(r"[a-z][A-Z]", name):
                found.append(m.span())
    return sorted(found)


def unfilled(text: str) -> bool:
    """Whether a placeholder was left unfilled in ``text``."""
    if not _DELIMITERS.search(text):
        return False
    text = _CODE.sub(" ", html.unescape(text) if "&" in text else text)
    hits = _placeholders(text)
    if not hits:
        return False
    # sentences, none of which ends inside a placeholder
    starts, at = [0], 0
    for m in _SENTENCE.finditer(text):
        while at < len(hits) and hits[at][1] <= m.start():
            at += 1
        if at == len(hits) or not hits[at][0] < m.start():
            starts.append(m.end())
    starts.append(len(text))
    inside: dict[int, list[tuple[int, int]]] = {}
    for h in hits:
        inside.setdefault(min(bisect_right(starts, h[0]), len(starts) - 1) - 1, []).append(h)

    def besides(k: int) -> str:
        out, at = [], starts[k]
        for s, e in inside.get(k, ()):
            out.append(text[at : max(at, s)])
            at = max(at, e)
        return " ".join([*out, text[at : starts[k + 1]]])

    for k in inside:
        context, told = besides(k), k
        bare = len(_TOKEN.findall(context)) <= 2
        talks = TALK.search(context)
        while bare and not talks and told:  # little but placeholders: what introduces them decides
            told -= 1
            context = besides(told)
            if not context.strip() or told in inside and len(_TOKEN.findall(context)) <= 2:
                continue
            talks = TALK.search(context) and context.rstrip().endswith(":")
            bare = False
        if not talks:
            return True
    return False


def _is_nonsense(words: list[str]) -> bool:
    kinds = set(words)
    if not words:
        return False
    lorem = sum(w in LOREM for w in words)
    if lorem >= max(1, 0.6 * len(words)) and (lorem > 1 or words[0] in ("lorem", "ipsum", "nostrud", "lipsum") or len(words) == 1 and words[0] in LOREM and words[0] not in ("in", "do", "non", "id", "est", "et", "ex", "ad")):
        return True
    silly = sum(w in NONSENSE for w in words)
    rest = [w for w in words if w not in NONSENSE and w not in FILLER_WORDS]
    if silly == len(words) and (len(words) >= 3 or len(words) == 2 and len(kinds) == 1):
        return True
    return len(words) >= 3 and silly >= 2 and silly >= 0.5 * len(words) and len(rest) <= 2 and len(kinds) < max(3, 0.8 * len(words))


#: The share of a marked sentence's words that belong to messages at least.
DENSE = 0.8
#: The shares, of marked sentences and of others, at which a text is likely enough to be residue to learn from.
LIKELY = (0.7, 0.5)


class Vocabulary:
    """Words of messages: the listed ones, those a corpus adds, without those it takes out."""

    def __init__(self, added: frozenset[str] = frozenset(), removed: frozenset[str] = frozenset()):
        self.message = (_MESSAGE_WORDS | added) - removed
        self.filler = (FILLER_WORDS | added) - removed

    def has(self, w: str) -> bool:
        return w in self.message or bool(re.fullmatch(r"[a-f]{1,8}", w)) or "-" in w and all(p in self.message for p in w.split("-"))


_LISTED = Vocabulary()


def sentence_kind(sentence: str, vocabulary: Vocabulary = _LISTED, dense: float = DENSE, around: float = 1.0) -> str:
    """``error``, ``script``, ``filler``, ``around`` (fits beside them) or ``other``.

    A sentence without the phrase of a message fits beside them if the share ``around`` of its words does.
    """
    s = " ".join(sentence.lower().replace("’", "'").split()).strip(" \t-–—|:;,·•*")
    if not s or _MENU.fullmatch(s):
        return "around"
    if _TRACE.fullmatch(s):
        return "error"
    words = _TOKEN.findall(s)
    if _is_nonsense(words) or (":" in s and _is_nonsense(_TOKEN.findall(s.split(":", 1)[1]))):
        return "filler"
    if words and _FILLER_CORE.search(s) and sum(w in vocabulary.filler for w in words) >= dense * len(words):
        return "filler"
    if _HEADING.fullmatch(s):
        return "around"
    plain = _TOKEN.findall(_CODE_TOKEN.sub(" ", s) if re.search(r"error|exception|warning|fatal|notice|status|access|\{\"", s) else s)
    strange = [w for w in plain if w not in vocabulary.message]
    if len(strange) > 4 and len(strange) > 2 * (1 - min(dense, around)) * len(plain) + 2:
        return "other"
    known = len(plain) - len(strange) + sum(map(vocabulary.has, strange))
    script, error = _SCRIPT_CORE.search(s), _ERROR_CORE.search(s)
    if known >= (dense if script or error else around) * len(plain):
        return "script" if script else "error" if error else "around"
    return "other"


def _sentences(text: str) -> Iterator[str]:
    """Sentences of a page without tags and menus."""
    text = html.unescape(text) if "&" in text else text
    for line in (_TAG.sub("\n", text) if "<" in text else text).split("\n"):
        line = line.strip()
        segments = re.split(r"\s+[|>»›·•]\s+", line)
        if line and not (len(segments) > 2 and all(len(x.split()) <= 3 for x in segments)):
            yield from re.split(r"(?<=[.!?…])\s+", line)


def whole_text_kind(text: str, vocabulary: Vocabulary = _LISTED, dense: float = DENSE, around: float = 1.0) -> str | None:
    """What the whole text is: ``error``, ``script``, ``filler``, or None for anything else."""
    found: dict[str, int] = {}
    for sentence in _sentences(text):
        kind = sentence_kind(sentence, vocabulary, dense, around)
        if kind == "other":
            return None
        if kind != "around":
            found[kind] = found.get(kind, 0) + 1
    return max(found, key=lambda k: (found[k], k)) if found else None


def residue_words(text: str, vocabulary: Vocabulary = _LISTED) -> set[str]:
    """Words of a text that is likely to be an error page, a notice or filler; none of other texts."""
    if not isinstance(text, str) or whole_text_kind(text, vocabulary, *LIKELY) is None:
        return set()
    return {w for s in _sentences(text.lower()) for w in _TOKEN.findall(s.replace("’", "'"))}


def residue_kind(text: str | None, vocabulary: Vocabulary = _LISTED) -> str | None:
    """``placeholder``, ``error``, ``script``, ``filler``, or None for text that stays."""
    if not isinstance(text, str) or not text.strip():
        return None
    return "placeholder" if unfilled(text) else whole_text_kind(text, vocabulary)


def _hopeless(text: str, vocabulary: Vocabulary) -> bool:
    """Whether a text begins with a sentence too far from messages for another round to count it."""
    for sentence in _sentences(text):
        return sentence_kind(sentence, vocabulary, LIKELY[1], LIKELY[1]) == "other"
    return True


def _count(vocabulary: Vocabulary, keep: bool):
    """Texts likely to be residue that have each word, and, under the empty word, all of them, by partition; with ``keep`` also the texts another round should read."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        have: Counter = Counter()

        def counted(texts: list[str]) -> pd.DataFrame:
            words, n = list(have), list(have.values())
            have.clear()
            return pd.DataFrame({"word": pd.Series(words + [None] * len(texts), dtype=object), "n": pd.Series(n + [0] * len(texts), dtype="int64"), "text": pd.Series([None] * len(words) + texts, dtype=object)})

        for pdf in frames:
            texts = []
            for text in pdf["text"]:
                if keep and _hopeless(text, vocabulary):
                    continue
                texts += [text] * keep
                if words := residue_words(text, vocabulary):
                    have.update(words | {""})
            yield counted(texts)

    return run


def learned_vocabulary(documents: DataFrame, text: str = "text", rounds: int = 2, least: int = 3, share: float = 1e-4, odds: float = 4.0, common: float = 0.01, enough: int = 100) -> Vocabulary:
    """The vocabulary as corrected by a corpus, in ``rounds`` that each start from the last.

    A word comes in if at least ``least`` residue texts, and the part ``share`` of them,
    have it, at odds of ``odds`` against all texts, or if the part ``common`` of them has
    it, whatever other texts do. A listed one goes out if other texts have it and none of
    at least ``enough`` residue texts. So at most (mean words of such a text) / ``share``
    words come to the driver and the executors, however large the corpus is.
    """
    whole = documents.select(F.col(f"`{text}`").cast("string").alias("text")).where("text is not null")
    low = F.lower("text")
    words = F.explode(F.array_distinct(F.regexp_extract_all(low, F.lit(r"\p{L}+(?:['’-]\p{L}+)*"), F.lit(0))))
    every = materialize(whole.select(words.alias("word")).groupBy("word").agg(F.count("*").alias("everywhere")), "words")
    total, vocabulary, read, spent = whole.count(), _LISTED, whole, [every]
    for k in range(rounds):
        counted = materialize(read.mapInPandas(_count(vocabulary, not k), "word string, n bigint, text string"), "counted")
        if not k:
            read = counted.where("text is not null").select("text")
        spent.append(counted)
        found = materialize(counted.where("word is not null").groupBy("word").agg(F.sum("n").alias("n")), "residue-words")
        n = (found.where("word = ''").first() or {"n": 0})["n"]
        rate = ((F.col("n") + 0.5) / (n + 1)) / ((F.greatest(F.col("everywhere") - F.col("n"), F.lit(0)) + 0.5) / (total - n + 1))
        enters = (F.col("n") >= max(least, share * n)) & (rate >= odds) | (F.col("n") >= max(least, common * n))
        added = {r.word for r in found.where("word <> ''").join(every, "word").where(enters).select("word").collect()}
        removed: set[str] = set()
        if n >= enough:
            listed = every.where(F.col("word").isin(sorted(_MESSAGE_WORDS | FILLER_WORDS)) & (F.col("everywhere") >= max(least, share * total)))
            removed = {r.word for r in listed.join(found, "word", "left_anti").select("word").collect()}
        vocabulary = Vocabulary(frozenset(added), frozenset(removed))
        discard(found)
    discard(*spent)
    return vocabulary


def _judge(text: str, vocabulary):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = vocabulary.value
        for pdf in frames:
            yield pdf.assign(residue=pd.Series([residue_kind(t, words) for t in pdf[text]], index=pdf.index, dtype=object))

    return run


def mark_residue(documents: DataFrame, text: str = "text") -> DataFrame:
    """``documents`` with ``residue``: ``placeholder``, ``error``, ``script``, ``filler`` or null.

    Whole texts are read, however long: the corpus first gives its vocabulary
    (:func:`learned_vocabulary`), then every text is judged. Null, empty and blank texts are no residue.
    Rows, repeated ones included, and other columns are kept; a column ``residue`` is
    replaced. In a corpus too small to learn from the listed words hold.
    """
    kept = documents.drop("residue")
    words = documents.sparkSession.sparkContext.broadcast(learned_vocabulary(documents, text))
    return kept.mapInPandas(_judge(text, words), StructType([*kept.schema.fields, StructField("residue", StringType())]))


def without_residue(documents: DataFrame, text: str = "text") -> DataFrame:
    """``documents`` without those that are residue."""
    return mark_residue(documents, text).where(F.col("residue").isNull()).drop("residue")
