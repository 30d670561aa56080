"""Template residue, filler and error pages in place of content.

One pass of a multi-pattern automaton over each folded text (lower case, single spaces, no accents) finds the phrases of
``residue_phrases`` in seven languages and everything that may open a placeholder. What it finds is then weighed
against the text around it:

* an error page or notice: its phrases, with what comes beside them, cover most of the document;
* filler: filler phrases, words of the usual dummy Latin or keyboard runs cover most of the lines that they stand on;
* a placeholder: more of them stand in the text than are spoken about. One is spoken about where it is the object or the
  subject of the sentence as a string: right after words such as "prints", "the variable", "such as", right before
  "placeholder" or "is replaced", first on a line that explains it, or in quotes.

Fenced, inline and indented code and quotations are taken out first, so a document that shows, quotes or explains such strings
isn't a case. No length of a text, line, quotation or placeholder changes what is done.

Scale: one row in, at most one row out; no shuffle. Memory is that of one text and the automaton.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.llm import residue_phrases as known

#: Share of a document that page phrases and what comes beside them cover, and of its lines that filler covers, to be a case.
PAGE_COVERAGE = 0.6
FILLER_COVERAGE = 0.6

#: What a template asks for. Brackets that also serve links, markup, emphasis or formulas count only around one of these.
_ASKED = (
    "author|title|date|day|month|year|time|name|firstname|lastname|surname|fullname|username|version|status|state|owner|team|project|product|component|module|service|region|country|city|address|ticket|issue|milestone|"
    "release|scope|purpose|goal|contact|email|e-mail|phone|reviewer|approver|manager|summary|description|subject|topic|client|customer|recipient|company|organi[sz]ation|department|role|amount|price|number|link|url|text|content|"
    "placeholder|value|autor|titel|datum|projekt|kunde|firma|nachname|vorname|ort|auteur|titre|projet|client|entreprise|nom|prenom|ville|titulo|fecha|proyecto|cliente|empresa|nombre|apellido|ciudad|nome|sobrenome|data|cidade|"
    "projeto|naam|voornaam|achternaam|bedrijf|klant|cognome|azienda|progetto"
)
SLOT = rf"(?:[a-z]+[ _-])?(?:{_ASKED})(?:[ _-]?(?:id|name|text|date|address|number|no|nr|here|\d+))?"
_IMPERATIVE = "your|enter|insert|add|type|write|choose|select|specify|describe|fill in|ihr|ihre|ihren|bitte|votre|inserer|saisir|su|tu|inserte|escriba|seu|sua|insira|uw|vul|inserisci|inserire"
_OPEN_ENDED = r"todo|tbd|tbc|tba|fixme|to be (?:determined|defined|announced|filled in|completed|confirmed|decided)"
#: Shapes by what opens them, matched at that place on the folded text. Those in LIKELY serve other aims too.
SURE = {
    "{{": r"\{\{\{?[#/^>&]?\s*[a-z_][^{}\n]*?\}?\}\}",
    "{%": r"\{%-?\s*[a-z_][^%\n]*%\}",
    "<%": r"<%[=-]?\s*[a-z_@][^%\n]*%>",
    "${": r"\$\{\s*[a-z_][\w .-]*\}",
    "#{": r"#\{\s*[a-z_@][\w .-]*\}",
    "%%": r"%%[a-z][\w .-]*?%%",
    "%(": r"%\([a-z][\w .-]*\)[sdf]",
    "@@": r"@@[a-z][\w .-]*?@@",
    "[": rf"\[(?:(?:{_OPEN_ENDED})\b[^\]\n]*|(?:{_IMPERATIVE})\s[^\]\n]+|[^\[\]\n]+ (?:to be filled in|goes here|here))\](?!\()",
    "<": rf"<(?:(?:{_IMPERATIVE})\s[^<>\n]+|[^<>\n]+ (?:goes here|here))>",
    "_": r"(?<!_)_{3,} ?\([a-z][^)\n]*\)|(?<![_\w] )(?<!\w)_{4,}[ .]*(?=\n|\Z)",
    "[object": r"\[object object\]",
    "error! ": r"error! (?:reference source not found|bookmark not defined)",
    "xx.xx": r"\bxx\.xx\.(?:20)?(?:xx|\d\d)",
    " ??": r"(?<=section|chapter|.figure|..table|...page) \?\?",
    "tbd": r"(?<=: )tbd(?=\s*(?:\n|\Z))",
}
LIKELY = {
    "[[": rf"\[\[\s*{SLOT}\s*\]\]",
    "<<": rf"<<\s*{SLOT}\s*>>",
    "«": rf"«\s*{SLOT}\s*»",
    "<": rf"<\s*{SLOT}\s*>",
    "{": rf"(?<![\w$#{{/=]){{\s*{SLOT}\s*\}}(?![/=])",
    "[": rf"(?<![\w\]/]){re.escape('[')}\s*{SLOT}\s*\](?!\(|:)",
    "_": rf"(?<!\w)__{SLOT}__(?!\w)",
    "$": rf"(?<!\w)\${SLOT}\$(?!\w)",
    "%": rf"(?<![\w%])%{SLOT}%(?![\w%])",
    "@": rf"(?<![\w@])@{SLOT}@(?![\w@])",
}
#: What a renderer leaves where it found no value: after a greeting, or alone after a label.
NO_VALUE = re.compile(
    r"^\W*(?:dear|hello|hi|hey|welcome|liebe[r]?|hallo|cher|chere|bonjour|estimad[oa]|hola|ola|beste|gentile|ciao) (?:null|undefined|none|nan)\b|^\W*[\w' -]+: (?:undefined|null|nan)\W*$",
    re.MULTILINE
)
_MARKS = "undefined", " null", ": nan", " none", " nan"
#: Words right before a string that is spoken about (verbs that take it as their object, nouns that it explains, and what compares).
_SAYS = (
    "print|printed|prints|printing|show|shows|showed|shown|showing|display|displays|displayed|render|renders|rendered|write|writes|wrote|written|writing|use|uses|used|using|put|puts|see|sees|saw|contain|contains|contained|"
    "containing|read|reads|say|says|said|output|outputs|emit|emits|emitted|expand|expands|expanded|replace|replaces|replaced|replacing|substitute|substitutes|substituted|parse|parses|parsed|match|matches|matched|reject|rejects|"
    "rejected|accept|accepts|accepted|escape|escapes|escaped|export|exports|exported|set|sets|type|typed|nest|define|defines|defined|leave|leaves|left|keep|keeps|kept|remove|removes|removed|find|finds|found|return|returns|"
    "returned|call|calls|called|pass|passes|support|supports|supported|mean|means|instead of|in place of|such as|like|named|namely|e\\.g\\.|i\\.e\\.|"
    "druckt|druckte|zeigt|zeigte|schreibt|schrieb|enthalt|enthielt|ersetzt|ersetzte|verwendet|statt|wie|namens|imprime|imprimait|affiche|affichait|ecrit|contient|contenait|remplace|remplacait|utilise|comme|nomme|"
    "imprimia|muestra|mostraba|escribe|contiene|reemplaza|sustituye|usa|como|mostra|mostrava|escreve|contem|substitui|toont|toonde|schrijft|bevat|vervangt|gebruikt|zoals|stampa|stampava|scrive|sostituisce|come"
)
_NOUNS = (
    "placeholders?|templates?|tags?|tokens?|variables?|macros?|markers?|syntax|expressions?|strings?|literals?|examples?|snippets?|patterns?|parameters?|keys?|blocks?|escapes?|interpolations?|"
    "platzhaltern?|vorlagen?|variablen?|marken?|ausdruck|balises?|champs?|gabarits?|motifs?|exemples?|marcador(?:es)?|plantillas?|etiquetas?|ejemplos?|campos?|exemplos?|variaveis|variavel|sjablonen|sjabloon|variabelen?|"
    "voorbeeld|segnaposto|marcatori|marcatore|variabil[ei]|esempio"
)
_ARTICLE = "the|a|an|any|each|every|only|just|literal|raw|plain|unfilled|empty|der|die|das|den|dem|le|la|les|un|une|el|los|las|una|o|os|as|um|uma|de|het|een|il|lo|i|gli"
SPOKEN_BEFORE = re.compile(rf"(?:^|[^\w])(?:(?:{_SAYS})|(?:{_NOUNS})(?: (?:is|are|was|ist|est|es|e))?)[,:]?(?: (?:{_ARTICLE}))*[\s:(\"'“„«]*$")
SPOKEN_AFTER = re.compile(
    rf"^[\"'”“»)]*\s*(?:(?:{_NOUNS})\b|(?:stands? for|means?|expands?|denotes?|refers? to|evaluates?|prints?|becomes?|yields?|holds?|steht fur|bedeutet|signifie|significa|betekent)\b|"
    r"(?:is|are|was|were|gets?|will be|must be|has been|wird|werden|wurde|est|sont|sera|se|e|sera|wordt|werd|viene|es)\s+(?:not |never |then |always |beim \w+ |par |por )*"
    r"(?:replaced|substituted|expanded|filled|rendered|resolved|escaped|interpolated|printed|parsed|shown|ersetzt|ausgefullt|remplacee?|sustituye|sustituid[oa]|reemplaza\w*|substituid[oa]|vervangen|ingevuld|sostituit[oa]|wird|"
    r"beim|durch)\b)"
)
#: Neighbours of a placeholder in a list of several, each blotted out as one character.
_ONE_OF_SEVERAL = re.compile(r"(?:\x00(?: ?,)? ?(?:(?:and|or|und|oder|et|ou|y|e|o|en|of) )?)+$")
_MORE_OF_THEM = re.compile(r"(?:(?: ?,)? ?(?:(?:and|or|und|oder|et|ou|y|e|o|en|of) )?\x00)+")
_EXPLAINED = re.compile(r"^\s*(?::|=|->|→|-|–|—)\s+\w+\W+\w+")
_BULLET = re.compile(r"^[\s\W\d]*$")

FENCE = re.compile(r"^[ \t]*(```|~~~).*?(?:^[ \t]*\1[^\n]*$|\Z)", re.MULTILINE | re.DOTALL)
INLINE_CODE = re.compile(r"``[^\n]+?``|`[^`\n]+`")
CODE_LINE = re.compile(
    r"^\s*(?:\$ |>>> |#!|export \w+=|for \w+ in .*\bdo\b|(?:for|while|if|switch) ?\(|printf?\(|echo |curl |docker |git |import [\w.]+$|from [\w.]+ import |(?:const|let|var) \w+ ?=|return .*;$|[\w.]+\(.*\);?$)"
)
QUOTED = re.compile(r'"[^"\n]*"|“[^”\n]*”|„[^“”\n]*[“”]')
GUILLEMETS = re.compile(r"«[^«»\n]*»")
MARKUP = re.compile(r"</?(?:h[1-6]|p|div|span|b|i|em|strong|br|hr|center|noscript|html|head|body|ul|li|a)\b[^<>\n]*>", re.IGNORECASE)
NUMBER_LINE = re.compile(
    r"^(?:(?:request|reference|error|incident|trace|ray|vorgang|requete|solicitud|code)\s?(?:id|no|nr)?[:. ]*)?(?:0x)?[0-9a-f./-]+$|^[\w-]+(?: [\w-]+)? viewer$"
)
WITHIN = re.compile(r"[^\W_](?:.*[^\W_])?")


def mended(text: str) -> str:
    """Undo UTF-8 that was read as Windows text, where that is possible."""
    if "Ã" in text or "â€" in text:
        out = []
        for line in text.split("\n"):
            if "Ã" in line or "â€" in line:
                for wrong in ("cp1252", "latin-1"):
                    try:
                        line = line.encode(wrong).decode("utf-8")
                        break
                    except UnicodeError:
                        continue
            out.append(line)
        return "\n".join(out)
    return text


def folded(text: str) -> str:
    """Lower case without accents, with straight apostrophes; keeps line ends."""
    text = text.lower()
    if text.isascii():
        return text
    return "".join(c for c in unicodedata.normalize("NFKD", text.replace("’", "'").replace("…", "...")) if not unicodedata.combining(c))


@lru_cache(maxsize=1)
def automaton():
    import ahocorasick

    patterns: dict[str, str] = {}
    page = known.phrases(known.SCRIPT_NOTICES) | known.phrases(known.ERROR_PAGES) | known.statuses()
    latin = {w for w in known.DUMMY_LATIN if len(w) >= 5}
    for kind, words in (
        ("page", page), ("filler", known.phrases(known.FILLER)), ("beside", known.phrases(known.BESIDE)), ("latin", latin),
        ("mash", [*known.MASH, *known.REPEATED])
    ):
        for w in words:
            patterns.setdefault(w, kind)
    a = ahocorasick.Automaton()
    openers = [*SURE, *LIKELY, *_MARKS]
    for p, kind in patterns.items():
        a.add_word(p, ((kind,), len(p)))
    for p in openers:
        own = (patterns[p], "slot") if p in patterns else ("slot",)
        a.add_word(p, (own, len(p)))
    a.make_automaton()
    return a


@lru_cache(maxsize=1)
def shapes() -> dict[str, list[re.Pattern]]:
    return {p: [re.compile(s[p]) for s in (SURE, LIKELY) if p in s] for p in {*SURE, *LIKELY}}


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _letters(text: str) -> int:
    return sum(map(str.isalnum, text))


def placeholders(text: str, at: list[tuple[int, str]]) -> tuple[int, int]:
    """(standing, spoken about) of the placeholders that open at ``at`` (place, opener) in a folded text with its line ends."""
    spans = []
    for start, opener in at:
        for shape in shapes().get(opener, ()):
            if m := shape.match(text, start):
                inner = m[0].strip("<> ")
                if not (m[0].startswith("<") and f"</{inner}>" in text):  # markup comes in pairs
                    spans.append(m.span())
    spans += [m.span() for m in NO_VALUE.finditer(text)] if any(o in _MARKS for _, o in at) else []
    spans = _merged(spans)
    if not spans:
        return 0, 0
    bare, place = [], 0
    for i, j in spans:
        bare += [text[place:i], "\x00"]
        place = j
    pieces = "".join([*bare, text[place:]]).split("\n")
    spoken = 0
    for line in pieces:
        here = line.find("\x00")
        while here >= 0:
            before, after = line[:here], line[here + 1 :]
            quoted = before[-1:] in ("'", '"', "`", "‘", "“") and after[:1] in ("'", '"', "`", "’", "”")
            explained = _BULLET.match(before) and _EXPLAINED.match(after)
            more = _MORE_OF_THEM.match(after)
            spoken += bool(
                quoted or explained or SPOKEN_BEFORE.search(_ONE_OF_SEVERAL.sub("", before))
                or SPOKEN_AFTER.match(after[more.end() :] if more else after)
            )
            here = line.find("\x00", here + 1)
    return len(spans) - spoken, spoken


def _filler(plain: list[str], joined: str, starts: list[int], kinds: dict[str, list[tuple[int, int]]]) -> bool:
    line_of = lambda x: bisect_right(starts, x) - 1
    by_line: dict[tuple[int, int], int] = {}
    for start, end in _merged(kinds.get("filler", [])):
        lines = (line_of(start), line_of(end - 1))
        by_line[lines] = by_line.get(lines, 0) + _letters(joined[start:end])
    if any(n >= FILLER_COVERAGE * _letters(" ".join(plain[a : b + 1])) for (a, b), n in by_line.items()):
        return True
    for i in {line_of(start) for start, _ in kinds.get("latin", [])}:
        words = re.findall(r"[^\W\d_]+", plain[i])
        if len(words) >= 4 and sum(w in known.DUMMY_LATIN for w in words) >= FILLER_COVERAGE * len(words):
            return True
    for i in {line_of(start) for start, _ in kinds.get("mash", [])}:
        words = re.findall(r"\w+", plain[i])
        idle = [w for w in words if w in known.MASH or w in known.REPEATED]
        if len(words) >= 3 and len(idle) == len(words) and len(set(words)) < len(words):
            return True
    return False


def residue_kind(text: str | None) -> str | None:
    """``placeholder``, ``filler`` or ``page`` for a case, else None. Null, empty and blank texts are no case."""
    if not text or not text.strip():
        return None
    text = mended(text.lstrip("﻿").replace("\r\n", "\n").replace("\r", "\n"))
    if "```" in text or "~~~" in text:
        text = FENCE.sub(" ", text)
    if "`" in text:
        text = INLINE_CODE.sub(" ", text)
    if "&" in text:
        text = unescape(text)
    if '"' in text or "“" in text:
        text = QUOTED.sub(" ", text)
    if "«" in text:  # a name in guillemets may be a placeholder, several words are a quotation
        text = GUILLEMETS.sub(lambda m: m[0] if len(m[0].split()) <= 4 else " ", text)
    lines = [" ".join(line.split()) for line in text.split("\n") if not CODE_LINE.match(line)]
    plain = [" ".join(MARKUP.sub(" ", folded(line)).split()) if "<" in line else folded(line) for line in lines if line]
    plain = [line for line in plain if line]
    joined = " ".join(plain)
    kinds: dict[str, list[tuple[int, int]]] = {}
    at: list[tuple[int, str]] = []
    for end, (found, size) in automaton().iter(joined):
        start = end + 1 - size
        for kind in found:
            if kind == "slot":
                at.append((start, joined[start : end + 1]))
            elif not (start and joined[start - 1].isalnum()) and not (end + 1 < len(joined) and joined[end + 1].isalnum()):
                kinds.setdefault(kind, []).append((start, end + 1))
    if at:
        standing, spoken = placeholders("\n".join(plain), at)
        if standing and standing >= spoken:
            return "placeholder"
    if not kinds.keys() - {"beside"}:
        return None
    starts, place = [], 0
    for line in plain:
        starts.append(place)
        place += len(line) + 1
    if _filler(plain, joined, starts, kinds):
        return "filler"
    if "page" in kinds:
        covered = _merged(kinds["page"] + kinds.get("beside", []))
        n, whole = sum(_letters(joined[a:b]) for a, b in covered), _letters(joined)
        line_of = lambda x: bisect_right(starts, x) - 1
        hit = {i for a, b in covered for i in range(line_of(a), line_of(b - 1) + 1)}
        for i, line in enumerate(plain):
            inside = WITHIN.search(line)
            bare = inside[0] if inside else ""
            if i not in hit and (bare in known.NAVIGATION or NUMBER_LINE.match(bare)):
                whole -= _letters(line)
        if whole > 0 and n >= PAGE_COVERAGE * whole:
            return "page"
    return None


def find_residue(df: DataFrame, record: str, text: str) -> DataFrame:
    """(record, kind) of the rows whose text is a case. Rows that repeat come out as often; other columns are ignored."""
    rows = df.select(F.col(f"`{record}`").alias(record), F.col(f"`{text}`").alias("_text")).filter(F.col("_text").isNotNull())
    schema = T.StructType([rows.schema[record], T.StructField("kind", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = [residue_kind(t) for t in batch.column(1).to_pylist()]
            keep = [i for i, k in enumerate(kinds) if k]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(keep, pa.int64())), pa.array([kinds[i] for i in keep], pa.string())], names=[record, "kind"]
            )

    return rows.mapInArrow(run, schema)
