"""Text functions: stemming, windowed word pairs, keyword in context, pronouns, references, JSON columns."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.model import BODY_STOPWORDS, SEARCH_STOPWORDS

# Suffixes in the order in which they are tried.
SUFFIXES = ("ingly", "edly", "ing", "ies", "ied", "es", "ed", "s")
PAIR_WINDOW = 4
CLAUSE_END = r"[.!?;:,()\[\]{}\n\"]+"
PAIR_WORD = r"[A-Za-z_][A-Za-z0-9_]{2,}"


def stem(word: Column) -> Column:
    """Without the first suffix that leaves more than three characters; -ies and -ied give -y; a final s after s, u or i stays."""
    out, found = word, None
    for suffix in SUFFIXES:
        fits = (F.length(word) > len(suffix) + 3) & word.endswith(suffix)
        if suffix == "s":
            fits = fits & ~word.rlike("[sui]s$")
        base = F.substring(word, F.lit(1), F.length(word) - len(suffix))
        value = F.concat(base, F.lit("y")) if suffix in ("ies", "ied") else base
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return found.otherwise(out)


def word_pairs(df: DataFrame, record: str, text: str, window: int = PAIR_WINDOW, stop: list[str] = BODY_STOPWORDS) -> DataFrame:
    """(record, pair, n): stemmed words that stand fewer than ``window`` content words apart, as sorted ``a_b``.

    Clause ends, stop words and numbers end a run; a word isn't paired with itself. The runs stay arrays within the row, so nothing is shuffled
    before the count.
    """
    clauses = F.split(F.col(text), CLAUSE_END)
    rows = df.select(F.col(record), F.explode(clauses).alias("clause"))
    marked = rows.select(record, F.transform(F.regexp_extract_all("clause", F.lit(PAIR_WORD), F.lit(0)), F.lower).alias("w"))
    stops = F.array(*[F.lit(s) for s in stop])
    # A stop word becomes a break; the joined text is cut there, and each piece is a run.
    runs = marked.select(
        record,
        F.explode(
            F.split(F.array_join(F.transform("w", lambda x: F.when(F.array_contains(stops, x), F.lit("|")).otherwise(x)), " "), r"\|")
        ).alias("run")
    )
    words = runs.select(record, F.filter(F.split(F.trim("run"), r"\s+"), lambda x: x != "").alias("r")).filter(F.size("r") > 1)
    words = words.select(record, F.transform("r", stem).alias("r"))
    pairs = F.flatten(
        F.transform(
            F.col("r"),
            lambda a,
            i: F.transform(
                F.slice(F.col("r"), i + 2, F.lit(window - 1)), lambda b: F.when(a != b, F.concat(F.least(a, b), F.lit("_"), F.greatest(a, b)))
            ),
        )
    )
    return words.select(record, F.explode(F.array_compact(pairs)).alias("pair")).groupBy(record, "pair").agg(F.count(F.lit(1)).alias("n"))


def pair_index(pairs: DataFrame, record: str, least: int = 2, most_share: float = 0.05) -> DataFrame:
    """(pair, df): pairs of at least ``least`` and at most a share of the records."""
    n = pairs.select(record).distinct().count()
    return pairs.groupBy("pair").agg(F.count(F.lit(1)).alias("df")).filter((F.col("df") >= least) & (F.col("df") <= max(least, int(most_share * n))))


# --- keyword in context ---------------------------------------------------------------------------


def query_words(query: str | None) -> list[str]:
    """Distinct words of two characters or more, longest first."""
    return sorted(dict.fromkeys(w for w in re.findall(r"[a-z0-9_]+", (query or "").lower()) if len(w) >= 2), key=len, reverse=True)


def _first(low: str, words: list[str]) -> tuple[int, int] | None:
    hits = [(i, k, i + len(w)) for k, w in enumerate(words) if (i := low.find(w)) >= 0]
    return (min(hits)[0], min(hits)[2]) if hits else None


def _cut(line: str, hit: tuple[int, int], a: int, b: int) -> str:
    """line[a:b] with the hit marked and an ellipsis on each side that is cut."""
    return ("…" if a > 0 else "") + line[a : hit[0]] + "«" + line[hit[0] : hit[1]] + "»" + line[hit[1] : b] + ("…" if b < len(line) else "")


def kwic(text: str | None, words: list[str], width: int = 100) -> str:
    """About ``width`` characters around the first hit, cut between words; empty without a hit. White space is collapsed."""
    flat = " ".join((text or "").split())
    hit = _first(flat.lower(), words)
    if hit is None:
        return ""
    side = max(0, (width - (hit[1] - hit[0])) // 2)
    a, b = max(0, hit[0] - side), min(len(flat), hit[1] + side)
    if a > 0 and (space := flat.find(" ", a, hit[1])) >= 0:
        a = space + 1
    if b < len(flat) and (space := flat.rfind(" ", hit[1], b)) > hit[1]:
        b = space
    return _cut(flat, hit, a, b)


def _line_shown(lines: list[str], at: int, hit: tuple[int, int] | None, around: int, most: int) -> str:
    line = lines[at]
    if hit:
        half = most // 2
        line = _cut(line, hit, 0, len(line)) if len(line) <= most else _cut(line, hit, max(0, hit[0] - half), min(len(line), hit[1] + half))
    if around <= 0:
        return line.strip()
    shown = [*lines[max(0, at - around) : at], line, *lines[at + 1 : at + 1 + around]]
    kept = [i for i, x in enumerate(shown) if x.strip()]
    return "\n".join(shown[kept[0] : kept[-1] + 1]) if kept else ""


def kwic_line(text: str | None, words: list[str], most: int = 240, around: int = 0) -> tuple[str, int] | None:
    """The first line with a hit, marked, and its number from 0, with ``around`` lines before and after; a long line is cut around the hit."""
    lines = [line.rstrip() for line in (text or "").splitlines()]
    for i, line in enumerate(lines):
        if hit := _first(line.lower(), words):
            return _line_shown(lines, i, hit, around, most), i
    return None


# Words that introduce the name that they define.
DEFINES = "def class function func fn interface type struct impl trait module sub method val var let const enum object".split()


def definition_line(text: str | None, words: list[str], symbol: str | None, most: int = 240, around: int = 0) -> tuple[str, int] | None:
    """The line that defines a symbol, after a defining word or else where it is bound, called or typed; marked at a query word or else at the
    symbol."""
    if not text or not symbol:
        return None
    lines, name = [line.rstrip() for line in text.splitlines()], re.escape(symbol)
    for pattern in (rf"(?:^|\W)(?:{'|'.join(DEFINES)})\s+{name}\b", rf"\b{name}\s*[=:(]"):
        for i, line in enumerate(lines):
            if re.search(pattern, line):
                own = re.search(rf"\b{name}\b", line)
                return _line_shown(lines, i, _first(line.lower(), words) or (own and own.span()), around, most), i
    return None


def with_kwic(df: DataFrame, record: str, text: str, query: str, width: int = 100) -> DataFrame:
    """(record, snippet, line, line_no) of the rows that hold a word of the query. Rows without one never reach Python."""
    words = query_words(query)
    held = F.lit(False)
    for w in words:
        held = held | F.lower(F.col(text)).contains(w)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            lines = [kwic_line(t, words) for t in frame["_t"]]
            out = {
                record: frame[record], "snippet": [kwic(t, words, width) for t in frame["_t"]], "line": [x and x[0] for x in lines],
                "line_no": [x[1] if x else None for x in lines]
            }
            yield pd.DataFrame(out).astype({"line_no": "Int64"})

    rows = df.filter(held).select(record, F.col(text).alias("_t"))
    return rows.mapInPandas(run, f"{record} {dict(df.dtypes)[record]}, snippet string, line string, line_no long")


# --- pronouns -----------------------------------------------------------------------------------------

# Pronouns of persons and of things, and words that can't be what they refer to.
PERSON = set("he him his she her hers they them their theirs".split())
THING = set("it its".split())
NO_NAME = set("the a an i but and or so if when while this that these those it he they she we you my your his her its our their".split())
OPENERS = set(
    "yesterday today tomorrow now then however meanwhile also finally next first second third later soon once again still after before during everything nothing something anything someone anyone everyone nobody "
    "here there maybe perhaps instead thus hence overall do does did don't doesn't didn't let let's please yes no okay ok well what why how where who which".split()
)
VERBLIKE = set(
    "would could should shall will can may might must has have had having was were been being are is am get got gets getting go goes going went make makes making made take takes taking took come comes coming came "
    "say says saying said know knows knew think thinks thought want wants wanted like likes liked need needs needed feel feels felt see sees saw look looks looked really very just quite about because though although "
    "pairing doing being trying going".split()
)
_NEVER = NO_NAME | VERBLIKE | set(SEARCH_STOPWORDS)
#: A text in tiles: words, and what lies between them.
_TILE = re.compile(r"[A-Za-z][A-Za-z0-9_'-]*|[^A-Za-z]+")
_BREAK = re.compile(r"[.!?]\s+|\n{2,}")
_BREAK_AT_END = re.compile(r"(?:[.!?]\s+|\n{2,})\Z")


@dataclass(slots=True)
class Pronoun:
    offset: int
    word: str
    sentence: int
    antecedent: str | None = None
    confidence: float = 0.0


class _Trail:
    """The latest candidate of a class, and where the latest candidate of another name was: all that a pronoun can ask for."""

    __slots__ = ("name", "seen", "rival")

    def __init__(self) -> None:
        self.name, self.seen, self.rival = "", -1_000_000, -1_000_000

    def pass_by(self, name: str, sentence: int) -> None:
        if self.name and name.lower() != self.name.lower():
            self.rival = self.seen
        self.name, self.seen = name, sentence


def pronouns(text: str, window: int = 3) -> list[Pronoun]:
    """Every pronoun of a text with its antecedent, the latest candidate of its class within ``window`` sentences, or None without one.

    Candidates for persons are capitalised words that aren't furniture of the sentence (openers count after the first place only); for things,
    lower-case words
    found in two sentences or more. The confidence is 1 / (1 + sentences between), halved where candidates of different names are within the window.
    """
    tiles, sentence, offset = [], 0, 0
    sentences_of: dict[str, set[int]] = {}
    first = True  # whether a word here opens its sentence
    for tile in _TILE.findall(text):
        if tile[0].isascii() and tile[0].isalpha():
            tiles.append((tile, sentence, offset, first))
            sentences_of.setdefault(tile.lower(), set()).add(sentence)
            first = False
        else:
            sentence += len(_BREAK.findall(tile))
            first = bool(_BREAK_AT_END.search(tile))
        offset += len(tile)
    trails = {True: _Trail(), False: _Trail()}
    out = []
    for word, sentence, offset, opens in tiles:
        low = word.lower()
        if low in PERSON or low in THING:
            found, trail = Pronoun(offset, word, sentence), trails[low in PERSON]
            if sentence - trail.seen <= window:
                found.antecedent = trail.name
                found.confidence = round(1.0 / (1 + sentence - trail.seen) / (2 if sentence - trail.rival <= window else 1), 3)
            out.append(found)
        elif "'" in word or low in _NEVER:
            continue
        elif word[0].isupper():
            if len(word) >= 2 and not (opens and low in OPENERS):
                trails[True].pass_by(word, sentence)
        elif len(word) >= 3 and word.islower() and len(sentences_of[low]) >= 2:
            trails[False].pass_by(word, sentence)
    return out


def resolved(text: str, found: list[Pronoun]) -> str:
    """The text with antecedents in place of the pronouns that have one and still stand where they were found."""
    out, at = [], 0
    for p in found:
        end = p.offset + len(p.word)
        if p.antecedent and p.offset >= at and text[p.offset : end].lower() == p.word.lower():
            out += [text[at : p.offset], p.antecedent]
            at = end
    return "".join([*out, text[at:]])


def unresolved_opening(found: list[Pronoun], sentences: int = 3) -> list[tuple[int, str]]:
    """(offset, pronoun) in the first sentences that nothing before them explains: what a text before this one may."""
    return [(p.offset, p.word) for p in found if p.antecedent is None and p.sentence < sentences]


def dominant_person(text: str, found: list[Pronoun]) -> str | None:
    """The person that a pronoun pointing into this text means most likely: the most usual antecedent, else the most usual name; None if none
    comes twice."""
    people = Counter(p.antecedent for p in found if p.antecedent and p.antecedent[0].isupper())
    names = Counter(
        w for w in re.findall(r"[A-Za-z][A-Za-z0-9_'-]*", text) if w[0].isupper() and len(w) >= 2 and w.lower() not in NO_NAME | VERBLIKE | OPENERS
    )
    for counted in (people, names):
        if counted and counted.most_common(1)[0][1] >= 2:
            return counted.most_common(1)[0][0]
    return None


def with_pronouns(df: DataFrame, record: str, text: str) -> DataFrame:
    """(record, pos, pronoun, antecedent, confidence) of every pronoun that is resolved."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [
                (r, p.offset, p.word, p.antecedent, p.confidence) for r, t in zip(frame[record], frame["_t"]) for p in pronouns(t) if p.antecedent
            ]
            yield pd.DataFrame({c: [x[i] for x in rows] for i, c in enumerate([record, "pos", "pronoun", "antecedent", "confidence"])})

    words = "|".join(sorted(PERSON | THING))
    rows = df.filter(F.col(text).rlike(rf"(?i)\b({words})\b")).select(record, F.col(text).alias("_t"))
    return rows.mapInPandas(run, f"{record} {dict(df.dtypes)[record]}, pos long, pronoun string, antecedent string, confidence double")


def antecedent_counts(found: DataFrame, record: str) -> DataFrame:
    """(record, concept, weight): how often each antecedent, in lower case, is meant by a pronoun: links of a verb of their own."""
    return found.groupBy(record, F.lower("antecedent").alias("concept")).agg(F.count(F.lit(1)).cast("double").alias("weight"))


# --- references ------------------------------------------------------------------------------------------

REFERENCE = r"[\w.-]+(?:/[\w.-]+)+|[A-Za-z_]\w*(?:\.\w+)+|[a-z]+_[a-z_0-9]+|[A-Z][a-z]+[A-Z]\w*"


def references(text: Column, most: int = 12) -> Column:
    """Paths and identifiers of a text, each once, the first ``most``."""
    return F.slice(F.array_distinct(F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(0))), 1, most)


def json_or_text(col: Column) -> Column:
    """JSON as a variant; other text as a JSON string."""
    return F.coalesce(F.try_parse_json(col), F.parse_json(F.to_json(F.array(col)))) if col is not None else col


def unknown_tags(tags: Column, allowed: list[str]) -> Column:
    """Tags that a taxonomy doesn't list."""
    return F.array_sort(F.array_except(tags, F.array(*[F.lit(x) for x in allowed])))


def index_line(name: Column, mtype: Column, tldr: Column, most: int = 160) -> Column:
    """One line of a memory index: ``- name (type): summary``, cut."""
    return F.substring(
        F.concat(
            F.lit("- "), name, F.coalesce(F.concat(F.lit(" ("), mtype, F.lit(")")), F.lit("")), F.coalesce(F.concat(F.lit(": "), tldr), F.lit(""))
        ),
        1, most
    )


def udfs(spark) -> None:
    """Register the functions that have no expression form for use in SQL, as functions over Arrow batches."""

    @F.pandas_udf("string")
    def kwic_udf(texts: pd.Series, queries: pd.Series) -> pd.Series:
        return pd.Series([kwic(t, query_words(q)) for t, q in zip(texts, queries)])

    @F.pandas_udf("string")
    def resolve_udf(texts: pd.Series) -> pd.Series:
        return pd.Series([resolved(t, pronouns(t)) if t else t for t in texts])

    spark.udf.register("kwic", kwic_udf)
    spark.udf.register("resolve_pronouns", resolve_udf)
