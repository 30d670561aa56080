"""Identifier names: parts, canonical form, surface variants, shape and extraction."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from threadloom.model import SEARCH_STOPWORDS

#: Fixed value: runs of acronym, word, capitals or digits.
PART = r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|[0-9]+"
#: Fixed value: identifier candidates in free text.
CANDIDATE = r"[A-Za-z_][\w\-./]*(?:::[A-Za-z_][\w\-./]*)*"


def parts(name: Column) -> Column:
    """Lower-case parts of an identifier, split at white space, ``_``, ``-``, case changes and digits."""
    return F.transform(F.regexp_extract_all(name, F.lit(PART), F.lit(0)), F.lower)


def canonicalize(name: Column) -> Column:
    """Parts joined by ``_``; a name without parts is only trimmed and lower-cased."""
    found = parts(name)
    return F.when(F.size(found) > 0, F.array_join(found, "_")).otherwise(F.lower(F.trim(name)))


def canonicalize_text(name: str) -> str:
    """The same for a query term on the driver."""
    found = [p.lower() for p in re.findall(PART, name)]
    return "_".join(found) if found else name.strip().lower()


def variants(name: Column) -> Column:
    """Distinct surface forms: as it is, then joined by ``_``, ``-`` and space; for a single part, its lower case."""
    trimmed, found = F.trim(name), parts(name)
    many = F.array(trimmed, F.array_join(found, "_"), F.array_join(found, "-"), F.array_join(found, " "))
    few = F.when(F.size(found) == 1, F.array(trimmed, F.get(found, F.lit(0)))).otherwise(F.array(trimmed))
    return F.array_distinct(F.when(F.size(found) >= 2, many).otherwise(few))


def content_terms(text: Column) -> Column:
    """Search terms of a query: split at white space, two characters or more, the first of each spelling, no function words if others remain."""
    tokens = F.filter(F.split(F.trim(text), r"\s+"), lambda t: F.length(t) >= 2)
    lowered = F.transform(tokens, F.lower)
    first = F.filter(tokens, lambda t, i: F.array_position(lowered, F.lower(t)) == i + 1)
    stop = F.array(*[F.lit(w) for w in SEARCH_STOPWORDS])
    kept = F.filter(first, lambda t: ~F.array_contains(stop, F.lower(t)))
    return F.when((F.size(first) > 1) & (F.size(kept) > 0), kept).otherwise(first)


def content_terms_text(text: str) -> list[str]:
    once: dict[str, str] = {}
    for t in (text or "").split():
        if len(t) >= 2:
            once.setdefault(t.lower(), t)
    first = list(once.values())
    kept = [t for t in first if t.lower() not in SEARCH_STOPWORDS]
    return kept if len(first) > 1 and kept else first


def shape_score(token: Column) -> Column:
    """How much a token looks like an identifier: 1 each for mixed case, an acronym and a compound, a half each for a digit and for 12 characters
    or more, of its last part."""
    last = F.element_at(F.split(F.element_at(F.split(token, "/"), -1), "::"), -1)
    point = lambda test, worth: F.when(test, worth).otherwise(0.0)
    upper, lower = last.rlike(r"\p{Lu}"), last.rlike(r"\p{Ll}")
    compound = last.rlike(r"[_.-]") | token.contains("::")
    return point(upper & lower, 1.0) + point(
        upper & ~lower & (F.length(last) >= 2), 1.0
    ) + point(compound, 1.0) + point(last.rlike(r"\d"), 0.5) + point(F.length(last) >= 12, 0.5)


def candidates(text: Column) -> Column:
    """Identifier candidates of a text, each once, in order."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)))


def leaf(name: Column) -> Column:
    """The last part of a namespaced name."""
    return F.element_at(F.split(name, "/"), -1)


def namespace(name: Column) -> Column:
    return F.when(name.contains("/"), F.substring_index(name, "/", 1))


def slug(text: Column, length: int = 48) -> Column:
    """Lower case, everything but letters and digits as ``_``, no ``_`` at the ends, cut; ``subject`` if nothing is left."""
    base = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    cut = F.regexp_replace(F.substring(base, 1, length), "_+$", "")
    return F.when(F.length(cut) > 0, cut).otherwise("subject")


def member_hash(names: Column) -> Column:
    """First 8 hex digits of the SHA-256 of the sorted names, joined by line ends."""
    return F.substring(F.sha2(F.array_join(F.array_sort(names), "\n"), 256), 1, 8)


def glob_pattern(glob: str) -> str:
    """A glob as an anchored regular expression: ``*`` any run, ``?`` one character, ``[...]`` a class."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and (end := glob.find("]", i + 2)) > 0:
            body = glob[i + 1 : end].replace("\\", "\\\\")
            out += "[" + ("^" + body[1:] if body.startswith("!") else body) + "]"
            i = end
        else:
            out += re.escape(c)
        i += 1
    return f"(?s)^{out}$"


def channel_matches(channel: Column, pattern: str) -> Column:
    """Channel patterns: empty and ``*`` mean all, a ``*`` or ``:`` at the end means a prefix, anything else equality."""
    if pattern in ("", "*"):
        return F.lit(True)
    if pattern.endswith("*"):
        return channel.startswith(pattern[:-1])
    return channel.startswith(pattern) if pattern.endswith(":") else channel == pattern


def duration_seconds(text: Column) -> Column:
    """Seconds of ``30s``, ``15m``, ``2h``, ``7d``, ``2w`` or a bare number; null for anything else."""
    number = F.regexp_extract(text, r"^\s*(\d+(?:\.\d+)?)\s*([smhdw]?)\s*$", 1)
    unit = F.regexp_extract(text, r"^\s*(\d+(?:\.\d+)?)\s*([smhdw]?)\s*$", 2)
    size = F.when(unit == "w", 604800.0).when(unit == "d", 86400.0).when(unit == "h", 3600.0).when(unit == "m", 60.0).otherwise(1.0)
    return F.when(number != "", number.try_cast("double") * size)


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / 4)
