"""Grep over the store: concepts found by name, answered with the lines that their evidence points at, checked against the files."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions.names import canonicalize_text

HIT = ["path", "line", "linkage", "concept", "entity"]


def named_like(name: Column, canonical: Column, pattern: str, regex: bool = False) -> Column:
    """Concepts whose name holds the pattern (``%`` and ``_`` match anything), or, where its canonical form is another spelling, whose canonical
    name is that or ends in it as a part."""
    if regex:
        return name.rlike(pattern)
    found = name.ilike(f"%{pattern}%")
    canon = canonicalize_text(pattern)
    if canon and canon != pattern.strip().lower():
        found = found | F.coalesce((canonical == canon) | canonical.endswith(f"_{canon}"), F.lit(False))
    return found


def spellings(pattern: str, word: bool = False) -> str | None:
    """How identifiers write a pattern of several words, as an expression; None for a single word, whose case counts."""
    words = [w for w in canonicalize_text(pattern).split("_") if w]
    if len(words) < 2:
        return None
    joined = r"[_\-\s]?".join(map(re.escape, words))
    return rf"(?i)\b(?:{joined})\b" if word else f"(?i){joined}"


def line_holds(text: Column, pattern: str, regex: bool = False, ignore_case: bool = False, word: bool = False) -> Column:
    case = "(?i)" if ignore_case else ""
    if regex:
        hit = text.rlike(case + pattern)
    elif word:
        hit = text.rlike(rf"{case}\b{re.escape(pattern)}\b")
    else:
        hit = F.lower(text).contains(pattern.lower()) if ignore_case else text.contains(pattern)
    bridge = None if regex or canonicalize_text(pattern) == pattern.strip().lower() else spellings(pattern, word)
    return hit | text.rlike(bridge) if bridge else hit


def grep_evidence(
    evidence: DataFrame, concepts: DataFrame, lines: DataFrame | None, pattern: str, regex: bool = False, ignore_case: bool = False,
    word: bool = False, linkage: str | None = None, kind: str | None = None, limit: int | None = 100,
) -> DataFrame:
    """(path, line, linkage, concept, entity): evidence of the concepts that a pattern names, in order, each hit once.

    ``evidence`` has (path, line from 1, linkage, concept_id, entity, kind), ``concepts`` (concept_id, name, canonical_name), ``lines`` (path,
    line_no, line). With
    lines, a hit stays only if its line really holds the pattern, and the limit counts such hits. Only the lines that evidence points at are joined.
    """
    own = concepts.filter(named_like(F.col("name"), F.col("canonical_name"), pattern, regex)).select("concept_id", F.col("name").alias("concept"))
    rows = evidence.filter("path IS NOT NULL AND line IS NOT NULL")
    if linkage:
        rows = rows.filter(F.col("linkage") == linkage)
    if kind:
        rows = rows.filter(F.col("kind") == kind)
    hits = rows.join(own, "concept_id").select(*HIT).distinct()
    if lines is not None:
        text = lines.select(
            "path", F.col("line_no").alias("line"), F.col("line").alias("text")
        ).filter(line_holds(F.col("text"), pattern, regex, ignore_case, word))
        hits = hits.join(text, ["path", "line"]).groupBy("path", "line", "linkage", "concept").agg(F.min("entity").alias("entity"))
    hits = hits.select(*HIT)
    return hits.orderBy(*HIT).limit(limit) if limit else hits
