"""Decision records, bold metadata and class sketches in Markdown."""

from __future__ import annotations

import re

from threadloom.sources.code import PLAIN_TYPES, type_names
from threadloom.sources.common import Findings

# What a decision's status is worth, and the authority of its structural edges.
STATUS = {"accepted": 1.0, "proposed": 0.3, "draft": 0.2, "superseded": 0.0, "deprecated": 0.0, "rejected": 0.0}
AUTHORITY = 3.0
FIELD = re.compile(r"^(?:[-*]\s+)?\*{0,2}([A-Z][A-Za-z -]+?):\*{0,2}\s*(.+?)\s*$")
CAMEL = re.compile(r"\b[A-Z][a-z0-9]+(?:[A-Z][a-z0-9]*)+\b")
GOVERNED = re.compile(r"\b[A-Z][A-Za-z0-9_]{2,}\b")
NUMBER = re.compile(r"(?:adr|decision)[-_/ ]?0*(\d{1,4})|(?:^|/)(\d{4})-[^/]*$", re.IGNORECASE)
REFERENCE = re.compile(r"\bADR-(\d{4})\b")
CHILD = re.compile(r"\s*[+\-|]+--\s*([A-Z]\w+)(?:\s*\(([\w,\s]+)\))?")
CLASS = re.compile(r"(?:(?:class|enum|struct|interface)\s+)?([A-Z]\w+)\s*(?:(?:\(|extends\s+)([\w,\s]+)\)?)?\s*:\s*(?:#.*)?$")
METHOD = re.compile(r"\s+([a-z_]\w*)\s*\(([^)]*)\)\s*(?:->\s*([^#]+?))?\s*(?:#.*)?$")


def header(text: str) -> dict[str, str]:
    """Fields above the first section; indented lines go on with the field before."""
    out: dict[str, str] = {}
    key = None
    for line in text.splitlines():
        bare = line.strip()
        if bare.startswith("## "):
            break
        if m := FIELD.match(bare):
            key = m[1].strip().lower()
            out[key] = m[2]
        elif key and bare and line[0].isspace():
            out[key] += f" {bare}"
        else:
            key = None
    return out


def parse_decision(found: Findings, text: str) -> None:
    """A decision record: its hub ``adr/NNNN``, governed names by its status, and, weighted by status and authority, the records it refers to and
    its class trees."""
    fields = header(text)
    n = NUMBER.search(found.path) or NUMBER.search(text[:200])
    own = f"{int(n[1] or n[2]):04d}" if n else found.path.rsplit("/", 1)[-1]
    worth = next((w for s, w in STATUS.items() if fields.get("status", "").lower().startswith(s)), 1.0)
    title = next((x.lstrip("# ").strip() for x in text.splitlines() if x.startswith("# ")), None)
    found.entity(found.path, "doc", title)
    found.link("defines", f"adr/{own}", found.path, worth * AUTHORITY)
    for name in dict.fromkeys(GOVERNED.findall(fields.get("governs", ""))):
        if name not in PLAIN_TYPES:
            found.link("mentions", name, found.path, worth)
    for other in dict.fromkeys(REFERENCE.findall(text)):
        if other != own:
            found.link("related-to", f"adr/{other}", found.path, worth * AUTHORITY)
            found.link("related-to", f"adr/{own}", f"adr/{other}", worth * AUTHORITY)
    parse_classes(found, text, worth)


def parse_bold(found: Findings, text: str) -> None:
    """``**Key:** value`` lines of any document, as mentions of the names in them."""
    found.entity(found.path, "doc")
    for key, value in re.findall(r"^\s*(?:[-*]\s*)?\*\*([^*:]+):\*\*\s*(.+)$", text, re.MULTILINE):
        for name in dict.fromkeys(re.findall(r"`([^`]+)`", value) + CAMEL.findall(value)):
            found.link("mentions", name, found.path, 1.0, None, key.strip().lower())


def parse_classes(found: Findings, text: str, worth: float = 1.0) -> None:
    """Class trees (``+-- Name (Base)``) anywhere and classes in fenced blocks: definitions and subtypes with authority, methods and types of
    their bodies as mentions."""
    fenced, owner, own = False, None, ""

    def define(m: re.Match, line: int) -> str:
        me = f"{found.path}::{m[1]}"
        found.entity(me, "doc", "class")
        found.link("defines", m[1], me, worth * AUTHORITY, line)
        for base in (b.strip() for b in (m[2] or "").split(",")):
            if base and base not in PLAIN_TYPES:
                found.link("is_a", base, me, worth * AUTHORITY, line)
        return me

    for n, line in enumerate(text.splitlines(), 1):
        if line.strip().startswith("```"):
            fenced, owner = not fenced, None
        elif m := CHILD.match(line):
            define(m, n)
            owner = None
        elif fenced and line[:1].strip() and (m := CLASS.match(line)):
            owner, own = define(m, n), m[1]
        elif owner and line[:1].isspace() and line.strip():
            m = METHOD.match(line)
            names = [m[1], *type_names(f"{m[2]} {m[3] or ''}")] if m else type_names(line)
            for name in dict.fromkeys(names):
                if name != own:
                    found.link("mentions", name, owner, worth, n)
        elif line.strip():
            owner = None
