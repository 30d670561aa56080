"""Markdown with a graph in it: front matter, heading tree, anchors, relations, links and body terms."""

from __future__ import annotations

import re
from collections import Counter

from threadloom.model import BODY_STOPWORDS, VERB_ALIASES
from threadloom.sources.common import Findings

# The syntax of anchors, relations, links and attributes.
ANCHOR = re.compile(r"\{#([a-z0-9][a-z0-9._/-]*)([^}]*)\}")
WIKILINK = re.compile(r"\[\[([^\[\]]+)\]\]")
HEADING = re.compile(r"^(#{1,6})\s+(.*)$")
RELATION = re.compile(r"^rel:\s+([a-z][a-z0-9-]*)\s*->\s*(\S+(?:\s+\S+)*?)(?:\s*\{([^}]*)\})?\s*$")
ATTRIBUTE = re.compile(r'([a-zA-Z_][\w-]*)=("[^"]*"|\[[^\]]*\]|\S+)')
INLINE_CODE = re.compile(r"(?<!`)(`+)(?!`)(.+?)(?<!`)\1(?!`)")
TITLE_WORD = re.compile(r"[A-Za-z][A-Za-z0-9_-]{2,}")
BODY_WORD = re.compile(r"[A-Za-z_][A-Za-z0-9_]{2,}")
STOP = set(BODY_STOPWORDS)
LEAD_LINES = 3
TITLE_WEIGHT, ALIAS_WEIGHT = 2.0, 3.0


def front_matter(lines: list[str]) -> tuple[dict, int]:
    """Keys of a ``---`` block at the start, and the line after it. Values in brackets become lists."""
    if not lines or lines[0].strip() != "---":
        return {}, 0
    out: dict = {}
    for i, line in enumerate(lines[1:], 1):
        if line.strip() == "---":
            return out, i + 1
        key, colon, value = line.partition(":")
        if colon and key.strip():
            value = value.strip()
            if value.startswith("[") and value.endswith("]"):
                out[key.strip()] = [v.strip().strip("'\"") for v in value[1:-1].split(",") if v.strip()]
            else:
                out[key.strip()] = value.strip("'\"")
    return {}, 0


def attributes(text: str) -> dict:
    out: dict = {}
    for key, value in ATTRIBUTE.findall(text):
        out[key] = [v.strip() for v in value[1:-1].split(",") if v.strip()] if value.startswith("[") else value.strip('"')
    return out


def masked(line: str) -> str:
    """A line with its inline code blanked, at the same length."""
    return INLINE_CODE.sub(lambda m: " " * len(m.group()), line)


def term_counts(lines: list[str]) -> Counter:
    return Counter(w for line in lines if not line.startswith("rel:") for m in BODY_WORD.finditer(line) if (w := m.group().lower()) not in STOP)


def nodes_of(text: str, doc_id: str) -> tuple[dict, list[dict]]:
    """Front matter and the nodes of a document: id, line, level, title, parent, body, rels [(line, verb, target)], refs [(line, target)], aliases."""
    lines = text.splitlines()
    meta, start = front_matter(lines)
    root = {
        "id": meta.get("id") or doc_id, "line": 1, "level": 0, "title": meta.get("title", ""), "parent": None, "body": [], "rels": [], "refs": [],
        "aliases": []
    }
    nodes, stack, fence = [root], [root], None
    for n, line in enumerate(lines[start:], start + 1):
        mark = re.match(r"^\s*(```|~~~)", line)
        if mark and fence in (None, mark[1]):
            fence = None if fence else mark[1]
            continue
        if fence:
            continue
        plain = masked(line)
        if head := HEADING.match(plain):
            anchor = ANCHOR.search(plain)
            attrs = attributes(anchor[2]) if anchor else {}
            title = ANCHOR.sub("", line[len(head[1]) :]).strip()
            while stack[-1]["level"] >= len(head[1]):
                stack.pop()
            slug = re.sub(r"[^a-z0-9]+", "-", title.lower()).strip("-") or f"line-{n}"
            alias = attrs.get("alias", [])
            node = {
                "id": f"{root['id']}#{anchor[1] if anchor else slug}", "line": n, "level": len(head[1]), "title": title, "parent": stack[-1]["id"],
                "body": [], "rels": [], "refs": [], "aliases": alias if isinstance(alias, list) else [alias]
            }
            nodes.append(node)
            stack.append(node)
        elif rel := RELATION.match(plain):
            target = WIKILINK.search(rel[2])
            stack[-1]["rels"].append((n, VERB_ALIASES.get(rel[1], rel[1]), (target[1] if target else rel[2]).strip()))
        else:
            stack[-1]["body"].append(plain)
            stack[-1]["refs"] += [(n, m[1].split("|")[0].strip()) for m in WIKILINK.finditer(plain)]
    return meta, nodes


def parse(found: Findings, text: str) -> None:
    """Entities and links of one document: part-of, title words 2.0, aliases 3.0, tags 1.0, body term counts, lead terms, relations and references."""
    meta, nodes = nodes_of(text, found.path)
    weight = {"adr": 3.0, "spec": 2.0}.get(str(meta.get("kind", "")).lower(), 1.0)
    for node in nodes:
        me = node["id"]
        found.entity(me, "doc", node["title"] or None)
        if node["parent"]:
            found.link("part-of", node["parent"], me, None, node["line"])
        tf: Counter = term_counts(node["body"])
        weights: dict[str, float] = {t: float(n) for t, n in tf.items()}
        for w in TITLE_WORD.findall(node["title"]):
            if w.lower() not in STOP:
                weights.setdefault(w, TITLE_WEIGHT)
        for alias in node["aliases"]:
            weights.setdefault(alias, ALIAS_WEIGHT)
        if node is nodes[0]:
            tags = meta.get("tags", [])
            for tag in tags if isinstance(tags, list) else [tags]:
                weights.setdefault(tag, 1.0)
        for term, w in weights.items():
            found.link("mentions", term, me, w, node["line"])
        lead = [x for x in node["body"] if x.strip()][:LEAD_LINES]
        for term in term_counts(lead):
            found.link("lead", term, me, 1.0, node["line"])
        for line, verb, target in node["rels"]:
            found.link(verb, target, me, weight, line)
        for line, target in node["refs"]:
            found.link("mentions", target, me, 1.0, line, "reference")
