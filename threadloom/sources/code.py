"""Program text: Python by its syntax tree, SQL and pseudo code by patterns, call graphs and unit lists from JSON."""

from __future__ import annotations

import ast
import json
import re
from collections import Counter

from threadloom.sources.common import Findings

#: Names that every program calls and that say nothing about it.
COMMON_CALLS = set(
    "print len str int float list dict set tuple range open isinstance getattr setattr hasattr super type sorted min max sum any all map filter zip enumerate repr format".split()
)
# Words of docstrings that aren't keywords.
DOC_STOP = set(
    "the a an and or of to for in is are be this that it as on from with by if into out not but so we you i me my our use used uses using see also can may must will should would could args arg kwargs kwarg param params return "
    "returns raise raises yields yield note notes example examples default true false none self cls type types value values object objects".split()
)


def doc_words(text: str) -> Counter:
    return Counter(w for m in re.findall(r"[A-Za-z_][A-Za-z0-9_]{2,}", text) if (w := m.lower()) not in DOC_STOP)


def parse_python(found: Findings, text: str) -> None:
    """Definitions with their parts, imports (top module), calls and docstring words of a Python file."""
    module = ast.parse(text)
    path = found.path
    found.entity(path, "code", (ast.get_docstring(module) or "").split("\n")[0] or None)
    for word, n in doc_words(ast.get_docstring(module) or "").items():
        found.link("mentions", f"keyword/{word}", path, float(n))

    def visit(node: ast.AST, owner: str, prefix: str) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.Import):
                for alias in child.names:
                    found.link("imports", f"import/{alias.name.split('.')[0]}", path, None, child.lineno)
            elif isinstance(child, ast.ImportFrom):
                if child.module and not child.level:
                    found.link("imports", f"import/{child.module.split('.')[0]}", path, None, child.lineno)
            elif isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                name = f"{prefix}{child.name}"
                me = f"{path}::{name}"
                doc = ast.get_docstring(child) or ""
                signature = f"({', '.join(a.arg for a in child.args.args)})" if not isinstance(child, ast.ClassDef) else ""
                found.entity(me, "code", doc.split("\n")[0] or None, json.dumps({"signature": signature, "line": child.lineno}))
                found.link("defines", child.name, me, None, child.lineno)
                found.link("has-part", name, owner, None, child.lineno)
                if isinstance(child, ast.ClassDef):
                    for base in child.bases:
                        if isinstance(base, (ast.Name, ast.Attribute)):
                            found.link("is_a", base.id if isinstance(base, ast.Name) else base.attr, me, None, child.lineno)
                for word, n in doc_words(doc).items():
                    found.link("mentions", f"keyword/{word}", me, float(n))
                visit(child, me, f"{name}.")
            else:
                if isinstance(child, ast.Call):
                    f = child.func
                    callee = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None
                    if callee and callee not in COMMON_CALLS:
                        found.link("calls", callee, owner, None, child.lineno)
                visit(child, owner, prefix)

    visit(module, path, "")


_COMMENT = re.compile(r"--[^\n]*|/\*.*?\*/", re.DOTALL)
_PART = r'(?:"[^"]+"|[A-Za-z_][\w$]*)'
_NAME = rf"{_PART}(?:\s*\.\s*{_PART})*"
_CREATE = re.compile(
    rf"\bCREATE\s+(?:OR\s+REPLACE\s+)?(?:(?:GLOBAL|LOCAL|TEMP|TEMPORARY|UNLOGGED|UNIQUE|MATERIALIZED|CONSTRAINT)\s+)*(TABLE|VIEW|TYPE|TRIGGER|INDEX|SCHEMA|FUNCTION|PROCEDURE)\s+(?:CONCURRENTLY\s+)?(?:IF\s+NOT\s+EXISTS\s+)?({_NAME})",
    re.IGNORECASE,
)
_USES = re.compile(rf"\b(?:FROM|JOIN|INTO|UPDATE)\s+(?:ONLY\s+)?({_NAME})", re.IGNORECASE)
_CALLS = re.compile(r"\b([A-Za-z_]\w{2,})\s*\(")
_BODY = re.compile(r"\$(\w*)\$(.*?)\$\1\$", re.DOTALL)
# Words of SQL that read like calls or tables.
SQL_WORDS = set(
    "select from where join inner outer left right full cross on using group order having limit offset union all into values insert update delete set and or not is null as by with lateral case when then else end if elsif elseif "
    "loop while for foreach return returns begin declare exception raise perform execute create table view function procedure trigger index type schema exists distinct asc desc only alter add constraint check references foreign "
    "primary unique key default column do drop grant revoke comment rename sequence materialized refresh truncate copy analyze owner to tablespace cascade restrict returning conflict nothing do_nothing generated always count sum avg "
    "min max coalesce nullif cast array row over partition between like ilike abs now extract to_char to_date to_timestamp length lower upper trim concat nextval currval setval substring position replace split_part format round floor "
    "ceil greatest least jsonb_build_object json_build_object unnest".split()
)


def parse_sql(found: Findings, text: str) -> None:
    """What a SQL script defines, what its functions' bodies mention and call, and what it calls outside of them; comments count for nothing,
    names by their last part."""
    plain = _COMMENT.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), text)
    last = lambda n: re.split(r"\s*\.\s*", n)[-1].strip('"')
    line = lambda at: plain.count("\n", 0, at) + 1
    found.entity(found.path, "code")
    made = list(_CREATE.finditer(plain))
    routines = [m for m in made if m[1].upper() in ("FUNCTION", "PROCEDURE")]
    outside = plain
    for m in made:
        name, kind = last(m[2]), m[1].lower()
        me = f"{found.path}::{name}"
        found.entity(me, "code", kind)
        found.link("defines", name, me, None, line(m.start()), f"{kind} {name}")
        if m not in routines:
            continue
        after = [x.start() for x in routines if x.start() > m.start()]
        body = _BODY.search(plain, m.start(), after[0] if after else len(plain))
        end = body.end() if body else after[0] if after else len(plain)
        outside = outside[: m.start()] + re.sub(r"[^\n]", " ", outside[m.start() : end]) + outside[end:]
        if body:
            for verb, pattern, weight in (("mentions", _USES, 1.0), ("calls", _CALLS, None)):
                for x in pattern.finditer(plain, body.start(2), body.end(2)):
                    if (other := last(x[1])).lower() not in SQL_WORDS and other.lower() != name.lower():
                        found.link(verb, other, me, weight, line(x.start()))
    headers = [m.span() for m in made]
    for x in _CALLS.finditer(outside):
        if x[1].lower() not in SQL_WORDS and not any(a <= x.start() < b for a, b in headers):
            found.link("calls", x[1], found.path, None, line(x.start()))


_PSEUDO_TYPE = re.compile(r"([A-Z][A-Za-z0-9]+):\s*(?:#.*)?$")
_PSEUDO_ROUTINE = re.compile(r"([a-z_]\w*)\s*\((?:([^)]*)\)(?:\s*->\s*(.+?))?\s*:\s*(?:#.*)?$)?", re.ASCII)
_PSEUDO_VALUE = re.compile(r"\s+[A-Z][A-Z_0-9]+(?:\s*=.*)?\s*(?:#.*)?$")
_PSEUDO_FIELD = re.compile(r"\s+[a-z_]\w*\s*:\s*(.+?)(?:\s*#.*)?$", re.ASCII)
# Types that say nothing.
PLAIN_TYPES = set("None True False int int32 int64 uint32 uint64 float double string bool bytes UUID JSON list dict map set tuple optional".split())


def type_names(text: str | None) -> list[str]:
    return [t for t in re.findall(r"[A-Z][A-Za-z0-9]{2,}", text or "") if t not in PLAIN_TYPES]


def parse_pseudo(found: Findings, text: str) -> None:
    """Pseudo code: ``Name:`` heads a type with fields or an enum with values, ``name(parameters) -> type:`` a routine with a body, ``from x
    import y`` an import.

    Types in fields, parameters, results and bodies are mentioned; bodies call, but not themselves; values of enums count for nothing.
    """
    found.entity(found.path, "code")
    within, owner, own_name = None, found.path, ""
    for n, raw in enumerate(text.splitlines(), 1):
        if not raw.strip() or raw.strip().startswith(("#", "//")):
            continue
        if not raw[0].isspace():
            within = None
            if m := re.match(r"from\s+(\w+)\s+import\s+.+", raw):
                found.link("imports", f"import/{m[1]}", found.path, None, n, raw.strip())
                continue
            head = _PSEUDO_TYPE.match(raw)
            if not head:
                head = _PSEUDO_ROUTINE.match(raw)
                within = "routine" if head else None
            else:
                within = "type"
            if head:
                own_name, owner = head[1], f"{found.path}::{head[1]}"
                found.entity(owner, "code", within)
                found.link("defines", own_name, owner, None, n)
                for t in type_names(" ".join(head.groups(default="")[1:])) if within == "routine" else []:
                    found.link("mentions", t, owner, 1.0, n)
        elif within == "type":
            if _PSEUDO_VALUE.match(raw):
                within = "enum"
            elif m := _PSEUDO_FIELD.match(raw):
                for t in type_names(m[1]):
                    found.link("mentions", t, owner, 1.0, n)
        elif within == "routine":
            for callee in re.findall(r"\b([a-z_][a-z0-9_]{2,})\s*\(", raw):
                if callee != own_name:
                    found.link("calls", callee, owner, None, n)
            for t in type_names(raw):
                found.link("mentions", t, owner, 1.0, n)


def parse_call_graph(found: Findings, text: str) -> None:
    """``{edges: [{from_file, from_func, to_file, to_func}]}``: both ends define their function; calls and called_by between them. Ends may be
    missing."""
    for e in json.loads(text).get("edges", []):
        ends = [(e.get(f"{side}_file"), e.get(f"{side}_func")) for side in ("from", "to")]
        names = [f"{file}::{func}" if file and func else None for file, func in ends]
        for (_, func), name in zip(ends, names):
            if name:
                found.entity(name, "code")
                found.link("defines", func, name)
        if names[0] and ends[1][1]:
            found.link("calls", ends[1][1], names[0])
            if names[1]:
                found.link("called_by", ends[0][1], names[1])


def parse_units(found: Findings, text: str) -> None:
    """``{path, units: [{name, unit_type, summary, calls, called_by, imports, dependencies, line}]}``: each unit defines its name and is a
    ``kind/<type>``; calls follow, imports by file."""
    doc = json.loads(text)
    path = doc.get("path") or found.path
    found.entity(path, "code", doc.get("summary"))
    tops = set()
    for u in doc.get("units", []):
        me = f"{path}::{u['name']}"
        found.entity(me, "code", u.get("summary"))
        found.link("defines", u["name"], me, None, u.get("line"))
        found.link("is_a", f"kind/{u.get('unit_type') or 'unit'}", me)
        for verb in ("calls", "called_by"):
            for other in u.get(verb) or []:
                if other and other not in COMMON_CALLS:
                    found.link(verb, other, me)
        tops |= {i.strip().split(".")[0] for i in [*(u.get("imports") or []), *(u.get("dependencies") or "").split(",")]} - {""}
    for top in sorted(tops):
        found.link("imports", f"import/{top}", path)


# How sure an extracted edge is.
CERTAINTY = {"EXTRACTED": 1.0, "INFERRED": 0.5, "AMBIGUOUS": 0.3}


# What relations are called here.
RELATIONS = {
    "contains": "has-part", "inherits": "is_a", "implements": "defines", "references": "mentions", "uses": "depends-on", "cites": "related-to",
    "method": "has-part", "rationale_for": "specifies",
    "conceptually_related_to": "related-to", "semantically_similar_to": "similar_to",
}


def parse_cross_graph(found: Findings, text: str) -> None:
    """``{nodes: [{id, label, file_type}], links: [{source, target, relation, weight, confidence, confidence_score, source_location}]}``: links
    from a node's concept to the other node.

    Every node is an entity ``graphify::id`` and a concept ``gf/id``. Links without a relation or with an unknown end are left out.
    """
    doc = json.loads(text)
    known = [n for n in doc.get("nodes") or [] if n.get("id")]
    for n in known:
        found.entity(f"graphify::{n['id']}", "doc" if n.get("file_type") in ("doc", "web", "paper") else "code", n.get("label") or n["id"])
    ids = {n["id"] for n in known}
    for e in doc.get("links") or doc.get("edges") or []:
        if e.get("relation") and e.get("source") in ids and e.get("target") in ids:
            weight = float(e.get("weight") or 1.0) * CERTAINTY.get(e.get("confidence") or "EXTRACTED", 1.0) * float(e.get("confidence_score") or 1.0)
            at = re.match(r"L(\d+)", e.get("source_location") or "")
            found.link(
                RELATIONS.get(e["relation"], e["relation"]), f"gf/{e['source']}", f"graphify::{e['target']}", weight, int(at[1]) if at else None,
                e.get("context") or e.get("source_file")
            )
