"""Set algebra over links: the infix language, the functional language and their plans.

Both languages are parsed on the driver into one small tree. A tree of set operations becomes one plan: every term gets a
bit, the links are read once and joined with the concepts that the terms name, each entity collects its bits in one
aggregation, and the whole expression is a filter over those bits. The number of terms doesn't change the number of scans or
shuffles. Only an expression that is true for an entity without any link (a complement) needs the universe of
entities, which is then joined once.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions.names import canonicalize_text
from threadloom.graph import Graph
from threadloom.model import VERB_ALIASES
from threadloom.staging import stage


@dataclass(frozen=True)
class Term:
    name: str
    linkage: str | None = None


@dataclass(frozen=True)
class Node:
    """op is one of and, or, not, diff, xor; or count, topn, neighbors at the root."""

    op: str
    args: tuple = ()
    options: dict = field(default_factory=dict, hash=False)


_LEX = re.compile(r"\s*(?:(?P<par>[()])|(?P<sym>&&|\|\||!)|(?P<word>[A-Za-z_][\w\-./]*(?::[\w\-./@]+)?))")
_OPERATORS = {"and": "and", "&&": "and", "or": "or", "||": "or", "not": "not", "!": "not"}


def _lex(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _LEX.match(text, at)
        if not m:
            raise ValueError(f"cannot read the query at {text[at:at + 20]!r}")
        word = m["par"] or m["sym"] or m["word"]
        if m["word"]:
            lead = re.match(r"(?i)(and|or|not)(?![A-Za-z0-9_])", word)  # operator words win over terms
            if lead:
                out.append(("op", lead[1].lower()))
                at = m.start("word") + lead.end()
                continue
            out.append(("term", word))
        else:
            out.append(("par", word) if m["par"] else ("op", _OPERATORS[word]))
        at = m.end()
    return out


def parse_infix(text: str) -> Term | Node:
    """``or := and (OR and)*``, ``and := not (AND not)*``, ``not := NOT? atom``, ``atom := term | ( or )``; NOT takes an atom."""
    tokens, at = _lex(text), 0

    def peek() -> tuple[str, str]:
        return tokens[at] if at < len(tokens) else ("end", "")

    def chain(op: str, lower):
        nonlocal at
        found = [lower()]
        while peek() == ("op", op):
            at += 1
            found.append(lower())
        return found[0] if len(found) == 1 else Node(op, tuple(found))

    def unary():
        nonlocal at
        if peek() == ("op", "not"):
            at += 1
            return Node("not", (atom(),))
        return atom()

    def atom():
        nonlocal at
        kind, word = peek()
        if (kind, word) == ("par", "("):
            at += 1
            inner = disjunction()
            if peek() != ("par", ")"):
                raise ValueError("a parenthesis isn't closed")
            at += 1
            return inner
        if kind != "term":
            raise ValueError(f"a term is expected, not {word or 'the end'!r}")
        at += 1
        linkage, _, name = word.rpartition(":")
        return Term(name, linkage or None)

    def conjunction():
        return chain("and", unary)

    def disjunction():
        return chain("or", conjunction)

    tree = disjunction()
    if peek()[0] != "end":
        raise ValueError(f"more than one expression, from {peek()[1]!r} on")
    return tree


_CALL = re.compile(r"\s*(?:(?P<name>[A-Za-z_][\w\-./]*)|(?P<int>-?\d+)|'(?P<one>[^']*)'|\"(?P<two>[^\"]*)\"|(?P<mark>[(),=]))")
_FUNCTIONS = {
    "row": "row", "union": "or", "or": "or", "intersect": "and", "and": "and", "not": "not", "difference": "diff", "diff": "diff", "xor": "xor",
    "count": "count", "topn": "topn", "neighbors": "neighbors"
}


def parse_functional(text: str) -> Term | Node:
    """Nested calls such as ``TopN(Intersect(Row(defines, a), Not(Row(mentions, b))), n=5)``; function names in any case."""
    tokens: list[tuple[str, str]] = []
    at = 0
    text = text.rstrip()
    while at < len(text):
        m = _CALL.match(text, at)
        if not m:
            raise ValueError(f"cannot read the query at {text[at:at + 20]!r}")
        kind = m.lastgroup
        tokens.append(("str" if kind in ("one", "two") else kind, m[kind]))
        at = m.end()
    at = 0

    def value():
        nonlocal at
        if at >= len(tokens):
            raise ValueError("the query ends too early")
        kind, word = tokens[at]
        at += 1
        if kind == "int":
            return int(word)
        if kind == "mark":
            raise ValueError(f"unexpected {word!r}")
        if kind == "name" and at < len(tokens) and tokens[at] == ("mark", "("):
            at += 1
            args, options = [], {}
            while at < len(tokens) and tokens[at] != ("mark", ")"):
                if tokens[at][0] == "name" and at + 1 < len(tokens) and tokens[at + 1] == ("mark", "="):
                    key = tokens[at][1].lower()
                    at += 2
                    options[key] = value()
                else:
                    args.append(value())
                if at < len(tokens) and tokens[at] == ("mark", ","):
                    at += 1
                elif at >= len(tokens) or tokens[at] != ("mark", ")"):
                    raise ValueError("a comma or parenthesis is missing")
            if at >= len(tokens):
                raise ValueError("a parenthesis isn't closed")
            at += 1
            return call(word, args, options)
        return word

    def call(name: str, args: list, options: dict):
        op = _FUNCTIONS.get(name.lower())
        if op is None:
            raise ValueError(f"unknown function {name}")
        if op == "row":
            if len(args) != 2:
                raise ValueError("Row takes a linkage and a concept")
            return Term(str(args[1]), str(args[0]))
        if op == "neighbors":
            return Node(
                op, (Term(str(args[0])),),
                {"depth": int(options.get("depth", args[1] if len(args) > 1 else 1)), "linkages": [str(a) for a in args[2:]]}
            )
        if op == "topn":
            return Node(op, (as_set(args[0]),), {"n": int(options.get("n", args[1] if len(args) > 1 else 10))})
        sets = tuple(as_set(a) for a in args)
        if not sets or op in ("diff", "xor") and len(sets) < 2:
            raise ValueError(f"{name} lacks an argument")
        return Node(op, sets[: {"not": 1, "count": 1, "diff": 2, "xor": 2}.get(op)])

    def as_set(x):
        if isinstance(x, str):
            return Term(x)
        if isinstance(x, int):
            raise ValueError("a set is expected, not a number")
        return x

    tree = as_set(value())
    if at < len(tokens):
        raise ValueError(f"more than one expression, from {tokens[at][1]!r} on")
    return tree


def terms_of(tree: Term | Node) -> list[Term]:
    if isinstance(tree, Term):
        return [tree]
    return list(dict.fromkeys(t for a in tree.args for t in terms_of(a)))


def _truth(tree: Term | Node, of) -> Column | bool:
    if isinstance(tree, Term):
        return of(tree)
    args = [_truth(a, of) for a in tree.args]
    if tree.op == "not":
        return ~args[0] if not isinstance(args[0], bool) else not args[0]
    if tree.op == "diff":
        return args[0] & (~args[1] if not isinstance(args[1], bool) else not args[1])
    if tree.op not in ("and", "or", "xor"):
        raise ValueError(f"{tree.op} can only be the outermost function")
    join = {"and": lambda a, b: a & b, "or": lambda a, b: a | b, "xor": lambda a, b: a != b}[tree.op]
    return reduce(join, args)


def resolve(graph: Graph, names: list[str]) -> DataFrame:
    """(name, concept_id) of all concepts that a name denotes: the same name or the same canonical name."""
    canons = {n: canonicalize_text(n) for n in names}
    rows = graph.concepts().filter(F.col("name").isin(names) | F.col("canonical_name").isin(list(canons.values())))  # reaches the scan
    means = [F.when((F.col("name") == n) | F.coalesce(F.col("canonical_name") == c, F.lit(False)), F.lit(n)) for n, c in canons.items()]
    return rows.select(
        "concept_id", F.explode(F.array_compact(F.array(*means).cast("array<string>"))).alias("term")
    ).select("term", "concept_id").distinct()


def members(graph: Graph, tree: Term | Node) -> DataFrame:
    """(entity_id): the distinct entities that the expression holds for."""
    terms = terms_of(tree)
    if len(terms) > 62:
        raise ValueError("more than 62 terms")
    ids = resolve(graph, sorted({t.name for t in terms}))
    mask = reduce(
        lambda a, b: a.bitwiseOR(b),
        [
            F.when(
                (F.col("term") == t.name) & (F.lit(True) if t.linkage is None else F.col("linkage") == VERB_ALIASES.get(t.linkage, t.linkage)),
                F.lit(1 << i)
            ).otherwise(F.lit(0)).cast("long")
            for i, t in enumerate(terms)
        ],
    )
    links = graph.links
    if all(t.linkage for t in terms):
        links = links.filter(F.col("linkage").isin(sorted({VERB_ALIASES.get(t.linkage, t.linkage) for t in terms})))
    hits = links.join(ids, "concept_id").withColumn("mask", mask).filter("mask != 0").groupBy("entity_id").agg(F.bit_or("mask").alias("mask"))
    bit = {t: i for i, t in enumerate(terms)}
    truth = _truth(tree, lambda t: F.col("mask").bitwiseAND(F.lit(1 << bit[t]).cast("long")) != 0)
    if _truth(tree, lambda t: False):
        universe = graph.entities.select(F.col("id").alias("entity_id")).distinct()
        hits = universe.join(hits, "entity_id", "left").withColumn("mask", F.coalesce("mask", F.lit(0).cast("long")))
    return hits.filter(truth).select("entity_id")


def top_n(graph: Graph, found: DataFrame, n: int = 10) -> DataFrame:
    """(entity_id, weight): entities by the number of (linkage, concept that isn't noise) rows that hold them."""
    concepts = graph.concepts().filter("noise = 0").select("concept_id")
    counted = graph.links.join(found, "entity_id", "left_semi").join(
        concepts, "concept_id", "left_semi"
    ).groupBy("entity_id").agg(F.count(F.lit(1)).alias("weight"))
    return counted.orderBy(F.desc("weight"), "entity_id").limit(n)


def neighbors(graph: Graph, seeds: DataFrame, depth: int = 1, linkages: list[str] | None = None) -> DataFrame:
    """(entity_id): what is reached from concepts in up to ``depth`` hops, each id of a hop taken as a concept; noise is dropped, seeds at the end.

    ``seeds`` has concept_id. Every hop is staged, so that the plan doesn't grow with the depth.
    """
    links = graph.links.filter(F.col("linkage").isin(linkages)) if linkages else graph.links
    quiet = graph.entities.filter("noise = 1").select(F.col("id").alias("entity_id"))
    frontier = seeds.select("concept_id").distinct()
    seen = None
    for hop in range(max(depth, 0)):
        reached = links.join(frontier, "concept_id", "left_semi").select("entity_id").distinct().join(quiet, "entity_id", "left_anti")
        fresh = reached if seen is None else reached.join(seen, "entity_id", "left_anti")
        if depth > 1:
            fresh = stage(fresh, f"hop-{hop}")
            if hop and not fresh.limit(1).count():
                break
        seen = fresh if seen is None else seen.union(fresh)
        frontier = fresh.withColumnRenamed("entity_id", "concept_id")
    if seen is None:
        return graph.links.select("entity_id").limit(0)
    return seen.join(seeds.select(F.col("concept_id").alias("entity_id")), "entity_id", "left_anti")


def co_occurrence(graph: Graph, name: str, linkage: str = "mentions") -> DataFrame:
    """(concept_id, name, overlap): entities that other concepts share with the named one under a linkage; anchors and noise left out."""
    anchors = resolve(graph, [name]).select("concept_id")
    links = graph.links.filter(F.col("linkage") == linkage)
    holders = links.join(anchors, "concept_id", "left_semi").select("entity_id").distinct()
    others = links.join(holders, "entity_id", "left_semi").join(anchors, "concept_id", "left_anti").groupBy("concept_id").agg(
        F.countDistinct("entity_id").alias("overlap")
    )
    return others.join(graph.concepts().filter("noise = 0").select("concept_id", "name"), "concept_id").select("concept_id", "name", "overlap")


def explain(graph: Graph, found: DataFrame) -> DataFrame:
    """(entity_id, linkage, concept_id, file, line): the evidence of each result, null where there is none."""
    return found.join(graph.evidence.select("entity_id", "linkage", "concept_id", "file", "line"), "entity_id", "left")


def run(graph: Graph, query: str, functional: bool = False, name_like: str | None = None, limit: int | None = None) -> DataFrame:
    """Run a query of either language.

    Sets come as (entity_id), Count as (n), TopN as (entity_id, weight). Unknown names give empty sets. ``name_like`` keeps
    entities whose name is LIKE it, ``limit`` the first ids.
    """
    tree = parse_functional(query) if functional else parse_infix(query)
    if isinstance(tree, Node) and tree.op == "count":
        return members(graph, tree.args[0]).agg(F.count(F.lit(1)).alias("n"))
    if isinstance(tree, Node) and tree.op == "topn":
        return top_n(graph, members(graph, tree.args[0]), tree.options["n"])
    if isinstance(tree, Node) and tree.op == "neighbors":
        out = neighbors(graph, resolve(graph, [tree.args[0].name]), tree.options["depth"], tree.options["linkages"])
    else:
        out = members(graph, tree)
    if name_like is not None:
        out = out.join(graph.entities.filter(F.col("name").like(name_like)).select(F.col("id").alias("entity_id")), "entity_id", "left_semi")
    return out.orderBy("entity_id").limit(limit) if limit is not None else out
