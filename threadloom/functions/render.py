"""Results as text: context bundles, primers, session cards, graph-markdown."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Headings of a context bundle.
LABELS = {
    "defines": "DEFINED BY", "implements": "IMPLEMENTED BY", "called_by": "CALLED BY", "imports": "IMPORTED BY", "calls": "CALLS",
    "mentions": "MENTIONED IN", "is_a": "IS A", "related-to": "RELATED TO", "content": "CONTENT MATCH"
}


def bundle_text(bundle: DataFrame) -> DataFrame:
    """(linkage, text): the entries of a context (place, linkage, name, kind) as one block for each linkage."""
    label = F.coalesce(*[F.when(F.col("linkage") == k, v) for k, v in LABELS.items()], F.upper("linkage"))
    lines = F.array_sort(F.collect_list(F.struct("place", F.concat(F.lit("- "), "name", F.lit(" ("), "kind", F.lit(")")).alias("line"))))
    return bundle.groupBy("linkage").agg(
        F.concat(F.first(label), F.lit("\n"), F.array_join(F.transform(lines, lambda x: x["line"]), "\n")).alias("text")
    )


def bundle_json(bundle: DataFrame) -> DataFrame:
    """(linkage, json): the same as JSON arrays."""
    return bundle.groupBy("linkage").agg(F.to_json(F.array_sort(F.collect_list(F.struct("place", "entity_id", "name", "kind")))).alias("json"))


def primer_line(name: str = "name", total: str = "total"):
    return F.format_string("- %s (%d)", F.col(name), F.col(total))


def session_card(cards: DataFrame) -> DataFrame:
    """(session, text): title, place, turns, tools, commits and the first prompt of each session."""
    tools = F.array_join(
        F.transform(F.array_sort(F.map_entries("tool_counts")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ", "
    )
    return cards.select(
        "session",
        F.concat_ws("\n", F.concat(F.lit("# "), F.coalesce("title", "session")), F.concat_ws(" @ ", "cwd", "branch"), F.format_string("%d turns", F.col("turns")), F.when(tools != "", F.concat(F.lit("tools: "), tools)),
                    F.when(F.size("commits") > 0, F.concat(F.lit("commits: "), F.array_join("commits", ", "))),
                    F.get(F.col("prompts"), F.lit(0))).alias("text"),
    )


def graph_markdown(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(name, text): nodes (name, title) with their links (linkage, concept, name) as relation lines."""
    rels = links.groupBy("name").agg(
        F.array_sort(F.collect_set(F.concat(F.lit("rel: "), "linkage", F.lit(" -> [["), "concept", F.lit("]]")))).alias("r")
    )
    return nodes.join(rels, "name", "left").select(
        "name", F.concat_ws("\n", F.concat(F.lit("# "), F.coalesce("title", "name")), F.array_join("r", "\n")).alias("text")
    )
