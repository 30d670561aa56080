"""Ingest: from a folder of files to a graph.

Every file goes to the parser of its kind, all in one pass; the findings become entities, links and evidence with ids. A name's id is a hash of
partition, kind and
name, so that ingesting again gives the same ids and files can be taken in any order or one by one.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions.names import canonicalize
from threadloom.graph import Graph
from threadloom.model import canonical_verb
from threadloom.sources import code, files, markdown, records
from threadloom.sources.common import Findings, parsed
from threadloom.staging import stage

#: Kinds of sources in the order in which ``auto`` takes them for JSON files.
SOURCES = ("auto", "metadata", "tldr", "tree", "graphify")


def parse_json(found: Findings, text: str) -> None:
    """The parser that a JSON document's own keys ask for; one without any known key is an error."""
    doc = json.loads(text)
    for key, parse in (("units", code.parse_units), ("nodes", code.parse_cross_graph), ("edges", code.parse_call_graph)):
        if isinstance(doc, dict) and key in doc:
            return parse(found, text)
    raise ValueError("neither units nor nodes nor edges")


def parse_any(found: Findings, text: str) -> None:
    """The parser that a file's name asks for."""
    path = found.path.lower()
    if path.endswith((".md", ".markdown")):
        name = path.rsplit("/", 1)[-1]
        (records.parse_decision if name.startswith("adr") or "adr" in path.split("/")[:-1] else markdown.parse)(found, text)
    elif path.endswith(".py"):
        code.parse_python(found, text)
    elif path.endswith(".sql"):
        code.parse_sql(found, text)
    elif path.endswith((".pseudo", ".pseudocode")):
        code.parse_pseudo(found, text)
    elif path.endswith(".json"):
        parse_json(found, text)
    else:
        found.entity(found.path, "doc" if path.endswith((".rst", ".txt", ".adoc")) else "code")


def entity_id(kind, name, partition_id: int):
    """A positive 62-bit id of an entity."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(partition_id), kind, name), 2)


def to_graph(findings: DataFrame, partition_id: int = 1, now: float = 0.0) -> Graph:
    """The graph of findings. A link's concept that is no entity becomes a concept; an end that isn't named as an entity, a document."""
    links = findings.filter("what = 'link' AND concept IS NOT NULL AND name IS NOT NULL").withColumn("linkage", canonical_verb(F.col("linkage")))
    named = findings.filter("what = 'entity'").groupBy("name", "kind").agg(
        F.max("path").alias("path"), F.max("tldr").alias("tldr"), F.max("meta").alias("meta")
    )
    ends = links.select("name").distinct().join(named.select("name").distinct(), "name", "left_anti").select(
        "name", F.lit("doc").alias("kind"), *[F.lit(None).cast("string").alias(c) for c in ("path", "tldr", "meta")]
    )
    concepts = links.select(F.col("concept").alias("name")).distinct().select(
        "name", F.lit("concept").alias("kind"), *[F.lit(None).cast("string").alias(c) for c in ("path", "tldr", "meta")]
    )
    rows = named.unionByName(ends).unionByName(concepts)
    entities = rows.select(
        entity_id(F.col("kind"), F.col("name"), partition_id).alias("id"), F.lit(partition_id).alias("partition_id"), "kind", "path", "name", "tldr",
        "meta", F.lit(now).alias("created_at"), F.lit(now).alias("updated_at"),
        F.lit(0).alias("protected"), F.lit(0).alias("noise"), F.when(F.col("kind") == "concept", canonicalize(F.col("name"))).alias("canonical_name"),
        F.lit(None).cast("double").alias("vectors_updated_at"),
    )
    own = named.unionByName(ends).groupBy("name").agg(F.min("kind").alias("kind"))
    ids = links.select("linkage", "concept", "name", "weight", "path", "line", "detail").join(own, "name").select(
        "linkage", entity_id(F.lit("concept"), F.col("concept"), partition_id).alias("concept_id"),
        entity_id(F.col("kind"), F.col("name"), partition_id).alias("entity_id"), "weight", "path", "line", "detail"
    )
    evidence = ids.filter("line IS NOT NULL OR detail IS NOT NULL").select(
        "entity_id", "linkage", "concept_id", F.col("path").alias("file"), "line", F.lit(None).cast("int").alias("span_end"), "detail"
    ).distinct()
    return Graph(entities, ids.groupBy("linkage", "concept_id", "entity_id").agg(F.max("weight").alias("weight")), evidence)


def ingest(
    spark: SparkSession, root: str, source: str = "auto", ignore: Sequence[str] = (), partition_id: int = 1, now: float = 0.0
) -> tuple[Graph, DataFrame, DataFrame]:
    """The graph of a folder, the files (path, mtime) to track for the next sync, and the files that couldn't be parsed (path, detail), which
    aren't tracked.

    ``metadata``, ``tldr`` and ``graphify`` read JSON files only, ``tree`` all others, ``auto`` everything.
    """
    if source not in SOURCES:
        raise ValueError(f"unknown source {source}")
    tree = files.tree(spark, root, ignore=ignore)
    if source in ("auto", "metadata", "tldr", "graphify"):
        extra = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").load(root)
        base = root.rstrip("/") + "/"
        local = F.regexp_replace(F.col("path"), r"^file:/+", "/")
        extra = extra.select(
            F.when(local.startswith(base), F.substring(local, F.lit(len(base) + 1), F.length(local))).otherwise(local).alias("path"),
            (F.unix_millis("modificationTime") / 1000.0).alias("mtime"), "length", F.decode(F.col("content"), "UTF-8").alias("text"),
            F.lit("code").alias("kind")
        )
        extra = extra.filter(~files.ignored(F.col("path"), ignore))
        tree = tree.unionByName(extra) if source == "auto" else extra
    findings = stage(parsed(tree, parse_any), "findings")
    errors = findings.filter("what = 'error'").select("path", "detail")
    return to_graph(findings, partition_id, now), tree.select("path", "mtime").join(errors.select("path"), "path", "left_anti"), errors
