"""Set algebra and joins over the stored graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.graph import Graph, read, store_graph
from threadloom.operators import dsl

A, B, C = "nogarnectar", "inlet_marble", "overview"
STORE = """
WITH ent AS (SELECT DISTINCT * FROM entities),
lnk AS (SELECT DISTINCT replace(lower(linkage), '_', '-') AS linkage, bit >> 32 AS concept_id, bit & 4294967295 AS entity_id FROM bitmap_fragments
        WHERE (bit & 4294967295) IN (SELECT id FROM ent) AND (bit >> 32) IN (SELECT id FROM ent)),
con AS (SELECT id AS concept_id, name, canonical_name, coalesce(noise, 0) AS noise FROM ent WHERE kind = 'concept')
"""


def _named(name: str) -> str:
    return f"SELECT concept_id FROM con WHERE name = '{name}' OR canonical_name = '{name}'"


def _set(name: str, linkage: str | None = None) -> str:
    return f"SELECT entity_id FROM lnk WHERE concept_id IN ({_named(name)})" + (f" AND linkage = '{linkage}'" if linkage else "")


def _query(text: str, **options):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return dsl.run(store_graph(spark, sf_dir), text, **options)

    run.__doc__ = text
    return run


def _on_graph(f):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return f(store_graph(spark, sf_dir))

    return run


def co_occurrence_all(graph: Graph) -> DataFrame:
    return dsl.co_occurrence(graph, A)


def union_star_all(graph: Graph) -> DataFrame:
    """Links with both ends' names (star lookup), under every verb."""
    e = graph.entities.select(F.col("id").alias("entity_id"), F.col("name").alias("entity"), "kind")
    return graph.links.join(e, "entity_id").join(
        graph.concepts().select("concept_id", F.col("name").alias("concept")), "concept_id"
    ).select("linkage", "entity", "concept", "kind")


def union_star(graph: Graph) -> DataFrame:
    """The same for the links of specifies."""
    return union_star_all(graph).filter("linkage = 'specifies'").drop("linkage")


def zero_link_concepts(graph: Graph) -> DataFrame:
    return graph.concepts().select("concept_id").join(graph.links.select("concept_id"), "concept_id", "left_anti")


def linked_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memories with a body and a link (semi join)."""
    bodies = read(spark, sf_dir, "memory_content").filter("content != ''").select("entity_id").distinct()
    return bodies.join(store_graph(spark, sf_dir).links, "entity_id", "left_semi")


def memory_sidecar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memory entities with their type, if they have a body (left join)."""
    e = read(spark, sf_dir, "entities").distinct().filter("kind = 'memory'").select("id", "name")
    m = read(spark, sf_dir, "memory_content").distinct().select(F.col("entity_id").alias("id"), "mtype")
    return e.join(m, "id", "left")


def siblings(graph: Graph) -> DataFrame:
    """Entities that share a (linkage, concept) with an entity named after a concept, and how many."""
    anchor = graph.entities.filter(F.col("name").contains("/") & (F.col("kind") == "doc")).agg(F.min("id").alias("anchor"))
    own = graph.links.join(F.broadcast(anchor), F.col("entity_id") == F.col("anchor")).select("linkage", "concept_id", "anchor")
    return graph.links.join(own, ["linkage", "concept_id"]).filter("entity_id != anchor").groupBy("entity_id").agg(F.count(F.lit(1)).alias("shared"))


def called_by(graph: Graph) -> DataFrame:
    """Inverse of calls through the definitions: which entities call into which, through a concept."""
    calls = graph.links.filter("linkage = 'calls'").select("concept_id", F.col("entity_id").alias("caller"))
    defines = graph.links.filter("linkage = 'defines'").select("concept_id", F.col("entity_id").alias("callee"))
    return calls.join(defines, "concept_id").filter("caller != callee").select("caller", "callee").distinct()


def canon_siblings(graph: Graph) -> DataFrame:
    """Every entity that is the same as others in another partition, through a canonical concept: how many those are, and the hub's smallest
    entity, which stands for it.

    Pairs aren't written out, as a hub may have any number of members; ``siblings_of`` gives the siblings of chosen entities.
    """
    same = canon_members(graph)
    here = same.groupBy("concept_id", "partition_id").agg(F.count(F.lit(1)).alias("own"))
    hub = here.groupBy("concept_id").agg(F.sum("own").alias("members"))
    least = same.groupBy("concept_id").agg(F.min("entity_id").alias("representative"))
    rows = same.join(here, ["concept_id", "partition_id"]).join(hub, "concept_id").join(least, "concept_id")
    return rows.withColumn("siblings", F.col("members") - F.col("own")).filter("siblings > 0").select(
        "concept_id", "entity_id", "siblings", "representative"
    )


def siblings_of(graph: Graph, chosen: DataFrame) -> DataFrame:
    """(entity_id, sibling): all siblings, in other partitions, of the chosen entities (entity_id)."""
    same = canon_members(graph)
    own = same.join(chosen.select("entity_id").distinct(), "entity_id", "left_semi")
    other = same.select("concept_id", F.col("entity_id").alias("sibling"), F.col("partition_id").alias("there"))
    return own.join(other, "concept_id").filter("partition_id != there").select("entity_id", "sibling").distinct()


def siblings_of_noted(graph: Graph) -> DataFrame:
    """The siblings of the entities that reinforce a concept."""
    return siblings_of(graph, graph.links.filter("linkage = 'reinforces'").select("entity_id"))


def canon_members(graph: Graph) -> DataFrame:
    """Every entity of every canonical concept, with its partition: entities of one concept are siblings, whatever the size of the hub."""
    same = graph.links.filter("linkage = 'same-as'").select("concept_id", "entity_id")
    return same.join(
        graph.entities.select(F.col("id").alias("entity_id"), "partition_id"), "entity_id"
    ).select("concept_id", "entity_id", "partition_id")


def canon_hubs(graph: Graph) -> DataFrame:
    same = graph.links.filter("linkage = 'same-as'").join(graph.entities.select(F.col("id").alias("entity_id"), "partition_id"), "entity_id")
    return same.groupBy("concept_id").agg(F.count(F.lit(1)).alias("variants"), F.countDistinct("partition_id").alias("partitions"))


def classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For a merge of partition 2 into 1: which (kind, name) of the source collide with the target and which only change parent."""
    e = read(spark, sf_dir, "entities").distinct().filter("name IS NOT NULL")
    src = e.filter("partition_id = 2").groupBy("kind", "name").agg(F.min("id").alias("src_id"))
    dst = e.filter("partition_id = 1").groupBy("kind", "name").agg(F.min("id").alias("dst_id"))
    return src.join(dst, ["kind", "name"], "left").select(
        "src_id", "dst_id", F.when(F.col("dst_id").isNull(), "reparent").otherwise("collide").alias("action")
    )


def path_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of documents by their whole path, and the entities whose own path is its end: the last parts are joined, then the suffix is tested."""
    tail = lambda c: F.element_at(F.split(c, "/"), -1)
    e = read(spark, sf_dir, "entities").distinct().filter("path != ''").withColumn("file", tail(F.col("path")))
    roots = read(spark, sf_dir, "partitions").select(F.col("id").alias("partition_id"), "root_path")
    files = e.filter("kind = 'doc'").join(roots, "partition_id").select("file", F.concat_ws("/", "root_path", "path").alias("whole")).distinct()
    found = files.join(e.select("id", "file", "path"), "file").filter(F.col("whole").endswith(F.concat(F.lit("/"), "path")))
    return found.groupBy("whole").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))


QUERIES = {
    "row": _query(f"mentions:{A}"),
    "bare_term": _query(B),
    "and": _query(f"mentions:{A} AND tagged:{C}"),
    "or": _query(f"mentions:{A} OR defines:{B}"),
    "and_not": _query(f"mentions:{A} AND NOT mentions:{B}"),
    "not": _query(f"NOT {A}"),
    "difference": _query(f"Difference(Row(mentions, {A}), Row(tagged, {C}))", functional=True),
    "xor": _query(f"Xor(Row(mentions, {A}), Row(mentions, {B}))", functional=True),
    "count": _query(f"Count(Union(Row(mentions, {A}), Row(mentions, {B})))", functional=True),
    "topn": _query(f"TopN(Union(Row(mentions, {A}), Row(mentions, {B})), n=25)", functional=True),
    "nested_sets": _query(f"({A} OR {B}) AND NOT (tagged:{C} OR defines:{A})"),
    "name_like": _query(f"{A} OR {B}", name_like="notes/%", limit=50),
    "neighbors_d1": _query(f"Neighbors({A})", functional=True),
    "neighbors_d2": _query(f"Neighbors({A}, depth=2)", functional=True),
    "co_occurrence": _on_graph(co_occurrence_all),
    "star_lookup": _on_graph(union_star),
    "star_lookup_all": _on_graph(union_star_all),
    "zero_link_concepts": _on_graph(zero_link_concepts),
    "linked_memories": linked_memories,
    "memory_sidecar": memory_sidecar,
    "siblings": _on_graph(siblings),
    "called_by": _on_graph(called_by),
    "canon_siblings": _on_graph(canon_siblings),
    "siblings_of": _on_graph(siblings_of_noted),
    "canon_members": _on_graph(canon_members),
    "canon_hubs": _on_graph(canon_hubs),
    "partition_merge_classify": classify,
    "path_suffix": path_suffix,
}
_HOP = f"hop1 AS (SELECT DISTINCT entity_id FROM ({_set(A)}) WHERE entity_id NOT IN (SELECT id FROM ent WHERE noise = 1))"
ORACLE = {
    "row": STORE + f"SELECT DISTINCT entity_id FROM ({_set(A, 'mentions')})",
    "bare_term": STORE + f"SELECT DISTINCT entity_id FROM ({_set(B)})",
    "and": STORE + f"{_set(A, 'mentions')} INTERSECT {_set(C, 'tagged')}",
    "or": STORE + f"{_set(A, 'mentions')} UNION {_set(B, 'defines')}",
    "and_not": STORE + f"{_set(A, 'mentions')} EXCEPT {_set(B, 'mentions')}",
    "not": STORE + f"SELECT id AS entity_id FROM ent EXCEPT {_set(A)}",
    "difference": STORE + f"{_set(A, 'mentions')} EXCEPT {_set(C, 'tagged')}",
    "xor": STORE + f"(({_set(A, 'mentions')}) UNION ({_set(B, 'mentions')})) EXCEPT (({_set(A, 'mentions')}) INTERSECT ({_set(B, 'mentions')}))",
    "count": STORE + f"SELECT count(*) AS n FROM ({_set(A, 'mentions')} UNION {_set(B, 'mentions')})",
    "topn": STORE
    + f"SELECT entity_id, count(*) AS weight FROM lnk WHERE entity_id IN ({_set(A, 'mentions')} UNION {_set(B, 'mentions')}) AND concept_id IN (SELECT concept_id FROM con WHERE noise = 0) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25",
    "nested_sets": STORE + f"({_set(A)} UNION {_set(B)}) EXCEPT ({_set(C, 'tagged')} UNION {_set(A, 'defines')})",
    "name_like": STORE
    + f"SELECT DISTINCT entity_id FROM ({_set(A)} UNION {_set(B)}) WHERE entity_id IN (SELECT id FROM ent WHERE name LIKE 'notes/%') ORDER BY 1 LIMIT 50",
    "neighbors_d1": STORE + f", {_HOP} SELECT entity_id FROM hop1 EXCEPT {_named(A)}",
    "neighbors_d2": STORE
    + f", {_HOP}, hop2 AS (SELECT DISTINCT entity_id FROM lnk WHERE concept_id IN (SELECT entity_id FROM hop1) AND entity_id NOT IN (SELECT id FROM ent WHERE noise = 1)) (SELECT entity_id FROM hop1 UNION SELECT entity_id FROM hop2) EXCEPT {_named(A)}",
    "co_occurrence": STORE
    + f"SELECT concept_id, name, count(DISTINCT entity_id) AS overlap FROM lnk JOIN con USING (concept_id) WHERE linkage = 'mentions' AND noise = 0 AND entity_id IN ({_set(A, 'mentions')}) AND concept_id NOT IN ({_named(A)}) GROUP BY 1, 2",
    "star_lookup": STORE
    + "SELECT e.name AS entity, c.name AS concept, e.kind FROM lnk JOIN ent e ON e.id = entity_id JOIN con c USING (concept_id) WHERE linkage = 'specifies'",
    "star_lookup_all": STORE
    + "SELECT linkage, e.name AS entity, c.name AS concept, e.kind FROM lnk JOIN ent e ON e.id = entity_id JOIN con c USING (concept_id)",
    "zero_link_concepts": STORE + "SELECT concept_id FROM con WHERE concept_id NOT IN (SELECT concept_id FROM lnk)",
    "linked_memories": STORE + "SELECT DISTINCT entity_id FROM memory_content WHERE content <> '' AND entity_id IN (SELECT entity_id FROM lnk)",
    "memory_sidecar": STORE
    + "SELECT e.id, name, mtype FROM ent e LEFT JOIN (SELECT DISTINCT * FROM memory_content) m ON e.id = m.entity_id WHERE kind = 'memory'",
    "siblings": STORE
    + ", a AS (SELECT min(id) AS anchor FROM ent WHERE kind = 'doc' AND name LIKE '%/%') SELECT l.entity_id, count(*) AS shared FROM lnk l JOIN lnk o ON l.linkage = o.linkage AND l.concept_id = o.concept_id JOIN a ON o.entity_id = anchor WHERE l.entity_id <> anchor GROUP BY 1",
    "called_by": STORE
    + "SELECT DISTINCT a.entity_id AS caller, b.entity_id AS callee FROM lnk a JOIN lnk b USING (concept_id) WHERE a.linkage = 'calls' AND b.linkage = 'defines' AND a.entity_id <> b.entity_id",
    "canon_siblings": STORE
    + ", s AS (SELECT concept_id, entity_id, count(*) OVER (PARTITION BY concept_id) - count(*) OVER (PARTITION BY concept_id, partition_id) AS siblings, min(entity_id) OVER (PARTITION BY concept_id) AS representative FROM lnk JOIN ent ON id = entity_id WHERE linkage = 'same-as') SELECT * FROM s WHERE siblings > 0",
    "siblings_of": STORE
    + ", s AS (SELECT concept_id, entity_id, partition_id FROM lnk JOIN ent ON id = entity_id WHERE linkage = 'same-as') SELECT DISTINCT x.entity_id, y.entity_id AS sibling FROM s x JOIN s y USING (concept_id) WHERE x.partition_id <> y.partition_id AND x.entity_id IN (SELECT entity_id FROM lnk WHERE linkage = 'reinforces')",
    "canon_members": STORE + "SELECT concept_id, entity_id, partition_id FROM lnk JOIN ent ON id = entity_id WHERE linkage = 'same-as'",
    "canon_hubs": STORE
    + "SELECT concept_id, count(*) AS variants, count(DISTINCT partition_id) AS partitions FROM lnk JOIN ent ON id = entity_id WHERE linkage = 'same-as' GROUP BY 1",
    "partition_merge_classify": "WITH ent AS (SELECT DISTINCT * FROM entities WHERE name IS NOT NULL), s AS (SELECT kind, name, min(id) AS src_id FROM ent WHERE partition_id = 2 GROUP BY 1, 2), d AS (SELECT kind, name, min(id) AS dst_id FROM ent WHERE partition_id = 1 GROUP BY 1, 2) SELECT src_id, dst_id, CASE WHEN dst_id IS NULL THEN 'reparent' ELSE 'collide' END AS action FROM s LEFT JOIN d USING (kind, name)",
    "path_suffix": "WITH e AS (SELECT DISTINCT * FROM entities WHERE path <> ''), f AS (SELECT DISTINCT root_path || '/' || path AS whole FROM e JOIN partitions p ON p.id = e.partition_id WHERE e.kind = 'doc') "
    "SELECT whole, count(*) AS n, min(id) AS first FROM f JOIN e ON string_split(whole, '/')[-1] = string_split(path, '/')[-1] AND ends_with(whole, '/' || path) GROUP BY 1",
}
