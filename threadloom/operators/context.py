"""Compositions: what is known about an entity, context for a reference, scanning a prompt, federated search."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadloom.functions.names import CANDIDATE, canonicalize, canonicalize_text, shape_score
from threadloom.graph import Graph
from threadloom.operators import analytics, dsl, rank, walks
from threadloom.staging import stage

# The order in which links read like a definition.
LINKAGE_ORDER = ["defines", "implements", "called_by", "imports", "calls", "is_a", "related-to", "mentions"]
SALIENCE_FLOOR = 1.55


def find_entity(entities: DataFrame, ref: str) -> DataFrame:
    """(id, step): the entity that a reference means, by the first step that finds one: id, path, name, suffix of path or name, part of the name.
    Of several, the smallest id."""
    name, path = F.col("name"), F.col("path")
    steps = [
        F.col("id").cast("string") == ref, path == ref, name == ref, path.endswith("/" + ref) | name.endswith("/" + ref),
        F.lower(name).contains(ref.lower())
    ]
    step = F.coalesce(*[F.when(s, F.lit(i)) for i, s in enumerate(steps)])
    return entities.select("id", step.alias("step")).filter("step IS NOT NULL").orderBy("step", "id").limit(1)


def describe(graph: Graph, ref: str, memories: DataFrame | None = None, ranks: DataFrame | None = None) -> DataFrame:
    """(section, linkage, other, name, detail): outbound and inbound links, evidence, entities of the same path, body and rank of one entity."""
    me = find_entity(graph.entities, ref).select(F.col("id").alias("me"))
    names = graph.entities.select(F.col("id").alias("other"), "name")
    sect = lambda df, s: df.select(F.lit(s).alias("section"), "linkage", "other", "detail")
    weight = F.col("weight").cast("string").alias("detail")
    parts = [
        sect(
            graph.links.join(F.broadcast(me), F.col("entity_id") == F.col("me")).select("linkage", F.col("concept_id").alias("other"), weight),
            "outbound"
        ),
        sect(
            graph.links.join(F.broadcast(me), F.col("concept_id") == F.col("me")).select("linkage", F.col("entity_id").alias("other"), weight),
            "inbound"
        ),
    ]
    own = graph.entities.join(F.broadcast(me), F.col("id") == F.col("me")).select("me", "path")
    same = graph.entities.filter("path IS NOT NULL").join(F.broadcast(own), "path").filter("id != me")
    parts.append(
        sect(same.select(F.lit(None).cast("string").alias("linkage"), F.col("id").alias("other"), F.col("path").alias("detail")), "same_path")
    )
    if graph.evidence is not None:
        parts.append(
            sect(
                graph.evidence.join(F.broadcast(me), F.col("entity_id") == F.col("me")).select(
                    "linkage", F.col("concept_id").alias("other"), F.concat_ws(":", "file", "line").alias("detail")
                ),
                "evidence"
            )
        )
    if memories is not None:
        parts.append(
            sect(
                memories.join(F.broadcast(me), F.col("entity_id") == F.col("me")).select(
                    F.lit(None).cast("string").alias("linkage"), F.col("entity_id").alias("other"), F.col("content").alias("detail")
                ),
                "body"
            )
        )
    if ranks is not None:
        parts.append(
            sect(
                ranks.join(F.broadcast(me), F.col("id") == F.col("me")).select(
                    F.lit(None).cast("string").alias("linkage"), F.col("id").alias("other"), F.col("score").cast("string").alias("detail")
                ),
                "rank"
            )
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.join(names, "other", "left").select("section", "linkage", "other", "name", "detail")


def context(
    graph: Graph, ref: str, ranked: DataFrame | None = None, per_linkage: int = 10, most_entities: int = 40, most_tokens: int = 2000,
    walk: DataFrame | None = None
) -> DataFrame:
    """(place, source, linkage, entity_id, name, kind, used): context of a concept within a budget of estimated tokens.

    Rows of the anchor's links come first, in the order of LINKAGE_ORDER and by weight, then what a content ranking (entity_id, score) and a walk
    (id, score) add; an
    entity comes once, where it came first. Filling stops at the first entry that overflows the budget.
    """
    anchors = dsl.resolve(graph, [ref])
    rows = rank.per_linkage_top(graph.links, anchors, per_linkage).select(
        F.lit(0).alias("source"), "linkage", "entity_id", F.coalesce("weight", F.lit(0.0)).alias("score")
    )
    if ranked is not None:
        rows = rows.unionByName(ranked.select(F.lit(1).alias("source"), F.lit("content").alias("linkage"), "entity_id", "score"))
    if walk is not None:
        rows = rows.unionByName(walk.select(F.lit(2).alias("source"), F.lit("walk").alias("linkage"), F.col("id").alias("entity_id"), "score"))
    place = F.array_position(F.array(*[F.lit(x) for x in LINKAGE_ORDER]), F.col("linkage"))
    rows = rows.withColumn("order", F.when(place > 0, place).otherwise(99))
    order = [F.col("source"), F.col("order"), F.col("linkage"), F.desc("score"), F.col("entity_id")]
    once = analytics.first_seen(rows, ["entity_id"], order)
    named = once.join(graph.entities.select(F.col("id").alias("entity_id"), "name", "kind", "tldr"), "entity_id")
    cost = F.floor(F.length(F.concat_ws(" ", "name", F.coalesce("tldr", F.lit("")))) / 4) + 4
    return analytics.budget_prefix(named, [], order, cost, most_tokens, most_entities).select(
        "place", "source", "linkage", "entity_id", "name", "kind", "used"
    )


def match_prompt(graph: Graph, prompts: DataFrame) -> DataFrame:
    """(prompt, token, concept_id, name, step): concepts that the identifiers of prompts (prompt, text) mean, by the first step that finds one:
    the name, its lower case, its canonical form, the leaf of a namespaced name."""
    tokens = prompts.select(
        "prompt", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)))).alias("token")
    ).filter(F.length("token") >= 3)
    c = graph.concepts().filter("noise = 0")
    keys = c.select("concept_id", "name", F.col("name").alias("key"), F.lit(0).alias("step"))
    keys = keys.unionByName(c.select("concept_id", "name", F.lower("name").alias("key"), F.lit(1).alias("step")))
    keys = keys.unionByName(
        c.select("concept_id", "name", F.coalesce("canonical_name", canonicalize(F.col("name"))).alias("key"), F.lit(2).alias("step"))
    )
    keys = keys.unionByName(
        c.filter(F.col("name").contains("/")).select(
            "concept_id", "name", F.element_at(F.split("name", "/"), -1).alias("key"), F.lit(3).alias("step")
        )
    )
    forms = tokens.select(
        "prompt", "token",
        F.explode(
            F.array_distinct(
                F.array(
                    *[
                        F.struct(k.alias("key"), F.lit(i).alias("at")) for i,
                        k in enumerate((F.col("token"), F.lower("token"), canonicalize(F.col("token")), F.col("token")))
                    ]
                )
            )
        ).alias("f")
    )
    hits = forms.select("prompt", "token", "f.key", "f.at").join(keys, "key").filter("at = step")
    return analytics.first_seen(
        hits, ["prompt", "token"], [F.col("step"), F.col("name"), F.col("concept_id")]
    ).select("prompt", "token", "concept_id", "name", "step")


def scan(graph: Graph, prompts: DataFrame, floor: float = SALIENCE_FLOOR, k: int = 5) -> DataFrame:
    """(prompt, place, token, concept_id, salience): the concepts of prompts worth showing, at most k for each."""
    found = match_prompt(graph, prompts)
    signals = graph.links.groupBy("concept_id").agg(
        F.count(F.lit(1)).alias("degree"), F.sum(F.when(F.col("linkage") == "mentions", 1).otherwise(0)).alias("df"),
        F.max(F.when(F.col("linkage") == "mentions", F.coalesce("weight", F.lit(1.0))).otherwise(0.0)).alias("max_tf")
    )
    n = graph.entities.filter("kind != 'concept'").agg(
        F.count(F.lit(1)).cast("double").alias("n_docs"), F.coalesce(F.avg((F.col("kind") == "code").cast("double")), F.lit(1.0)).alias("code")
    ).withColumn("one", F.lit(1))
    rows = found.join(signals, "concept_id", "left").na.fill(0, ["degree", "df", "max_tf"]).withColumn("one", F.lit(1)).join(F.broadcast(n), "one")
    value = rank.salience(
        F.col("name"), shape_score(F.col("token")), F.col("df"), F.col("max_tf"), F.lit(0.0), F.col("degree"), F.col("n_docs"), F.col("code")
    )
    rows = rows.withColumn("salience", value).filter(F.col("salience") >= floor)
    order = W.partitionBy("prompt").orderBy(F.desc(F.round("salience", 9)), "concept_id")
    return rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k).select(
        "prompt", "place", "token", "concept_id", "salience"
    )


def locate(graph: Graph, name: str) -> DataFrame:
    """(entity_id, name, kind, partition_id): where a name is defined or, as an entity, stored, over all partitions; each (kind, name, partition)
    once."""
    canon = canonicalize_text(name)
    ids = dsl.resolve(graph, [name]).select("concept_id")
    defined = graph.links.filter("linkage = 'defines'").join(ids, "concept_id", "left_semi").select(F.col("entity_id").alias("id"))
    stored = graph.entities.filter((F.col("name") == name) | (F.col("canonical_name") == canon)).select("id")
    rows = graph.entities.join(defined.union(stored).distinct(), "id").select(F.col("id").alias("entity_id"), "name", "kind", "partition_id")
    return analytics.first_seen(rows, ["kind", "name", "partition_id"], [F.col("entity_id")])


#: Restart and threshold of a walk by its degree: deeper ones restart less often and push further.
WALK_DEGREES = {1: (0.30, 2e-4), 2: (0.15, 1e-4), 3: (0.10, 5e-5)}


def walk_context(graph: Graph, seeds: Sequence[int] | dict[int, float], degree: int = 1) -> DataFrame:
    """(id, score): what a walk from the seeds, equal or with masses, visits."""
    alpha, epsilon = WALK_DEGREES[min(max(degree, 1), 3)]
    return walks.ppr_push(walks.adjacency(graph.links), seeds if isinstance(seeds, dict) else list(seeds), alpha, epsilon)


def parent(name: Column) -> Column:
    """The document that a section belongs to."""
    return F.substring_index(name, "#", 1)


def walk_entries(graph: Graph, walk: DataFrame, built: DataFrame, seeds: DataFrame, most: int) -> DataFrame:
    """(id, score): the ``most`` entities that a walk visits most, one for each document and none of a document that is there already.

    ``built`` has (entity_id, name), ``seeds`` (id). Concepts that are no sections are search terms, not places to go; cards of sessions are left out.
    """
    names = graph.entities.select("id", "name", "kind").dropDuplicates(["id"])
    rows = walk.join(names, "id").join(seeds.select("id").distinct(), "id", "left_anti").join(
        built.select(F.col("entity_id").alias("id")).distinct(), "id", "left_anti"
    )
    place = ~((F.col("kind") == "concept") & ~F.coalesce(F.col("name").contains("#"), F.lit(False)))
    rows = rows.filter(
        place & ~F.coalesce(F.col("name").rlike(walks.OPERATIONAL), F.lit(False))
    ).withColumn("parent", F.coalesce(parent(F.col("name")), F.col("id").cast("string")))
    rows = rows.join(built.select(parent(F.col("name")).alias("parent")).filter("parent IS NOT NULL").distinct(), "parent", "left_anti")
    once = rows.withColumn("_n", F.row_number().over(W.partitionBy("parent").orderBy(F.desc("score"), "id"))).filter("_n = 1")
    return once.orderBy(F.desc("score"), "id").limit(most).select("id", "score")


def build_context(
    graph: Graph, ref: str, ranked: DataFrame | None = None, degree: int = 0, walk_most: int = 5, per_linkage: int = 10, most_entities: int = 40,
    most_tokens: int = 2000
) -> DataFrame:
    """The whole context of a concept: its links, what a content ranking (entity_id, score) adds and, from degree 1 on, what a walk from the
    concept visits.

    The walk's entries make room for themselves: as many of the lowest content entries go as the number of entities would be exceeded by. Links
    never go.
    """
    walk = None
    if degree > 0:
        anchors = dsl.resolve(graph, [ref]).select(F.col("concept_id").alias("id")).distinct()
        ids = sorted(r[0] for r in anchors.collect())  # concepts of one name
        built = stage(context(graph, ref, ranked, per_linkage, 1_000_000, 1 << 40), "context")
        if ids:
            walk = stage(walk_entries(graph, walk_context(graph, ids, degree), built.select("entity_id", "name"), anchors, walk_most), "walk")
            kept = built.filter("source = 0").count() + walk.count()
            if ranked is not None:
                places = built.filter("source = 1").orderBy("place").limit(max(0, most_entities - kept)).select("entity_id")
                ranked = ranked.join(places, "entity_id", "left_semi")
    return context(graph, ref, ranked, per_linkage, most_entities, most_tokens, walk)


def graph_recall(symbolic: DataFrame | None, dense: DataFrame | None, k: int = 10) -> DataFrame:
    """(entity_id, score): both rankings fused; a symbolic one alone scores 1 - i / n by place, a dense one alone keeps its scores; without any,
    nothing is found."""
    if symbolic is not None and dense is not None:
        return rank.hybrid(symbolic, dense, k)
    if dense is not None:
        return dense.orderBy(F.desc("score"), "entity_id").limit(k)
    top = symbolic.orderBy(F.desc("score"), "entity_id").limit(k)
    everything = W.partitionBy(F.lit(1))
    return top.select(
        "entity_id",
        (1.0 - (F.row_number().over(everything.orderBy(F.desc("score"), "entity_id")) - 1) / F.count(F.lit(1)).over(everything)).alias("score")
    )


def federated(stores: dict[str, Graph], expression: str, limit: int = 100) -> DataFrame:
    """(project, entity_id, kind, name): one query over several stores; each (kind, name, project) comes once."""
    out = None
    for project, graph in stores.items():
        found = dsl.run(graph, expression).join(graph.entities.select(F.col("id").alias("entity_id"), "kind", "name"), "entity_id")
        part = found.select(F.lit(project).alias("project"), "entity_id", "kind", "name")
        out = part if out is None else out.unionByName(part)
    return analytics.first_seen(out, ["kind", "name", "project"], [F.col("entity_id")]).orderBy("project", "entity_id").limit(limit)


def timeline(footprint: DataFrame, entities: DataFrame, events: DataFrame) -> DataFrame:
    """(ts, what, path, hop): events (ts, what, path) of the files in a concept's footprint, in order; paths match whole or by their last parts."""
    paths = footprint.join(
        entities.select(F.col("id").alias("entity_id"), "path").filter("path IS NOT NULL"), "entity_id"
    ).select("hop", F.col("path").alias("own"), F.element_at(F.split("path", "/"), -1).alias("file"))
    seen = events.withColumn("file", F.element_at(F.split("path", "/"), -1)).join(paths, "file")
    hit = (F.col("path") == F.col("own")) | F.col("path").endswith(F.concat(F.lit("/"), "own")) | F.col("own").endswith(F.concat(F.lit("/"), "path"))
    return seen.filter(hit).groupBy("ts", "what", "path").agg(F.min("hop").alias("hop")).orderBy("ts", "path")


def topics(edges: DataFrame, members: DataFrame, k: int = 3) -> DataFrame:
    """(cluster, src, dst, weight): the k largest clusters (entity_id, cluster) as graphs of the edges within them."""
    largest = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "cluster").limit(k).select("cluster")
    own = members.join(largest, "cluster", "left_semi")
    a, b = own.select("cluster", F.col("entity_id").alias("src")), own.select(F.col("cluster").alias("c2"), F.col("entity_id").alias("dst"))
    return edges.join(a, "src").join(b, "dst").filter("cluster = c2").select("cluster", "src", "dst", "weight")


def as_of(touches: DataFrame, key: str, now: float, current: str) -> DataFrame:
    """(key, session, ts): the last touch of each key before now by another session."""
    rows = touches.filter((F.col("ts") <= now) & (F.col("session") != current))
    return rows.groupBy(key).agg(F.max_by("session", F.struct("ts", "session")).alias("session"), F.max("ts").alias("ts"))
