"""The verb surface: every operation of the store under one name, with its actions and parameters.

``Store`` holds the tables; ``call`` runs a verb on it. Reading verbs return DataFrames; writing verbs return a new Store, as tables are immutable
here, and
``save`` writes one as Parquet. ``schema`` describes the verbs as JSON for tools.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.graph import Graph, read, store_graph
from threadloom.operators import analytics, context, dsl, embed, evidence, mutate, rank, reports, upkeep, vectors, walks
from threadloom.sources import files, ingest, sessions

VERBS: dict[str, Callable] = {}


@dataclass(frozen=True)
class Store:
    graph: Graph
    memories: DataFrame
    partitions: DataFrame | None = None
    log: DataFrame | None = None
    messages: DataFrame | None = None
    cursors: DataFrame | None = None
    vectors: DataFrame | None = None
    queries: dict[str, str] = field(default_factory=dict)


def open_store(spark: SparkSession, folder: str) -> Store:
    return Store(
        store_graph(spark, folder), read(spark, folder, "memory_content").distinct(), read(spark, folder, "partitions"),
        read(spark, folder, "query_log")
    )


def save(store: Store, folder: str) -> None:
    store.graph.entities.write.mode("overwrite").parquet(f"{folder}/entities.parquet")
    store.graph.links.repartition("linkage").write.mode("overwrite").partitionBy("linkage").parquet(f"{folder}/links.parquet")
    store.memories.write.mode("overwrite").parquet(f"{folder}/memory_content.parquet")


def verb(f: Callable) -> Callable:
    VERBS[f.__name__] = f
    return f


def schema() -> list[dict]:
    """Name, description and parameters of each verb."""
    kinds = {int: "integer", float: "number", str: "string", bool: "boolean", list: "array"}
    out = []
    for name, f in sorted(VERBS.items()):
        params = list(inspect.signature(f).parameters.values())[1:]
        props = {p.name: {"type": kinds.get(type(p.default), "string")} for p in params}
        out.append(
            {
                "name": name, "description": (f.__doc__ or "").strip(),
                "inputSchema": {"type": "object", "properties": props, "required": [p.name for p in params if p.default is inspect.Parameter.empty]}
            }
        )
    return out


def call(store: Store, verb_name: str, /, **arguments):
    if verb_name not in VERBS:
        raise ValueError(f"unknown verb {verb_name}")
    return VERBS[verb_name](store, **arguments)


def _action(table: dict[str, Callable], action: str):
    if action not in table:
        raise ValueError(f"unknown action {action}; known are {', '.join(sorted(table))}")
    return table[action]


@verb
def query(store: Store, expression: str, functional: bool = False, name_like: str | None = None, limit: int | None = None) -> DataFrame:
    """Set algebra in the infix or the functional language."""
    return dsl.run(store.graph, expression, functional, name_like, limit)


@verb
def run_saved(store: Store, name: str) -> DataFrame:
    """A saved query."""
    return dsl.run(store.graph, store.queries[name])


@verb
def save_query(store: Store, name: str, expression: str) -> Store:
    """Keep an infix query under a name; it must parse."""
    dsl.parse_infix(expression)
    return replace(store, queries={**store.queries, name: expression})


@verb
def context_of(store: Store, ref: str, most_tokens: int = 2000, degree: int = 0) -> DataFrame:
    """Context of a concept within a token budget, from degree 1 on with what a walk visits."""
    return context.build_context(store.graph, ref, degree=degree, most_tokens=most_tokens)


@verb
def describe(store: Store, ref: str) -> DataFrame:
    """Everything known about an entity."""
    return context.describe(store.graph, ref, store.memories)


@verb
def scan_prompt(store: Store, text: str, k: int = 5) -> DataFrame:
    """Concepts that a prompt names and that are worth showing."""
    return context.scan(store.graph, store.memories.sparkSession.createDataFrame([(0, text)], "prompt int, text string"), k=k)


@verb
def locate(store: Store, name: str) -> DataFrame:
    """Where a name is defined or stored."""
    return context.locate(store.graph, name)


@verb
def search(store: Store, text: str, limit: int = 50) -> DataFrame:
    """Memories whose name or body holds a text, newest first."""
    m = store.graph.entities.filter("kind = 'memory'").select(F.col("id").alias("entity_id"), "name").join(store.memories, "entity_id", "left")
    return m.filter(
        F.lower(F.concat_ws("\n", "name", "content")).contains(text.lower())
    ).orderBy(F.desc_nulls_last("created_at"), "entity_id").limit(limit)


@verb
def graph(store: Store, action: str, name: str = "", depth: int = 1, k: int = 10, linkage: str = "mentions") -> DataFrame:
    """neighbors, co_occur, top, related, visited, stats, footprint, timeline, pagerank, net, assoc. ``related`` solves the walk, ``visited``
    pushes it; a timeline shows when the entities around a name changed."""
    g = store.graph
    seeds = lambda: dsl.resolve(g, [name]).select("concept_id")
    return _action(
        {
            "neighbors": lambda: dsl.neighbors(g, seeds(), depth),
            "co_occur": lambda: dsl.co_occurrence(g, name, linkage).orderBy(F.desc("overlap"), "name", "concept_id").limit(k),
            "top": lambda: analytics.concept_density(g.links).orderBy(F.desc("total"), "concept_id").limit(k),
            "related": lambda: walks.pagerank(
                walks.adjacency(g.links), 20, restart=seeds().select(F.col("concept_id").alias("id"), F.lit(1.0).alias("weight"))
            ).orderBy(F.desc("score"), "id").limit(k),
            "visited": lambda: walks.related(g.links, g.entities, [r[0] for r in seeds().distinct().collect()], k),
            "timeline": lambda: context.timeline(
                walks.footprint(g.links, seeds(), depth - 1), g.entities,
                g.entities.filter("path != ''").select(F.col("updated_at").alias("ts"), F.col("kind").alias("what"), "path")
            ),
            "stats": lambda: analytics.store_stats(g.entities, g.links),
            "footprint": lambda: walks.footprint(g.links, seeds(), depth),
            "pagerank": lambda: walks.pagerank(walks.adjacency(g.links)).orderBy(F.desc("score"), "id").limit(k),
            "net": lambda: walks.corroborated(walks.adjacency(g.links), seeds().withColumnRenamed("concept_id", "id")),
            "assoc": lambda: walks.lift(g.links, seeds()).orderBy(F.desc("lift"), F.desc("co"), "concept_id").limit(k),
        },
        action,
    )()


@verb
def memory(
    store: Store, action: str, ids: list | None = None, mtype: str = "", glob: str = "*", tags: list | None = None, any_of: bool = False,
    now: float = 0.0, seconds: float = 0.0, limit: int = 50,
    batch: DataFrame | None = None, concept: str = "", linkage: str = "related-to", weight: float | None = None, partition: int = 1,
    dry_run: bool = True,
):
    """get, list, recent, facets, by_tag, without_type, subjects, corpus, add, link, score, promote, retag, reclassify, forget, bulk_forget,
    dedup, brief.

    ``add`` takes a batch (partition_id, name, content, mtype, tags, metadata, now, seq); ``link`` ties memories to a concept; ``score`` says how
    far a concept is reinforced;
    ``promote`` copies memories, tagged ``behavior``, into another partition; ``bulk_forget`` goes by globs of type and name and lists them unless
    dry_run is off.
    """
    m, g = store.memories, store.graph
    ids, tags = ids or [], tags or []
    chosen = m.filter(F.col("entity_id").isin(ids))

    def changed(graph: Graph, bodies: DataFrame) -> Store:
        return replace(store, graph=graph, memories=bodies)

    def link() -> Store:
        at = dsl.resolve(g, [concept]).select("concept_id").distinct().withColumn("one", F.lit(1))
        links = chosen.select(F.lit(linkage).alias("linkage"), "entity_id", F.lit(1).alias("one")).join(at, "one").select(
            "linkage", "concept_id", "entity_id", F.lit(weight).cast("double").alias("weight"), F.lit(0).cast("long").alias("seq")
        )
        return replace(store, graph=replace(g, links=mutate.merge_links(g.links, links, "update")))

    def score() -> DataFrame:
        at = dsl.resolve(g, [concept]).select("concept_id").distinct()
        return analytics.reinforcement(g.links.join(at, "concept_id", "left_semi"), g.entities, now)

    def promote() -> Store:
        names = g.entities.select(F.col("id").alias("entity_id"), "name")
        tagged = mutate.retag(chosen, chosen, ["behavior"]).join(names, "entity_id")
        given = tagged.select(
            F.lit(partition).alias("partition_id"), "name", "content", "mtype", "tags", "metadata", F.lit(now).alias("now"),
            F.col("entity_id").alias("seq")
        )
        return changed(*upkeep.add_memories(g, m, given))

    def bulk_forget():
        selector = {"name": glob, "mtype": mtype or "*", "tag": tags[0] if tags else None, "older_than": now or None}
        return upkeep.forgettable(g, m, **selector) if dry_run else changed(*upkeep.bulk_forget(g, m, **selector))

    named = lambda: m.join(g.entities.select(F.col("id").alias("entity_id"), "name"), "entity_id")
    return _action(
        {
            "get": lambda: chosen,
            "list": lambda: m.orderBy(F.desc_nulls_last("updated_at"), "entity_id").limit(limit),
            "recent": lambda: analytics.recent(m, now, seconds, limit),
            "facets": lambda: analytics.facets(m),
            "by_tag": lambda: analytics.tagged(m, tags, any_of),
            "without_type": lambda: analytics.without_types(m, [glob]),
            "subjects": lambda: analytics.subjects(g.entities, m, g.links),
            "corpus": lambda: named().filter(
                analytics.in_corpus(F.col("name"), F.col("mtype"), F.col("tags"), "pattern" if mtype == "pattern" else "memory")
            ),
            "add": lambda: changed(*upkeep.add_memories(g, m, batch)),
            "link": link,
            "score": score,
            "promote": promote,
            "retag": lambda: replace(store, memories=mutate.retag(m, chosen, add=tags)),
            "reclassify": lambda: replace(store, memories=mutate.reclassify(m, glob, mtype)),
            "forget": lambda: changed(*mutate.purge(g, g.entities.filter(F.col("id").isin(ids)), m)),
            "bulk_forget": bulk_forget,
            "dedup": lambda: replace(store, graph=mutate.fold_duplicates(g)),
            "brief": lambda: vectors.corroborated_concepts(g.links, g.entities),
        },
        action,
    )()


@verb
def grep(
    store: Store, pattern: str, regex: bool = False, ignore_case: bool = False, word: bool = False, root: str = "", limit: int = 100
) -> DataFrame:
    """Evidence of concepts that a pattern names; with a root, checked against the lines of the files there."""
    g = store.graph
    if g.evidence is None:
        raise ValueError("the store has no evidence")
    named = g.evidence.join(
        g.entities.select(F.col("id").alias("entity_id"), F.col("name").alias("entity"), "kind"), "entity_id"
    ).withColumnRenamed("file", "path")
    lines = files.lines_of(files.tree(store.memories.sparkSession, root)) if root else None
    return evidence.grep_evidence(named, g.concepts(), lines, pattern, regex, ignore_case, word, limit=limit)


@verb
def ingest_folder(store: Store, root: str, source: str = "auto", partition: int = 1, now: float = 0.0) -> Store:
    """The store with a folder's entities, links and evidence added."""
    new = ingest.ingest(store.memories.sparkSession, root, source, partition_id=partition, now=now)[0]
    g = store.graph
    known = g.entities.select("id")
    found = new.entities.join(known, "id", "left_anti").select(*g.entities.columns)
    proof = new.evidence if g.evidence is None else g.evidence.unionByName(new.evidence).distinct()
    links = mutate.merge_links(g.links, new.links.withColumn("seq", F.lit(0).cast("long")), "update")
    return replace(store, graph=Graph(g.entities.unionByName(found), links, proof))


@verb
def embed_pending(store: Store) -> Store:
    """The store with vectors for all entities whose vector is missing or older than they are, by the encoder that needs no model."""
    due = mutate.pending_vectors(store.graph.entities)
    made = embed.embed(embed.entity_texts(store.graph.entities.join(due, "id", "left_semi"), store.memories))
    old = store.vectors
    return replace(store, vectors=made if old is None else old.join(made.select("id"), "id", "left_anti").select("id", "vector").unionByName(made))


@verb
def session(store: Store, action: str, folder: str = "", ref: str = "", text: str = "", k: int = 10) -> DataFrame:
    """list, recall, show, stats of the transcripts in a folder."""
    rows = sessions.transcript(store.memories.sparkSession, folder)
    cards = sessions.session_cards(rows)
    return _action(
        {
            "list": lambda: reports.list_sessions(cards, 0, k), "recall": lambda: reports.recall_sessions(cards, text, k=k),
            "show": lambda: reports.show_session(cards, ref), "stats": lambda: sessions.tree_stats(rows)
        },
        action
    )()


@verb
def where(store: Store, name: str) -> DataFrame:
    """Where a name is found over all partitions: definitions, entities and memories that hold it."""
    found = context.locate(store.graph, name).select("entity_id", "name", "kind", "partition_id")
    held = search(store, name).select("entity_id").join(
        store.graph.entities.select(F.col("id").alias("entity_id"), "name", "kind", "partition_id"), "entity_id"
    )
    return found.unionByName(held.select("entity_id", "name", "kind", "partition_id")).distinct()


@verb
def projects(store: Store) -> DataFrame:
    """The partitions with what they hold."""
    held = store.graph.entities.groupBy(F.col("partition_id").alias("id")).agg(F.count(F.lit(1)).alias("entities"))
    return store.partitions.join(held, "id", "left").select("id", "name", "kind", "root_path", F.coalesce("entities", F.lit(0)).alias("entities"))


@verb
def taxonomy(store: Store, allowed: list) -> DataFrame:
    """Memories with tags that a taxonomy doesn't list."""
    from threadloom.functions.text import unknown_tags

    return store.memories.select(
        "entity_id", unknown_tags(F.from_json("tags", "array<string>"), allowed).alias("unknown")
    ).filter(F.size("unknown") > 0)


@verb
def publish(store: Store, channel: str, sender: str, value: str = "", ts: str = "") -> Store:
    """A message put on a channel, after all that are there."""
    m = store.messages
    last = m.agg(F.coalesce(F.max("seq"), F.lit(-1)).alias("last"))
    given = {
        "seq": F.col("last") + 1, "channel": F.lit(channel), "sender": F.lit(sender), "ts": F.lit(ts or None), "value": F.lit(value),
        "status": F.lit("active")
    }
    return replace(store, messages=m.unionByName(last.select(*[given.get(c, F.lit(None)).cast(m.schema[c].dataType).alias(c) for c in m.columns])))


@verb
def matrix(store: Store, action: str, batch: DataFrame | None = None, policy: str = "first", kind: str | None = None):
    """link, unlink, add_entities, list_entities, list_linkages, list_queries."""
    g = store.graph
    return _action(
        {
            "link": lambda: replace(store, graph=replace(g, links=mutate.merge_links(g.links, batch, policy))),
            "unlink": lambda: replace(store, graph=replace(g, links=mutate.unlink(g.links, batch))),
            "add_entities": lambda: replace(store, graph=replace(g, entities=mutate.upsert_entities(g.entities, batch))),
            "list_entities": lambda: analytics.select_entities(g.entities, kind=kind),
            "list_linkages": lambda: g.links.select("linkage").distinct(),
            "list_queries": lambda: store.memories.sparkSession.createDataFrame(sorted(store.queries.items()), "name string, body string"),
        },
        action,
    )()


@verb
def curate(store: Store, action: str, like: str = "", kind: str | None = None, ns: str | None = None, dry_run: bool = True):
    """protect, unprotect, noise, unnoise, forget of the entities that a selector finds; a dry run lists them."""
    g = store.graph
    chosen = analytics.select_entities(g.entities, like=like or None, kind=kind, ns=ns)
    if dry_run:
        return chosen.select("id", "kind", "name")
    flags = {"protect": ("protected", 1), "unprotect": ("protected", 0), "noise": ("noise", 1), "unnoise": ("noise", 0)}
    if action in flags:
        return replace(store, graph=replace(g, entities=mutate.set_flag(g.entities, chosen, *flags[action])))
    if action == "forget":
        kept, bodies = mutate.purge(g, chosen, store.memories)
        return replace(store, graph=kept, memories=bodies)
    raise ValueError(f"unknown action {action}")


@verb
def canon(store: Store, action: str, name: str = "") -> DataFrame:
    """find, siblings: canonical concepts of a name, and what is the same in other partitions."""
    ids = dsl.resolve(store.graph, [name])
    same = store.graph.links.filter(F.translate("linkage", "_", "-") == "same-as")
    hubs = same.join(
        ids.select(F.col("concept_id").alias("entity_id")), "entity_id", "left_semi"
    ).select("concept_id").union(ids.select("concept_id")).distinct()
    return _action({"find": lambda: ids, "siblings": lambda: same.join(hubs, "concept_id", "left_semi").select("entity_id").distinct()}, action)()


@verb
def maintain(store: Store, action: str, src: int = 0, dst: int = 0, old: str = "", new: str = "", folder: str = "", version: int = 1):
    """vacuum, prune_noise, merge_partitions, rename_partition, snapshot, drop_vectors, audit, counts, pending_vectors, called_by."""
    g = store.graph

    def prune() -> Store:
        marks = analytics.noise_marks(g.entities, g.links).select(F.col("concept_id").alias("id"), F.col("noise").alias("_n"))
        e = g.entities.join(marks, "id", "left").withColumn("noise", F.coalesce("_n", "noise")).select(*g.entities.columns)
        return replace(store, graph=replace(g, entities=e))

    def merge() -> Store:
        merged, bodies = mutate.merge_partitions(g, store.memories, src, dst)
        return replace(store, graph=merged, memories=bodies)

    return _action(
        {
            "vacuum": lambda: replace(store, graph=mutate.vacuum(g)),
            "prune_noise": prune,
            "merge_partitions": merge,
            "rename_partition": lambda: replace(store, partitions=upkeep.rename_partition(store.partitions, old, new)),
            "snapshot": lambda: upkeep.snapshot({"entities": g.entities, "links": g.links, "memory_content": store.memories}, folder, version),
            "drop_vectors": lambda: replace(
                store, vectors=upkeep.drop_vectors(store.vectors, g.entities)[0],
                graph=replace(g, entities=upkeep.drop_vectors(store.vectors, g.entities)[1])
            ),
            "audit": lambda: analytics.partition_audit(g.entities, g.links, store.partitions),
            "counts": lambda: analytics.structural_counts(g.entities, g.links, store.memories),
            "pending_vectors": lambda: mutate.pending_vectors(g.entities),
            "called_by": lambda: mutate.derive_called_by(g.links),
        },
        action,
    )()


@verb
def telemetry(store: Store, action: str, dimension: str = "kind", k: int = 20) -> DataFrame:
    """summary, top, zero, adoption of the query log."""
    return _action(
        {
            "summary": lambda: analytics.telemetry_summary(store.log, dimension),
            "top": lambda: analytics.top_queries(store.log, k=k),
            "zero": lambda: analytics.top_queries(store.log, True, k),
            "adoption": lambda: analytics.adoption(store.log.withColumn("command", F.col("source")), ["root"]),
        },
        action,
    )()


@verb
def bus(store: Store, action: str, agent: str = "", pattern: str = "*", n: int = 50, channel: str = "", before: str = ""):
    """channels, unread, read, archive, delete, unarchive, purge."""
    m, c = store.messages, store.cursors

    def read_on():
        got, moved = analytics.read_channel(m, c, agent, pattern, n)
        kept = c.join(moved.select("agent", "channel"), ["agent", "channel"], "left_anti").unionByName(moved)
        return got, replace(store, cursors=kept)

    status = lambda s: replace(store, messages=analytics.retired(m, channel, F.lit(before).cast(m.schema["ts"].dataType), s))
    return _action(
        {
            "channels": lambda: analytics.channel_stats(m), "unread": lambda: analytics.unread(m, c), "read": read_on,
            "archive": lambda: status("archived"), "delete": lambda: status("deleted"), "unarchive": lambda: status("active"),
            "purge": lambda: replace(store, messages=analytics.purged(m)),
        },
        action,
    )()


@verb
def recall(store: Store, terms: str, k: int = 10) -> DataFrame:
    """Entities ranked by a bag of words over the mention links."""
    from threadloom.functions.names import content_terms_text

    words = content_terms_text(terms)
    ids = dsl.resolve(store.graph, words)
    spark = store.memories.sparkSession
    numbered = ids.join(
        F.broadcast(spark.createDataFrame(list(enumerate(words)), "n int, word string")), F.col("term") == F.col("word")
    ).select(F.col("n").alias("term"), "concept_id")
    return rank.content_rank(store.graph.links, numbered, len(words), limit=k, null_tf=1.0)


@verb
def nearest(store: Store, vector: list, k: int = 10) -> DataFrame:
    """Entities whose vectors are nearest to one."""
    return vectors.nearest(store.vectors, vector, k)
