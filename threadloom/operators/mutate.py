"""Changes to the store as functions from tables to tables: upserts, links, deletions, merges, repairs, log export and replay."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadloom.functions.names import glob_pattern
from threadloom.graph import Graph
from threadloom.model import canonical_verb
from threadloom.operators.prefix_sum import running_totals

LINK_KEY = ["linkage", "concept_id", "entity_id"]


# --- entities -------------------------------------------------------------------------------------


def collapse_batch(batch: DataFrame, order: str = "seq") -> DataFrame:
    """One row per (partition_id, kind, name) of a batch: later non-null path, tldr and meta win, flags only rise, the first canonical name stays."""
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c)
    return batch.groupBy("partition_id", "kind", "name").agg(
        last("path"), last("tldr"), last("meta"), F.max(F.coalesce("protected", F.lit(0))).alias("protected"),
        F.min_by("canonical_name", F.when(F.col("canonical_name").isNotNull(), F.col(order))).alias("canonical_name"), F.max("now").alias("now")
    )


def upsert_entities(entities: DataFrame, batch: DataFrame) -> DataFrame:
    """Entities after a batch of (partition_id, kind, name, path, tldr, meta, protected, canonical_name, now, seq).

    Given values replace, nulls don't; protected only rises; the canonical name is set once; updated_at moves only where something changed. New
    rows get ids
    after the largest, in order of their keys.
    """
    new = collapse_batch(batch)
    key = ["partition_id", "kind", "name"]
    n = {c: F.col(f"b.{c}") for c in ("path", "tldr", "meta", "protected", "canonical_name", "now")}
    old = {c: F.col(f"e.{c}") for c in entities.columns}
    joined = entities.alias("e").join(new.alias("b"), key, "left")
    merged = {c: F.coalesce(n[c], old[c]) for c in ("path", "tldr", "meta")} | {
        "protected": F.greatest(F.coalesce(old["protected"], F.lit(0)), F.coalesce(n["protected"], F.lit(0))),
        "canonical_name": F.coalesce(old["canonical_name"], n["canonical_name"])
    }
    changed = F.lit(False)
    for c, v in merged.items():
        changed = changed | ~v.eqNullSafe(old[c])
    kept = joined.select(
        *[
            (
                merged[c] if c in merged else F.when(changed & n["now"].isNotNull(), n["now"]).otherwise(old[c]) if c == "updated_at" else F.col(c)
                if c in key else old[c]
            ).alias(c)
            for c in entities.columns
        ]
    )
    top = entities.agg(F.coalesce(F.max("id"), F.lit(-1)).alias("top")).withColumn("one", F.lit(1))
    fresh = new.join(entities.select(*key), key, "left_anti").withColumn("one", F.lit(1).cast("long"))
    fresh = running_totals(fresh, [], key, "one", total="_rank").join(F.broadcast(top), "one").withColumn("id", F.col("top") + F.col("_rank"))
    own = {"created_at": F.col("now"), "updated_at": F.col("now"), "noise": F.lit(0)}
    schema = entities.schema
    cols = [(own[c] if c in own else F.col(c) if c in fresh.columns else F.lit(None)).cast(schema[c].dataType).alias(c) for c in entities.columns]
    return kept.unionByName(fresh.select(*cols))


# --- links -----------------------------------------------------------------------------------------


def merge_links(links: DataFrame, batch: DataFrame, policy: str = "first") -> DataFrame:
    """Links after a batch of (linkage, concept_id, entity_id, weight, seq).

    ``first``: what is there stays, of the batch the first comes in. ``update``: the last non-null weight wins. ``ignore``: new links come in
    without a weight.
    """
    new = batch.withColumn("linkage", canonical_verb(F.col("linkage")))
    rows = links.select(*LINK_KEY, "weight", F.lit(-1).cast("long").alias("seq")).unionByName(
        new.select(*LINK_KEY, "weight", F.col("seq").cast("long").alias("seq"))
    )
    if policy == "update":
        weight = F.max_by("weight", F.when(F.col("weight").isNotNull(), F.col("seq")))
    elif policy == "ignore":
        weight = F.max(F.when(F.col("seq") < 0, F.col("weight")))
    else:
        weight = F.min_by("weight", "seq")
    return rows.groupBy(*LINK_KEY).agg(weight.alias("weight"))


def unlink(links: DataFrame, gone: DataFrame) -> DataFrame:
    return links.join(gone.select(*LINK_KEY).withColumn("linkage", canonical_verb(F.col("linkage"))), LINK_KEY, "left_anti")


def merge_verb(links: DataFrame, alias: str, verb: str) -> DataFrame:
    """Links with a verb renamed; where both spellings were there, the heavier weight stays."""
    renamed = links.withColumn("linkage", F.when(F.col("linkage") == alias, verb).otherwise(F.col("linkage")))
    return renamed.groupBy(*LINK_KEY).agg(F.max("weight").alias("weight"))


def derive_called_by(links: DataFrame) -> DataFrame:
    """Links (called_by, concept of the caller, callee): calls met with the definitions of both ends, without self calls."""
    calls = links.filter("linkage = 'calls'").select(F.col("concept_id").alias("callee_concept"), F.col("entity_id").alias("caller"))
    defines = links.filter("linkage = 'defines'")
    callee = defines.select(F.col("concept_id").alias("callee_concept"), F.col("entity_id").alias("callee"))
    caller = defines.select(F.col("concept_id").alias("caller_concept"), F.col("entity_id").alias("caller"))
    rows = calls.join(callee, "callee_concept").join(caller, "caller").filter("caller_concept != callee_concept")
    return rows.select(
        F.lit("called_by").alias("linkage"), F.col("caller_concept").alias("concept_id"), F.col("callee").alias("entity_id")
    ).distinct()


# --- memories -----------------------------------------------------------------------------------------


def retag(memories: DataFrame, chosen: DataFrame, add: Sequence[str] = (), remove: Sequence[str] = ()) -> DataFrame:
    """Memories with tags added to and removed from those of chosen (entity_id)."""
    tags = F.coalesce(F.from_json("tags", "array<string>"), F.array().cast("array<string>"))
    lits = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
    new = F.to_json(F.array_except(F.array_union(tags, lits(add)), lits(remove)))
    rows = memories.join(chosen.select("entity_id").distinct().withColumn("_c", F.lit(1)), "entity_id", "left")
    return rows.withColumn("tags", F.when(F.col("_c") == 1, new).otherwise(F.col("tags"))).select(*memories.columns)


def reclassify(memories: DataFrame, glob: str, mtype: str) -> DataFrame:
    return memories.withColumn("mtype", F.when(F.col("mtype").rlike(glob_pattern(glob)), mtype).otherwise(F.col("mtype")))


# --- deletions -------------------------------------------------------------------------------------------


def purge(graph: Graph, doomed: DataFrame, *sidecars: DataFrame) -> tuple:
    """The graph and sidecars (entity_id) without the entities of doomed (id): their links at either end and their evidence go too. Protected ones
    stay."""
    ids = doomed.select("id").join(graph.entities.filter("protected = 1").select("id"), "id", "left_anti").distinct()
    at = lambda c: ids.withColumnRenamed("id", c)
    links = graph.links.join(at("entity_id"), "entity_id", "left_anti").join(at("concept_id"), "concept_id", "left_anti")
    evidence = graph.evidence.join(at("entity_id"), "entity_id", "left_anti").join(
        at("concept_id"), "concept_id", "left_anti"
    ) if graph.evidence is not None else None
    return replace(
        graph, entities=graph.entities.join(ids, "id", "left_anti"), links=links, evidence=evidence
    ), *[s.join(at("entity_id"), "entity_id", "left_anti") for s in sidecars]


def vacuum(graph: Graph) -> Graph:
    """Without unprotected concepts that no link touches, and without evidence whose ends or links are gone."""
    used = graph.links.select(F.col("concept_id").alias("id")).union(graph.links.select("entity_id")).distinct()
    loose = graph.entities.filter("kind = 'concept'").join(used, "id", "left_anti")
    out = purge(graph, loose)[0]
    if out.evidence is not None:
        out = replace(out, evidence=out.evidence.join(out.links.select(*LINK_KEY), LINK_KEY, "left_semi"))
    return out


def set_flag(entities: DataFrame, chosen: DataFrame, flag: str, value: int) -> DataFrame:
    """Entities with a flag set on those of chosen (id)."""
    rows = entities.join(chosen.select("id").distinct().withColumn("_c", F.lit(1)), "id", "left")
    return rows.withColumn(flag, F.when(F.col("_c") == 1, value).otherwise(F.col(flag))).drop("_c").select(*entities.columns)


def fold_duplicates(graph: Graph) -> Graph:
    """A concept that shares partition and name with a memory gives it the links that it lacks (its own weights stay, self loops go), and is
    dropped."""
    m = graph.entities.filter("kind = 'memory'").select("partition_id", "name", F.col("id").alias("to"))
    c = graph.entities.filter("kind = 'concept'").select("partition_id", "name", F.col("id").alias("from"))
    pairs = c.join(m, ["partition_id", "name"]).groupBy("from").agg(F.min("to").alias("to"))
    links = remap(graph.links.withColumn("_p", F.lit(0)), pairs)
    links = links.filter("concept_id != entity_id").groupBy(*LINK_KEY).agg(
        F.min_by("weight", F.struct("_p", F.col("weight").isNull())).alias("weight")
    )
    return replace(graph, entities=graph.entities.join(pairs.select(F.col("from").alias("id")), "id", "left_anti"), links=links)


def remap(links: DataFrame, pairs: DataFrame) -> DataFrame:
    """Links with ids of pairs (from, to) replaced at both ends; ``_p`` becomes 1 where something was."""
    out = links
    for end in ("concept_id", "entity_id"):
        p = pairs.select(F.col("from").alias(end), F.col("to").alias("_to"))
        out = out.join(p, end, "left").withColumn(
            "_p", F.when(F.col("_to").isNotNull(), 1).otherwise(F.col("_p"))
        ).withColumn(end, F.coalesce("_to", F.col(end))).drop("_to")
    return out


def merge_partitions(graph: Graph, memories: DataFrame, src: int, dst: int) -> tuple[Graph, DataFrame]:
    """Everything of partition src moved to dst: entities with a (kind, name) that dst has are replaced by dst's, links follow, a strictly longer
    body of src replaces dst's.

    Links are made distinct on (linkage, concept, entity); the weight of dst's link stays.
    """
    key = ["kind", "name"]
    s = graph.entities.filter(F.col("partition_id") == src).select(*key, F.col("id").alias("from"))
    d = graph.entities.filter(F.col("partition_id") == dst).groupBy(*key).agg(F.min("id").alias("to"))
    pairs = s.join(d, key).select("from", "to")
    gone = pairs.select(F.col("from").alias("id"))
    entities = graph.entities.join(gone, "id", "left_anti").withColumn(
        "partition_id", F.when(F.col("partition_id") == src, dst).otherwise(F.col("partition_id"))
    )
    links = remap(graph.links.withColumn("_p", F.lit(0)), pairs).groupBy(*LINK_KEY).agg(
        F.min_by("weight", F.struct("_p", F.col("weight").isNull())).alias("weight")
    )
    moved = memories.join(
        pairs.select(F.col("from").alias("entity_id"), "to"), "entity_id", "left"
    ).withColumn("_own", F.col("to").isNull()).withColumn("entity_id", F.coalesce("to", "entity_id")).drop("to")
    longest = F.max_by("content", F.struct(F.length("content"), F.col("_own").cast("int")))
    own = lambda c: F.coalesce(F.max(F.when(F.col("_own"), F.col(c))), F.max(c)).alias(c)
    bodies = moved.groupBy("entity_id").agg(longest.alias("content"), *[own(c) for c in ("mtype", "tags", "metadata", "created_at", "updated_at")])
    return replace(graph, entities=entities, links=links), bodies


def merge_slots(a: DataFrame, b: DataFrame, key: Sequence[str], newer: str) -> DataFrame:
    """Two diverged copies of a table as one: of rows with the same natural key, the newer; of equally new ones, the one of ``a``."""
    both = a.withColumn("_s", F.lit(1)).unionByName(b.withColumn("_s", F.lit(0)))
    order = W.partitionBy(*key).orderBy(F.desc_nulls_last(newer), F.desc("_s"))
    return both.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n", "_s")


def audit_slots(a: DataFrame, b: DataFrame) -> DataFrame:
    """(side, n): rows that only one copy has, repeated rows counted."""
    one = lambda s, x, y: x.exceptAll(y).agg(F.count(F.lit(1)).alias("n")).select(F.lit(s).alias("side"), "n")
    return one("a", a, b).unionByName(one("b", b, a))


def pending_vectors(entities: DataFrame) -> DataFrame:
    """(id): entities whose vector was never made or is older than the entity."""
    return entities.filter("vectors_updated_at IS NULL OR vectors_updated_at < updated_at").select("id")


def orphan_vectors(vectors: DataFrame, entities: DataFrame) -> DataFrame:
    return vectors.join(entities.select("id"), "id", "left_anti")


def link_audit(bits: DataFrame, entities: DataFrame) -> DataFrame:
    """(state, n): bits whose ends exist, lack the entity, lack the concept or lack both."""
    ids = entities.select("id").distinct()
    rows = bits.select("linkage", "concept_id", "entity_id").distinct()
    rows = rows.join(ids.select(F.col("id").alias("entity_id"), F.lit(1).alias("e")), "entity_id", "left").join(
        ids.select(F.col("id").alias("concept_id"), F.lit(1).alias("c")), "concept_id", "left"
    )
    state = F.when(
        F.col("e").isNull() & F.col("c").isNull(), "both"
    ).when(F.col("e").isNull(), "entity").when(F.col("c").isNull(), "concept").otherwise("alive")
    return rows.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


def promote_edges(pairs: DataFrame, nodes: DataFrame, threshold: float = 3.0, most: int = 200) -> DataFrame:
    """(a, b, weight) in both directions: working-memory pairs of at least the threshold, the ``most`` of highest lift = weight / (freq_a *
    freq_b)."""
    f = lambda s: nodes.select(F.col("name").alias(s), F.col("freq").alias(f"f{s}"))
    best = pairs.filter(F.col("weight") >= threshold).join(f("a"), "a").join(f("b"), "b").withColumn(
        "lift", F.col("weight") / (F.col("fa") * F.col("fb"))
    )
    best = best.orderBy(F.desc("lift"), F.desc("weight"), "a", "b").limit(most).select("a", "b", "weight")
    return best.unionByName(best.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))


# --- the log ------------------------------------------------------------------------------------------------


def dump_log(graph: Graph, memories: DataFrame | None = None) -> DataFrame:
    """The store as events (ts, phase, op, kind, name, linkage, c, e, weight, path, value): entities, then flags and bodies, then links, then
    evidence."""
    text = lambda c: F.col(c).cast("string")
    columns = {
        "kind": "string", "name": "string", "linkage": "string", "c": "string", "e": "string", "weight": "double", "path": "string", "value": "string"
    }

    def events(df: DataFrame, phase: int, op: str, **given) -> DataFrame:
        return df.select(
            F.col("updated_at").alias("ts"), F.lit(phase).alias("phase"), F.lit(op).alias("op"),
            *[(given[c] if c in given else F.lit(None)).cast(t).alias(c) for c, t in columns.items()]
        )

    e, ids = graph.entities, graph.entities.select(F.col("id").alias("entity_id"), F.col("kind").alias("e_kind"), "updated_at")
    out = events(e, 0, "entity", kind=F.col("kind"), name=text("id"), path=F.col("path"), value=F.col("tldr"))
    for flag, op in (("protected", "protect"), ("noise", "noise")):
        out = out.unionByName(events(e.filter(f"{flag} = 1"), 1, op, kind=F.col("kind"), name=text("id"), value=F.lit("1")))
    if memories is not None:
        out = out.unionByName(events(memories, 1, "memory_content", kind=F.lit("memory"), name=text("entity_id"), value=F.col("content")))
    link = {"linkage": F.col("linkage"), "c": text("concept_id"), "e": text("entity_id")}
    out = out.unionByName(events(graph.links.join(ids, "entity_id"), 2, "link", **link, weight=F.col("weight")))
    if graph.evidence is not None:
        out = out.unionByName(events(graph.evidence.join(ids, "entity_id"), 3, "evidence", **link, path=F.col("file"), value=text("line")))
    return out


def replay_entities(log: DataFrame) -> DataFrame:
    """(kind, name, path, value, ts): entities that are alive after the log.

    Of each field the last non-null value, by (ts, line_no); an entity is dead from a tombstone that isn't older than its latest event on.
    """
    rows = log.filter(F.col("op").isin("entity", "tombstone"))
    at = F.struct("ts", "line_no")
    own = F.col("op") == "entity"
    last = lambda c: F.max_by(c, F.when(own & F.col(c).isNotNull(), at)).alias(c)
    out = rows.groupBy("kind", "name").agg(
        last("path"), last("value"), F.max(F.when(own, F.col("ts"))).alias("ts"), F.max(F.when(F.col("op") == "tombstone", F.col("ts"))).alias("dead")
    )
    return out.filter("ts IS NOT NULL AND (dead IS NULL OR dead < ts)").drop("dead")


def replay_links(log: DataFrame) -> DataFrame:
    """(linkage, c, e, weight): links whose latest event is a link; of equally late events the first line counts."""
    rows = log.filter(F.col("op").isin("link", "unlink"))
    order = W.partitionBy("linkage", "c", "e").orderBy(F.desc("ts"), "line_no")
    return rows.withColumn("_n", F.row_number().over(order)).filter("_n = 1 AND op = 'link'").select("linkage", "c", "e", "weight")


def replay_latest(log: DataFrame, op: str) -> DataFrame:
    """The latest event per name of one of protect, noise, track or memory_content; of equally late ones the first line."""
    order = W.partitionBy("kind", "name").orderBy(F.desc("ts"), "line_no")
    return log.filter(F.col("op") == op).withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")
