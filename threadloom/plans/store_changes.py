"""Changes to the store, its log and its vectors."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from threadloom.graph import read, store_graph
from threadloom.operators import mutate, vectors
from threadloom.plans.set_algebra import STORE
from threadloom.plans.store_analytics import ENT, entities, memories
from threadloom.staging import stage


def link_audit(spark, sf_dir):
    bits = read(spark, sf_dir, "bitmap_fragments").select(
        F.translate(F.lower("linkage"), "_", "-").alias("linkage"), F.shiftright("bit", 32).alias("concept_id"),
        F.col("bit").bitwiseAND(F.lit(0xFFFFFFFF)).alias("entity_id")
    )
    return mutate.link_audit(bits, entities(spark, sf_dir))


def merge_links(spark, sf_dir):
    """Raw bits folded into distinct links, first write wins."""
    bits = read(spark, sf_dir, "bitmap_fragments").select(
        F.translate(F.lower("linkage"), "_", "-").alias("linkage"), F.shiftright("bit", 32).alias("concept_id"),
        F.col("bit").bitwiseAND(F.lit(0xFFFFFFFF)).alias("entity_id"),
        F.col("partition_id").cast("double").alias("weight"),
        (F.unix_micros(F.col("written_at").cast("timestamp")) * 1000 + F.col("partition_id")).alias("seq"),
    )
    return mutate.merge_links(bits.limit(0).drop("seq"), bits, "first")


def merge_verb_alias(spark, sf_dir):
    return mutate.merge_verb(store_graph(spark, sf_dir).links, "specified-by", "specifies")


def derive_called_by(spark, sf_dir):
    return mutate.derive_called_by(store_graph(spark, sf_dir).links)


def vacuum(spark, sf_dir):
    """What is left of the entities without unprotected, unlinked concepts."""
    return mutate.vacuum(store_graph(spark, sf_dir)).entities.select("id")


def purge_partition(spark, sf_dir):
    """Links that are left after all entities of partition 3 are purged."""
    g = store_graph(spark, sf_dir)
    return mutate.purge(g, g.entities.filter("partition_id = 3"))[0].links.select("linkage", "concept_id", "entity_id")


def set_flags(spark, sf_dir):
    e = entities(spark, sf_dir)
    return mutate.set_flag(e, e.filter("name LIKE 'import/%'"), "noise", 1).filter("noise = 1").select("id")


def partition_merge(spark, sf_dir):
    """Entities after partition 2 is merged into partition 1."""
    g, _ = mutate.merge_partitions(store_graph(spark, sf_dir), memories(spark, sf_dir), 2, 1)
    return g.entities.select("id", "partition_id")


def partition_merge_links(spark, sf_dir):
    g, _ = mutate.merge_partitions(store_graph(spark, sf_dir), memories(spark, sf_dir), 2, 1)
    return g.links.select("linkage", "concept_id", "entity_id")


def replica_merge(spark, sf_dir):
    """Entities and their replica as one: of each id the newer row."""
    a, b = entities(spark, sf_dir), read(spark, sf_dir, "entities_replica").distinct()
    seconds = lambda df: df.withColumn("seen", F.when(F.col("updated_at") > 1e11, F.col("updated_at") / 1000).otherwise(F.col("updated_at")))
    return mutate.merge_slots(
        seconds(a), seconds(b).groupBy(*b.columns, "seen").count().drop("count"), ["id"], "seen"
    ).select("id", F.round("seen", 1).alias("seen"))


def replica_audit(spark, sf_dir):
    return mutate.audit_slots(
        read(spark, sf_dir, "memory_content").select("entity_id", "content"), read(spark, sf_dir, "memory_replica").select("entity_id", "content")
    )


def retag(spark, sf_dir):
    """All decisions get a tag."""
    m = memories(spark, sf_dir)
    return mutate.retag(m, m.filter("mtype = 'decision'"), ["checked"], []).filter("tags LIKE '%checked%'").select("entity_id")


def reclassify(spark, sf_dir):
    return mutate.reclassify(memories(spark, sf_dir), "session/*", "digest").groupBy("mtype").agg(F.count(F.lit(1)).alias("n"))


def pending_vectors(spark, sf_dir):
    return mutate.pending_vectors(entities(spark, sf_dir))


def _log(spark: SparkSession, sf_dir: str):
    """The event table as a mutation log: signup and view assert, error and click retract."""
    ev = read(spark, sf_dir, "events")
    op = F.when(
        F.col("event_type") == "error", "tombstone"
    ).when(F.col("event_type") == "click", "unlink").when(F.col("event_type") == "purchase", "link").otherwise("entity")
    name = F.concat(F.lit("user-"), F.col("user_id"))
    return ev.select(
        F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 60_000_000).cast("double").alias("ts"), F.col("event_id").alias("line_no"),
        op.alias("op"), F.lit("memory").alias("kind"), name.alias("name"),
        F.lit("mentions").alias("linkage"), F.get_json_object("props", "$.k").alias("c"), name.alias("e"), F.col("value").alias("weight"),
        F.when(F.col("value") > 20, F.get_json_object("props", "$.k")).alias("path"), F.col("event_type").alias("value"),
    )


def log_replay_lww(spark, sf_dir):
    return mutate.replay_entities(_log(spark, sf_dir))


def log_replay_links(spark, sf_dir):
    return mutate.replay_links(_log(spark, sf_dir))


def log_replay_latest(spark, sf_dir):
    return mutate.replay_latest(_log(spark, sf_dir), "entity").select("name", "line_no")


def log_dump(spark, sf_dir):
    """The store as log events: entities, flags, bodies of memories and links."""
    return mutate.dump_log(store_graph(spark, sf_dir), memories(spark, sf_dir)).drop("ts")


def _vectors(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


def knn_exact(spark, sf_dir):
    """The ten vectors nearest to vector 0."""
    v = _vectors(spark, sf_dir)
    query = v.filter("id = 0").first()["vector"]
    return vectors.nearest(v, query, 10).select("id", F.round("distance", 4).alias("distance"))


def knn_join(spark, sf_dir):
    """The five nearest of every twentieth vector, among all."""
    v = _vectors(spark, sf_dir)
    return vectors.knn_join(v.filter("id % 20 = 0"), v, 5).select("id", "other", F.round("cosine", 4).alias("cosine"))


def knn_cells(spark, sf_dir):
    """The five nearest of every vector, within cells."""
    v = _vectors(spark, sf_dir)
    return vectors.knn_cells(v, v, 5)


def knn_recall(spark, sf_dir):
    """How many of the true neighbours of every twentieth vector the cells give."""
    v = _vectors(spark, sf_dir)
    asked = v.filter("id % 20 = 0")
    return vectors.recall_of(vectors.knn_cells(asked, v, 10), vectors.knn_join(asked, v, 10))


def mutual_knn(spark, sf_dir):
    return vectors.mutual_knn(_vectors(spark, sf_dir), 5, 0.1).select("a", "b", F.round("weight", 4).alias("weight"))


def _doc_concepts(spark, sf_dir, verbs=("mentions",)):
    """Links of the store under the verbs as concept names of entities."""
    g = store_graph(spark, sf_dir)
    return g.links.filter(F.col("linkage").isin(*verbs)).join(
        g.concepts().select("concept_id", "name"), "concept_id"
    ).select("entity_id", F.col("name").alias("concept")).distinct()


def informative_concepts(spark, sf_dir):
    return vectors.informative_concepts(_doc_concepts(spark, sf_dir)).select("entity_id", "concept", F.round("idf", 6).alias("idf"))


def _concept_sets(spark, sf_dir):
    """Informative concepts, and the class of each entity."""
    sets = stage(vectors.informative_concepts(_doc_concepts(spark, sf_dir)), "concept-sets")
    return sets, stage(vectors.concept_classes(sets), "concept-classes")


def concept_classes(spark, sf_dir):
    """Entities with the same concepts, by the one that stands for them."""
    return _concept_sets(spark, sf_dir)[1]


def concept_cosine(spark, sf_dir):
    """Pairs of classes of entities alike enough to be bridged by their concepts."""
    sets, classes = _concept_sets(spark, sf_dir)
    first = sets.join(classes.filter("entity_id = representative").select("entity_id"), "entity_id", "left_semi")
    return vectors.concept_cosine(first).select("a", "b", F.round("cosine", 6).alias("cosine"))


def _members(spark, sf_dir):
    return entities(spark, sf_dir).select(F.col("id").alias("entity_id"), F.col("partition_id").alias("cluster"))


def cluster_label_lift(spark, sf_dir):
    """Partitions as clusters, labelled by the concepts of their entities."""
    sets = vectors.informative_concepts(_doc_concepts(spark, sf_dir))
    n = sets.select("entity_id").distinct().count()
    return vectors.cluster_labels(_members(spark, sf_dir), sets, n).select("cluster", "label", F.round("lift", 6).alias("lift"))


def crosscutting(spark, sf_dir):
    return vectors.crosscutting(
        _members(spark, sf_dir), vectors.informative_concepts(_doc_concepts(spark, sf_dir))
    ).select("concept", F.round("score", 6).alias("score"))


def corroborated(spark, sf_dir):
    g = store_graph(spark, sf_dir)
    return vectors.corroborated_concepts(
        g.links, g.entities.withColumn("created_at", F.when(F.col("created_at") > 1e11, F.col("created_at") / 1000).otherwise(F.col("created_at")))
    )


def singletons(spark, sf_dir):
    g = store_graph(spark, sf_dir)
    return vectors.singletons(g.links, g.entities)


def contradicted(spark, sf_dir):
    return vectors.contradicted(store_graph(spark, sf_dir).links)


def orphan_concept(spark, sf_dir):
    return vectors.orphan_concepts(store_graph(spark, sf_dir).links)


QUERIES = {
    f.__name__: f
    for f in (
        link_audit, merge_links, merge_verb_alias, derive_called_by, vacuum, purge_partition, set_flags, partition_merge, partition_merge_links,
        replica_merge, replica_audit, retag, reclassify, pending_vectors,
        log_replay_lww, log_replay_links, log_replay_latest, log_dump, knn_exact, knn_join, knn_cells, knn_recall, mutual_knn, informative_concepts,
        concept_classes, concept_cosine, cluster_label_lift, crosscutting, corroborated, singletons, contradicted, orphan_concept,
    )
}

_LOG = """WITH lg AS (SELECT CAST(epoch_us(ts) // 60000000 AS DOUBLE) AS ts, event_id AS line_no, CASE event_type WHEN 'error' THEN 'tombstone' WHEN 'click' THEN 'unlink' WHEN 'purchase' THEN 'link' ELSE 'entity' END AS op,
 'memory' AS kind, 'user-' || user_id AS name, 'mentions' AS linkage, json_extract_string(props, '$.k') AS c, 'user-' || user_id AS e, value AS weight, CASE WHEN value > 20 THEN json_extract_string(props, '$.k') END AS path, event_type AS value FROM events)"""
_COS = "SELECT a.vec_id AS id, b.vec_id AS other, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS cosine FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id"
_NEAR = f"WITH s AS ({_COS}), n AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(cosine, 12) DESC, other) <= 5)"
_SETS = (
    STORE
    + ", dc AS (SELECT DISTINCT entity_id, lower(name) AS concept FROM lnk JOIN con USING (concept_id) WHERE linkage = 'mentions' AND name IS NOT NULL), nd AS (SELECT count(DISTINCT entity_id) AS n FROM dc), cd AS (SELECT concept, count(*) AS df FROM dc GROUP BY 1), st AS (SELECT entity_id, concept, df, ln(n / df) AS idf FROM dc JOIN cd USING (concept), nd WHERE df >= 2 AND df <= greatest(2, floor(0.1 * n)))"
)
_CLASSES = (
    ", cs AS (SELECT entity_id, list_sort(list(concept)) AS c FROM st GROUP BY 1), cc AS (SELECT entity_id, min(entity_id) OVER (PARTITION BY c) AS representative FROM cs)"
)
ORACLE = {
    "link_audit": "WITH b AS (SELECT DISTINCT replace(lower(linkage), '_', '-') AS l, bit >> 32 AS c, bit & 4294967295 AS e FROM bitmap_fragments), x AS (SELECT e IN (SELECT id FROM entities) AS he, c IN (SELECT id FROM entities) AS hc FROM b) SELECT CASE WHEN NOT he AND NOT hc THEN 'both' WHEN NOT he THEN 'entity' WHEN NOT hc THEN 'concept' ELSE 'alive' END AS state, count(*) AS n FROM x GROUP BY 1",
    "merge_links": "SELECT replace(lower(linkage), '_', '-') AS linkage, bit >> 32 AS concept_id, bit & 4294967295 AS entity_id, CAST(arg_min(partition_id, epoch_us(written_at) * 1000 + partition_id) AS DOUBLE) AS weight FROM bitmap_fragments GROUP BY 1, 2, 3",
    "merge_verb_alias": STORE
    + "SELECT CASE linkage WHEN 'specified-by' THEN 'specifies' ELSE linkage END AS linkage, concept_id, entity_id, CAST(NULL AS DOUBLE) AS weight FROM lnk GROUP BY 1, 2, 3",
    "derive_called_by": STORE
    + "SELECT DISTINCT 'called_by' AS linkage, r.concept_id, d.entity_id FROM lnk c JOIN lnk d ON c.concept_id = d.concept_id AND d.linkage = 'defines' JOIN lnk r ON r.entity_id = c.entity_id AND r.linkage = 'defines' WHERE c.linkage = 'calls' AND r.concept_id <> c.concept_id",
    "vacuum": STORE
    + "SELECT id FROM ent WHERE kind <> 'concept' OR coalesce(protected, 0) = 1 OR id IN (SELECT concept_id FROM lnk UNION SELECT entity_id FROM lnk)",
    "purge_partition": STORE
    + ", d AS (SELECT id FROM ent WHERE partition_id = 3 AND coalesce(protected, 0) <> 1) SELECT linkage, concept_id, entity_id FROM lnk WHERE concept_id NOT IN (SELECT id FROM d) AND entity_id NOT IN (SELECT id FROM d)",
    "set_flags": ENT + " SELECT id FROM ent WHERE noise = 1 OR name LIKE 'import/%'",
    "partition_merge": ENT
    + ", d AS (SELECT kind, name FROM ent WHERE partition_id = 1) SELECT id, CASE partition_id WHEN 2 THEN 1 ELSE partition_id END AS partition_id FROM ent WHERE NOT (partition_id = 2 AND (kind, name) IN (SELECT (kind, name) FROM d))",
    "partition_merge_links": STORE
    + ", p AS (SELECT s.id AS f, min(d.id) AS t FROM ent s JOIN ent d ON s.kind = d.kind AND s.name = d.name AND d.partition_id = 1 WHERE s.partition_id = 2 GROUP BY 1) SELECT DISTINCT linkage, coalesce(pc.t, concept_id) AS concept_id, coalesce(pe.t, entity_id) AS entity_id FROM lnk LEFT JOIN p pc ON pc.f = concept_id LEFT JOIN p pe ON pe.f = entity_id",
    "replica_merge": "WITH b AS (SELECT id, CASE WHEN updated_at > 1e11 THEN updated_at / 1000 ELSE updated_at END AS seen FROM entities UNION ALL SELECT id, CASE WHEN updated_at > 1e11 THEN updated_at / 1000 ELSE updated_at END AS seen FROM entities_replica) SELECT id, round(max(seen), 1) AS seen FROM b GROUP BY 1",
    "replica_audit": "SELECT 'a' AS side, count(*) AS n FROM (SELECT entity_id, content FROM memory_content EXCEPT ALL SELECT entity_id, content FROM memory_replica) UNION ALL SELECT 'b', count(*) FROM (SELECT entity_id, content FROM memory_replica EXCEPT ALL SELECT entity_id, content FROM memory_content)",
    "retag": ENT + " SELECT entity_id FROM mem WHERE tags LIKE '%checked%' OR mtype = 'decision'",
    "reclassify": ENT + " SELECT CASE WHEN mtype LIKE 'session/%' THEN 'digest' ELSE mtype END AS mtype, count(*) AS n FROM mem GROUP BY 1",
    "pending_vectors": ENT + " SELECT id FROM ent WHERE vectors_updated_at IS NULL OR vectors_updated_at < updated_at",
    "log_replay_lww": _LOG
    + " , r AS (SELECT kind, name, arg_max(path, (ts, line_no)) FILTER (WHERE op = 'entity' AND path IS NOT NULL) AS path, arg_max(value, (ts, line_no)) FILTER (WHERE op = 'entity') AS value, max(ts) FILTER (WHERE op = 'entity') AS ts, max(ts) FILTER (WHERE op = 'tombstone') AS dead FROM lg WHERE op IN ('entity', 'tombstone') GROUP BY 1, 2) SELECT kind, name, path, value, ts FROM r WHERE ts IS NOT NULL AND (dead IS NULL OR dead < ts)",
    "log_replay_links": _LOG
    + " SELECT linkage, c, e, weight FROM (SELECT *, row_number() OVER (PARTITION BY linkage, c, e ORDER BY ts DESC, line_no) AS n FROM lg WHERE op IN ('link', 'unlink')) WHERE n = 1 AND op = 'link'",
    "log_replay_latest": _LOG
    + " SELECT name, line_no FROM lg WHERE op = 'entity' QUALIFY row_number() OVER (PARTITION BY kind, name ORDER BY ts DESC, line_no) = 1",
    "log_dump": STORE
    + ", l AS (SELECT 0 AS phase, 'entity' AS op, kind, CAST(id AS VARCHAR) AS name, NULL AS linkage, NULL AS c, NULL AS e, path, tldr AS value FROM ent UNION ALL SELECT 1, 'protect', kind, CAST(id AS VARCHAR), NULL, NULL, NULL, NULL, '1' FROM ent WHERE protected = 1 "
    "UNION ALL SELECT 1, 'noise', kind, CAST(id AS VARCHAR), NULL, NULL, NULL, NULL, '1' FROM ent WHERE noise = 1 UNION ALL SELECT 1, 'memory_content', 'memory', CAST(entity_id AS VARCHAR), NULL, NULL, NULL, NULL, content FROM (SELECT DISTINCT * FROM memory_content) "
    "UNION ALL SELECT 2, 'link', NULL, NULL, linkage, CAST(concept_id AS VARCHAR), CAST(entity_id AS VARCHAR), NULL, NULL FROM lnk JOIN ent ON id = entity_id) SELECT *, CAST(NULL AS DOUBLE) AS weight FROM l",
    "knn_exact": "SELECT vec_id AS id, round(list_sum(list_transform(list_zip(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)), lambda p: (p[1] - p[2]) ** 2)), 4) AS distance FROM embeddings ORDER BY 2, 1 LIMIT 10",
    "knn_join": _NEAR + " SELECT id, other, round(cosine, 4) AS cosine FROM n WHERE id % 20 = 0",
    "mutual_knn": _NEAR
    + " SELECT x.id AS a, x.other AS b, round((x.cosine - 0.1) / 0.9, 4) AS weight FROM n x JOIN n y ON x.id = y.other AND x.other = y.id WHERE x.id < x.other AND x.cosine > 0.1",
    "informative_concepts": _SETS + " SELECT entity_id, concept, round(idf, 6) AS idf FROM st",
    "concept_classes": _SETS + _CLASSES + " SELECT entity_id, representative FROM cc",
    "concept_cosine": _SETS
    + _CLASSES
    + ", sr AS (SELECT * FROM st WHERE entity_id IN (SELECT representative FROM cc)), nm AS (SELECT entity_id, sqrt(sum(idf * idf)) AS n FROM sr GROUP BY 1), "
    "d AS (SELECT a.entity_id AS a, b.entity_id AS b, sum(a.idf * b.idf) AS dot FROM sr a JOIN sr b ON a.concept = b.concept AND a.entity_id < b.entity_id GROUP BY 1, 2) "
    "SELECT a, b, round(dot / (x.n * y.n), 6) AS cosine FROM d JOIN nm x ON x.entity_id = a JOIN nm y ON y.entity_id = b WHERE dot / (x.n * y.n) > 0.35",
    "cluster_label_lift": _SETS
    + ", m AS (SELECT id AS entity_id, partition_id AS cluster FROM ent), sz AS (SELECT cluster, count(*) AS size FROM m GROUP BY 1), td AS (SELECT concept, count(*) AS tdf FROM st GROUP BY 1), ins AS (SELECT cluster, concept, count(*) AS din, max(idf) AS idf FROM st JOIN m USING (entity_id) GROUP BY 1, 2 HAVING count(*) >= 2), r AS (SELECT *, (din / size) / (tdf / (SELECT count(DISTINCT entity_id) FROM st)) AS lift FROM ins JOIN td USING (concept) JOIN sz USING (cluster)) SELECT cluster, concept AS label, round(lift, 6) AS lift FROM r QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY round(lift, 9) DESC, din DESC, round(idf, 9) DESC, concept) = 1",
    "crosscutting": _SETS
    + ", r AS (SELECT concept, count(*) * max(idf) / (count(DISTINCT partition_id) - 1) AS score FROM st JOIN ent ON id = entity_id GROUP BY 1 HAVING count(DISTINCT partition_id) > 1 ORDER BY round(score, 9) DESC, 1 LIMIT 12) SELECT concept, round(score, 6) AS score FROM r",
    "corroborated": STORE
    + ", m AS (SELECT id, floor((CASE WHEN created_at > 1e11 THEN created_at / 1000 ELSE created_at END) / 86400) AS day FROM ent WHERE kind = 'memory') SELECT concept_id, count(DISTINCT entity_id) AS members, count(DISTINCT day) AS days FROM lnk JOIN m ON id = entity_id GROUP BY 1 HAVING count(DISTINCT entity_id) >= 3 AND count(DISTINCT day) >= 3",
    "singletons": STORE
    + "SELECT concept_id, min(entity_id) AS entity_id FROM lnk JOIN ent ON id = entity_id WHERE kind = 'memory' GROUP BY 1 HAVING count(DISTINCT entity_id) = 1",
    "contradicted": STORE + "SELECT DISTINCT concept_id, entity_id FROM lnk WHERE linkage = 'contradicts'",
    "orphan_concept": STORE
    + "SELECT concept_id, count(DISTINCT entity_id) AS mentions FROM lnk WHERE linkage = 'mentions' AND concept_id NOT IN (SELECT concept_id FROM lnk WHERE linkage IN ('defines', 'lead')) GROUP BY 1 HAVING count(DISTINCT entity_id) >= 4",
}
