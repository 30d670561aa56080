"""Evidence grep, upkeep of the store, texts and vectors of entities, scorers over several verbs, composites."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from threadloom.graph import BODY_TOKEN, read, store_graph
from threadloom.operators import analytics, embed, evidence, rank, upkeep
from threadloom.plans.retrieval import DOCS, TERMS, _rounded, links, term_table
from threadloom.plans.set_algebra import STORE
from threadloom.plans.store_analytics import ENT, entities, log, memories
from threadloom.sources import files
from threadloom.streaming import runner, state

# --- evidence -------------------------------------------------------------------------------------------


def _lines(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").filter("text IS NOT NULL").select(F.concat(F.lit("doc-"), F.col("doc_id")).alias("path"), "text")
    return files.lines_of(docs)


def _evidence(spark, sf_dir):
    """Every term of a document as evidence on its own lines and, as code indexes have it, on the document's first line."""
    rows = _lines(spark, sf_dir).select(
        "path", "line_no",
        F.explode(F.array_distinct(F.regexp_extract_all(F.lower("line"), F.lit(BODY_TOKEN.replace("A-Z", "")), F.lit(0)))).alias("concept_id")
    )
    whole = rows.select("path", F.lit(1).alias("line"), F.lit("defines").alias("linkage"), "concept_id").distinct()
    rows = rows.select("path", F.col("line_no").alias("line"), F.lit("mentions").alias("linkage"), "concept_id").unionByName(whole)
    return rows.withColumns({"entity": F.col("path"), "kind": F.lit("doc")})


def _terms(rows):
    """Terms as concepts: the name and, in another spelling, the canonical name of a namespaced form."""
    return rows.select("concept_id").distinct().select(
        "concept_id", F.col("concept_id").alias("name"), F.concat(F.lit("keyword_"), F.col("concept_id")).alias("canonical_name")
    )


def evidence_grep(spark, sf_dir):
    """Lines that hold a word in this spelling."""
    rows = _evidence(spark, sf_dir)
    return evidence.grep_evidence(rows, _terms(rows), _lines(spark, sf_dir), "watermark", limit=None)


def evidence_grep_words(spark, sf_dir):
    """Lines that hold two words in any spelling of an identifier, the first hundred."""
    rows = _evidence(spark, sf_dir)
    return evidence.grep_evidence(rows, _terms(rows), _lines(spark, sf_dir), "inlet marble", ignore_case=True)


def evidence_grep_regex(spark, sf_dir):
    """Lines that match an expression, of one verb."""
    rows = _evidence(spark, sf_dir)
    return evidence.grep_evidence(rows, _terms(rows), _lines(spark, sf_dir), "^water[a-z]+$|tombst", True, linkage="defines", limit=None)


# --- upkeep -------------------------------------------------------------------------------------------------


def _bits(spark, sf_dir):
    bits = read(spark, sf_dir, "bitmap_fragments")
    return bits.select(
        "linkage", F.shiftright("bit", 32).alias("concept_id"), F.col("bit").bitwiseAND(F.lit(0xFFFFFFFF)).alias("entity_id"), "partition_id",
        "written_at"
    )


def repair_links(spark, sf_dir):
    return upkeep.repair(_bits(spark, sf_dir), entities(spark, sf_dir))


def deferred_links(spark, sf_dir):
    """Bits of three groups of partitions, gathered and merged at once; of equal links the first group's stays."""
    bits = _bits(spark, sf_dir).withColumn("linkage", F.translate(F.lower("linkage"), "_", "-"))
    bits = bits.select(
        "linkage", "concept_id", "entity_id", F.col("partition_id").cast("double").alias("weight"), F.col("partition_id").cast("long").alias("seq")
    )
    with upkeep.DeferredLinks(bits.drop("seq").limit(0)) as d:
        for i in range(3):
            d.add(bits.filter(F.col("partition_id") % 3 == i))
    return d.links


def bulk_write(spark, sf_dir):
    """A client's Arrow batches appended in one write, then another one."""
    table = pa.table({"n": pa.array(range(25), pa.int64()), "name": pa.array([f"n{i}" for i in range(25)])})
    path = upkeep.scratch(spark)
    for _ in range(2):
        upkeep.bulk_write(spark, table.to_batches(max_chunksize=10), path)
    return spark.read.parquet(path).groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("total"))


def add_memories(spark, sf_dir):
    """Every document as a memory of its partition, named by language: new ones, and one that is given several times."""
    g = store_graph(spark, sf_dir)
    batch = read(spark, sf_dir, "documents").select(
        F.coalesce("partition_id", F.lit(1)).alias("partition_id"), F.concat(F.lit("doc/"), F.coalesce("lang", F.lit("-"))).alias("name"),
        F.col("text").alias("content"), F.lit("note").alias("mtype"), F.lit(None).cast("string").alias("tags"),
        F.lit(None).cast("string").alias("metadata"), F.lit(1.5e9).alias("now"), F.col("doc_id").alias("seq"),
    )
    graph, bodies = upkeep.add_memories(g, memories(spark, sf_dir), batch)
    names = graph.entities.filter("kind = 'memory'").select(F.col("id").alias("entity_id"), "partition_id", "name")
    return bodies.join(names, "entity_id").filter("updated_at = 1.5e9").select("partition_id", "name", F.md5("content").alias("md5"))


def bulk_forget(spark, sf_dir):
    """Memories that are left when old observations are forgotten."""
    kept, bodies = upkeep.bulk_forget(store_graph(spark, sf_dir), memories(spark, sf_dir), mtype="obs*", older_than=1.77e9)
    return bodies.select("entity_id").join(kept.entities.select(F.col("id").alias("entity_id")), "entity_id")


def rename_partition(spark, sf_dir):
    p = read(spark, sf_dir, "partitions")
    return upkeep.rename_partition(p, p.filter("id = 3").first()["name"], "renamed").select("id", "name")


def drop_vectors(spark, sf_dir):
    """Entities that still have a vector after those of documents are dropped."""
    v = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"))
    left, marked = upkeep.drop_vectors(v, entities(spark, sf_dir), entities(spark, sf_dir).filter("kind = 'doc'").select("id"))
    return marked.groupBy("kind").agg(F.count("vectors_updated_at").alias("with_vector"), F.count(F.lit(1)).alias("n"))


def snapshot(spark, sf_dir):
    """Two versions of the store written; the latest as read back."""
    g, folder = store_graph(spark, sf_dir), upkeep.scratch(spark)
    upkeep.snapshot({"links": g.links.filter("linkage = 'defines'")}, folder, 1)
    upkeep.snapshot({"links": g.links}, folder, 2)
    return upkeep.latest_snapshot(spark, folder, "links", [1, 2]).groupBy("linkage").agg(
        F.count(F.lit(1)).alias("n"), F.max("entity_id").alias("last")
    )


# --- rules --------------------------------------------------------------------------------------------------------


def subjects(spark, sf_dir):
    """Decisions as subjects: the other memories of a partition are filed under its first one."""
    e, m = entities(spark, sf_dir), memories(spark, sf_dir)
    typed = e.filter("kind = 'memory'").select("id", "partition_id").join(m.select(F.col("entity_id").alias("id"), "mtype"), "id")
    first = typed.filter("mtype = 'decision'").groupBy("partition_id").agg(F.min("id").alias("concept_id"))
    filed = typed.join(first, "partition_id").filter("id != concept_id").select(
        F.lit("part-of").alias("linkage"), "concept_id", F.col("id").alias("entity_id")
    )
    return analytics.subjects(e, m, filed, "decision").drop("updated_at")


def corpus(spark, sf_dir):
    """How many memories of each type belong to the corpus of each scope."""
    rows = memories(spark, sf_dir).join(entities(spark, sf_dir).select(F.col("id").alias("entity_id"), "name"), "entity_id")
    tests = {s: analytics.in_corpus(F.col("name"), F.col("mtype"), F.col("tags"), s) for s in ("memory", "pattern")}
    return rows.groupBy("mtype").agg(*[F.sum(t.cast("int")).alias(s) for s, t in tests.items()])


def adoption(spark, sf_dir):
    """What keeps each project root from being used well, with what its partition holds as facts."""
    calls = log(spark, sf_dir).select("root", "kind", "invocation", F.col("source").alias("command"), "cardinality")
    held = entities(spark, sf_dir).groupBy("partition_id").agg(
        F.count(F.lit(1)).alias("entities"), F.sum(F.when(F.col("updated_at") < F.col("created_at"), 1).otherwise(0)).alias("stale_files")
    )
    roots = read(spark, sf_dir, "partitions").select(F.col("id").alias("partition_id"), F.col("root_path").alias("root"))
    facts = roots.join(held, "partition_id", "left").select(
        "root", F.coalesce("entities", F.lit(0)).alias("entities"), "stale_files", (F.col("partition_id") % 7 != 0).alias("running"),
        (F.col("partition_id") % 5 != 0).alias("supervised")
    )
    return analytics.adoption(calls, ["root"], facts, ("query", "grep-replica", "recall-hook"))


# --- texts and vectors ------------------------------------------------------------------------------------------------


def entity_texts(spark, sf_dir):
    """What stands for each entity when it is embedded."""
    return embed.entity_texts(entities(spark, sf_dir), memories(spark, sf_dir)).select("id", "kind", F.md5("text").alias("md5"))


def embed_entities(spark, sf_dir):
    """Vectors of all entities, by the encoder that needs no model: dimensions and length."""
    made = embed.embed(embed.entity_texts(entities(spark, sf_dir), memories(spark, sf_dir)))
    norm = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return made.select("id", F.size("vector").alias("dims"), F.round(norm, 4).alias("squared"))


# --- scorers ------------------------------------------------------------------------------------------------------------


def term_rank_fusion(spark, sf_dir):
    return _rounded(rank.term_rank_fusion(links(spark, sf_dir), term_table(spark), 20), "score")


MULTI = {"mentions": 1.0, "lead": 0.5}


def multi_rank(spark, sf_dir):
    return _rounded(rank.multi_rank(links(spark, sf_dir), term_table(spark), MULTI, coverage_alpha=3.0, together_alpha=1.0), "score")


# --- composites -----------------------------------------------------------------------------------------------------------


def composites(spark, sf_dir):
    """After every third turn of a user, the two things it dealt with most so far, by a stream in several batches."""
    ev = read(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("session"), F.col("event_id").alias("seq"),
        F.concat(F.lit("k"), F.get_json_object("props", "$.k"), F.lit("-"), "event_type").alias("token")
    )
    stream = runner.replayed(spark, ev, files_per_batch=1, order="seq")
    return runner.to_table(state.composites(stream, every=3, k=2), "composites")


QUERIES = {
    f.__name__: f
    for f in (
        evidence_grep, evidence_grep_words, evidence_grep_regex, repair_links, deferred_links, bulk_write, add_memories, bulk_forget,
        rename_partition, drop_vectors, snapshot, subjects, corpus, adoption, entity_texts, embed_entities,
        term_rank_fusion, multi_rank, composites,
    )
}

_EVIDENCE = """
WITH ln AS (SELECT 'doc-' || doc_id AS path, unnest(ls) AS line, generate_subscripts(ls, 1) AS no FROM (SELECT doc_id, regexp_split_to_array(text, '\\r?\\n') AS ls FROM documents WHERE text IS NOT NULL)),
tok AS (SELECT DISTINCT path, no, unnest(regexp_extract_all(lower(line), '[a-z_][a-z0-9_]{2,}')) AS concept FROM ln),
ev AS (SELECT path, no AS line, 'mentions' AS linkage, concept FROM tok UNION ALL SELECT DISTINCT path, 1, 'defines', concept FROM tok)
"""
_IN = ", ".join(f"'{t}'" for t in TERMS)
_ORDER = "CASE concept_id " + " ".join(f"WHEN '{t}' THEN {i}" for i, t in enumerate(TERMS)) + " END"
_WEIGHT = "CASE linkage " + " ".join(f"WHEN '{v}' THEN {w}" for v, w in MULTI.items()) + " END"
_CALLS = "SELECT root, lower(trim(kind)) AS kind, invocation, lower(trim(source)) AS command, cardinality FROM (SELECT DISTINCT * EXCLUDE (received_at) FROM query_log)"
ORACLE = {
    "evidence_grep": _EVIDENCE
    + "SELECT DISTINCT path, CAST(ev.line AS INTEGER) AS line, linkage, concept, path AS entity FROM ev JOIN ln USING (path) WHERE ln.no = ev.line AND concept ILIKE '%watermark%' AND contains(ln.line, 'watermark')",
    "evidence_grep_words": _EVIDENCE
    + "SELECT DISTINCT path, CAST(ev.line AS INTEGER) AS line, linkage, concept, path AS entity FROM ev JOIN ln USING (path) WHERE ln.no = ev.line AND (concept ILIKE '%inlet marble%' OR concept = 'inlet_marble') AND regexp_matches(ln.line, '(?i)inlet[_\\-\\s]?marble') ORDER BY 1, 2, 3, 4 LIMIT 100",
    "evidence_grep_regex": _EVIDENCE
    + "SELECT DISTINCT path, CAST(ev.line AS INTEGER) AS line, linkage, concept, path AS entity FROM ev JOIN ln USING (path) WHERE ln.no = ev.line AND linkage = 'defines' AND regexp_matches(concept, '^water[a-z]+$|tombst') AND regexp_matches(ln.line, '^water[a-z]+$|tombst')",
    "repair_links": STORE + "SELECT linkage, concept_id, entity_id FROM lnk",
    "deferred_links": "WITH b AS (SELECT replace(lower(linkage), '_', '-') AS linkage, bit >> 32 AS concept_id, bit & 4294967295 AS entity_id, CAST(partition_id AS DOUBLE) AS weight, partition_id AS p FROM bitmap_fragments) SELECT linkage, concept_id, entity_id, arg_min(weight, (p % 3) * 1000 + p) AS weight FROM b GROUP BY 1, 2, 3",
    "bulk_write": "SELECT 'n' || i AS name, 2 AS n, CAST(2 * i AS BIGINT) AS total FROM range(25) r(i)",
    "add_memories": "SELECT coalesce(partition_id, 1) AS partition_id, 'doc/' || coalesce(lang, '-') AS name, md5(arg_max(text, doc_id)) AS md5 FROM documents GROUP BY 1, 2",
    "bulk_forget": ENT
    + " SELECT entity_id FROM mem JOIN ent e ON e.id = entity_id WHERE NOT (e.kind = 'memory' AND coalesce(e.protected, 0) = 0 AND name IS NOT NULL AND coalesce(mtype, '') LIKE 'obs%' AND coalesce(mem.updated_at < 1.77e9, false))",
    "rename_partition": "SELECT id, CASE WHEN id = 3 THEN 'renamed' ELSE name END AS name FROM partitions",
    "drop_vectors": ENT
    + " SELECT kind, count(CASE WHEN kind <> 'doc' THEN vectors_updated_at END) AS with_vector, count(*) AS n FROM ent GROUP BY 1",
    "snapshot": STORE + "SELECT linkage, count(*) AS n, max(entity_id) AS last FROM lnk GROUP BY 1",
    "subjects": ENT
    + " , t AS (SELECT e.id, partition_id, name, mtype, json_extract_string(CASE WHEN json_valid(metadata) THEN metadata END, '$.label') AS label FROM ent e JOIN mem m ON m.entity_id = e.id WHERE e.kind = 'memory'), f AS (SELECT partition_id, min(id) AS first FROM t WHERE mtype = 'decision' GROUP BY 1), l AS (SELECT first, count(*) AS n FROM t JOIN f USING (partition_id) WHERE t.id <> first GROUP BY 1) SELECT id, name, coalesce(nullif(label, ''), name) AS label, coalesce(n, 0) AS leaves FROM t LEFT JOIN l ON first = id WHERE mtype = 'decision'",
    "corpus": ENT
    + " , t AS (SELECT mtype, coalesce(mtype, '') AS k, NOT coalesce(regexp_matches(name, '(?i)^(session|digest)[-_]'), false) AND NOT coalesce(CASE WHEN json_valid(tags) AND json_type(tags) = 'ARRAY' THEN list_contains(CAST(CAST(tags AS JSON) AS VARCHAR[]), 'pattern') END, false) AS ok FROM mem JOIN ent e ON e.id = entity_id), "
    "u AS (SELECT mtype, ok AND k NOT IN ('session', 'digest', 'subject') AND k NOT LIKE 'session/%' AND k NOT LIKE 'digest/%' AS ok, k = 'impression' AS imp FROM t) SELECT mtype, CAST(count(*) FILTER (WHERE ok AND NOT imp) AS BIGINT) AS memory, CAST(count(*) FILTER (WHERE ok AND imp) AS BIGINT) AS pattern FROM u GROUP BY 1",
    "adoption": f"WITH c AS ({_CALLS}), "
    "n AS (SELECT root, count(*) AS total, count(*) FILTER (WHERE invocation = 'hook') AS hooks, count(*) FILTER (WHERE coalesce(kind <> 'scan', true)) AS lookups, count(*) FILTER (WHERE coalesce(kind <> 'scan', true) AND cardinality = 0) AS zero, "
    "concat_ws(', ', CASE WHEN count(*) FILTER (WHERE command = 'query') = 0 THEN 'query' END, CASE WHEN count(*) FILTER (WHERE command = 'grep-replica') = 0 THEN 'grep-replica' END, CASE WHEN count(*) FILTER (WHERE command = 'recall-hook') = 0 THEN 'recall-hook' END) AS unused FROM c GROUP BY 1), "
    "ent AS (SELECT DISTINCT * FROM entities), h AS (SELECT partition_id, count(*) AS n, count(*) FILTER (WHERE updated_at < created_at) AS stale FROM ent GROUP BY 1), f AS (SELECT p.id, root_path AS root, coalesce(n, 0) AS n, stale FROM partitions p LEFT JOIN h ON h.partition_id = p.id) "
    "SELECT root, 'no_hooks' AS kind, 'medium' AS severity, '' AS detail FROM n WHERE total > 0 AND hooks = 0 UNION ALL SELECT root, 'high_zero_result', 'medium', CAST(CAST(round(100.0 * zero / lookups) AS INT) AS VARCHAR) || '%' FROM n WHERE lookups > 0 AND zero / lookups >= 0.3 AND zero >= 5 "
    "UNION ALL SELECT root, 'underused_reads', 'low', unused FROM n WHERE total >= 20 AND unused <> '' UNION ALL SELECT root, 'daemon_down', 'high', '' FROM f WHERE id % 7 = 0 UNION ALL SELECT root, 'unsupervised', 'medium', '' FROM f WHERE id % 5 = 0 "
    "UNION ALL SELECT root, 'never_ingested', 'high', '' FROM f WHERE n = 0 UNION ALL SELECT root, 'stale', 'medium', CAST(stale AS VARCHAR) FROM f WHERE stale >= 10",
    "entity_texts": ENT
    + " , m1 AS (SELECT entity_id, any_value(content) AS content, any_value(mtype) AS mtype, any_value(tags) AS tags, count(*) AS n, count(content) AS c FROM mem GROUP BY 1), x AS (SELECT id, kind, CASE kind "
    "WHEN 'memory' THEN CASE WHEN c > 0 THEN trim('[' || coalesce(mtype, '') || '] ' || content || chr(10) || coalesce(tags, ''), ' ') ELSE coalesce(name, '') END "
    "WHEN 'concept' THEN coalesce(name, '') || CASE WHEN canonical_name <> '' AND canonical_name IS DISTINCT FROM name THEN ' ' || canonical_name ELSE '' END || CASE WHEN trim(coalesce(tldr, ''), ' ') <> '' THEN chr(10) || trim(tldr, ' ') ELSE '' END "
    "WHEN 'code' THEN trim(concat_ws(chr(10), nullif(name, ''), nullif(tldr, '')), ' ') WHEN 'doc' THEN trim(concat_ws(chr(10), nullif(name, ''), nullif(tldr, '')), ' ') ELSE '' END AS text FROM ent LEFT JOIN m1 ON entity_id = id) SELECT id, kind, md5(text) AS md5 FROM x WHERE text <> ''",
    "embed_entities": ENT
    + " , m1 AS (SELECT entity_id, count(content) AS c FROM mem GROUP BY 1) SELECT id, 256 AS dims, 1.0::DOUBLE AS squared FROM ent LEFT JOIN m1 ON entity_id = id WHERE (kind = 'memory' AND c > 0) OR trim(coalesce(name, '') || CASE kind WHEN 'concept' THEN coalesce(canonical_name, '') || coalesce(tldr, '') WHEN 'memory' THEN '' ELSE coalesce(tldr, '') END) <> ''",
    "term_rank_fusion": DOCS
    + f", r AS (SELECT entity_id, row_number() OVER (PARTITION BY concept_id ORDER BY weight DESC, entity_id) - 1 AS rank FROM men WHERE concept_id IN ({_IN})) SELECT entity_id, round(sum(1.0 / (60 + rank)), 6) AS score FROM r WHERE rank < 20 GROUP BY 1",
    "multi_rank": DOCS
    + f", o AS (SELECT * FROM lnk WHERE linkage IN ('mentions', 'lead')), dl AS (SELECT linkage, entity_id, sum(weight) AS dl FROM o GROUP BY 1, 2), st AS (SELECT linkage, count(*) AS n, avg(dl) AS avgdl FROM dl GROUP BY 1), "
    f"tf AS (SELECT linkage, {_ORDER} AS term, entity_id, sum(weight) AS tf FROM o WHERE concept_id IN ({_IN}) GROUP BY 1, 2, 3), df AS (SELECT linkage, term, count(*) AS df FROM tf GROUP BY 1, 2), "
    f"p AS (SELECT entity_id, linkage, term, {_WEIGHT} * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)) AS s FROM tf JOIN df USING (linkage, term) JOIN st USING (linkage) JOIN dl USING (linkage, entity_id)), "
    "v AS (SELECT entity_id, linkage, sum(s) AS s, count(DISTINCT term) AS own FROM p GROUP BY 1, 2), a AS (SELECT entity_id, count(DISTINCT term) AS n FROM p GROUP BY 1) "
    f"SELECT entity_id, round(sum(s) * power(any_value(n) / {len(TERMS)}.0, 3) * (max(own) / {len(TERMS)}.0), 6) AS score FROM v JOIN a USING (entity_id) GROUP BY 1",
    "composites": "WITH e AS (SELECT CAST(user_id AS VARCHAR) AS session, 'k' || json_extract_string(props, '$.k') || '-' || event_type AS token, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS turn FROM events), "
    "t AS (SELECT session, turn FROM e WHERE turn % 3 = 0), c AS (SELECT t.session, t.turn, token, count(*) AS n FROM t JOIN e ON e.session = t.session AND e.turn <= t.turn GROUP BY ALL), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY session, turn ORDER BY n DESC, token) AS k FROM c) SELECT session, CAST(turn AS BIGINT) AS turn, string_agg(token || '=' || n, ',' ORDER BY k) AS composite FROM r WHERE k <= 2 GROUP BY 1, 2",
}
