"""Context, descriptions and scans over the stored graph, and documents read as Markdown."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.functions import render
from threadloom.functions.clean import epoch_seconds
from threadloom.functions.names import CANDIDATE
from threadloom.graph import read, store_graph
from threadloom.operators import context, dsl, rank, vectors, walks
from threadloom.plans.retrieval import SHAPE_SQL
from threadloom.plans.set_algebra import A, STORE
from threadloom.plans.store_changes import _doc_concepts
from threadloom.plans.texts import _PARTS
from threadloom.sources import common, markdown
from threadloom.staging import spread


def context_links(spark, sf_dir):
    """Context from the links of a concept alone."""
    return context.context(store_graph(spark, sf_dir), A)


def _ranked(g):
    """The content ranking by the concepts of one name. They are as many as the store has under it, so they stay a table."""
    own = dsl.resolve(g, [A]).select(F.lit(0).alias("term"), "concept_id")
    return rank.content_rank(g.links, own, 1, null_tf=1.0, boosts={})


def context_content(spark, sf_dir):
    """Context from the links of a concept and a content ranking by its name."""
    g = store_graph(spark, sf_dir)
    return context.build_context(g, A, _ranked(g))


def context_bundle(spark, sf_dir):
    """The same with what a walk adds."""
    g = store_graph(spark, sf_dir)
    return context.build_context(g, A, _ranked(g), degree=2)


def describe(spark, sf_dir):
    g = store_graph(spark, sf_dir)
    return context.describe(g, A, read(spark, sf_dir, "memory_content").distinct()).select("section", "linkage", "other", "name")


def scan_prompts(spark, sf_dir):
    """The query texts of the log as prompts: the concepts worth showing for each."""
    prompts = read(spark, sf_dir, "query_log").filter("body IS NOT NULL").select(
        F.col("body").alias("prompt"), F.col("body").alias("text")
    ).distinct()
    return context.scan(store_graph(spark, sf_dir), prompts).select(
        "prompt", "place", "token", "concept_id", F.round("salience", 6).alias("salience")
    )


def match_prompts(spark, sf_dir):
    prompts = read(spark, sf_dir, "query_log").filter("body IS NOT NULL").select(
        F.col("body").alias("prompt"), F.col("body").alias("text")
    ).distinct()
    return context.match_prompt(store_graph(spark, sf_dir), prompts)


def locate(spark, sf_dir):
    return context.locate(store_graph(spark, sf_dir), A)


def _markdown(spark, sf_dir):
    files = read(spark, sf_dir, "documents").filter("text IS NOT NULL").select(
        F.concat_ws("-", F.coalesce("path", F.lit("doc")), "doc_id").alias("path"), "text"
    )
    return common.parsed(spread(files), markdown.parse)


def gmd_parse(spark, sf_dir):
    """Links of the documents, read as Markdown with a graph in it."""
    return common.links_of(_markdown(spark, sf_dir))


def gmd_nodes(spark, sf_dir):
    return common.entities_of(_markdown(spark, sf_dir)).select("path", "name", "tldr")


def compile_subjects(spark, sf_dir):
    """Embedded vectors and the entities of the same ids, clustered by vector and the concepts that they mention, with their labels."""
    v = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    members, labels = vectors.compile_subjects(v, _doc_concepts(spark, sf_dir))
    return vectors.subject_links(members, labels)


def context_text(spark, sf_dir):
    return render.bundle_text(context_bundle(spark, sf_dir))


def federated_query(spark, sf_dir):
    """One query over the partitions of two roots, as if they were separate stores."""
    g = store_graph(spark, sf_dir)
    return context.federated({"one": g.scoped(3), "two": g.scoped(2)}, "overview OR usage OR setup", 1000)


def concept_timeline(spark, sf_dir):
    """What happened to the files in a concept's footprint, in order of time, by the copy of the entities."""
    g = store_graph(spark, sf_dir)
    files = walks.footprint(g.links, dsl.resolve(g, [A]), 0, 1_000_000)
    rows = read(spark, sf_dir, "entities_replica").filter("path != ''")
    events = rows.select(epoch_seconds(F.col("updated_at")).alias("ts"), F.coalesce("kind", F.lit("?")).alias("what"), "path")
    return context.timeline(files, g.entities, events)


QUERIES = {
    f.__name__: f
    for f in (
        context_links, context_content, context_bundle, describe, scan_prompts, match_prompts, locate, gmd_parse, gmd_nodes, compile_subjects,
        context_text, federated_query, concept_timeline
    )
}
_ORDER = "CASE linkage " + " ".join(f"WHEN '{v}' THEN {i + 1}" for i, v in enumerate(context.LINKAGE_ORDER)) + " ELSE 99 END"


def _context_sql(content: bool) -> str:
    ranked = (
        ", st AS (SELECT count(DISTINCT entity_id) AS n, count(*) / count(DISTINCT entity_id) AS avgdl FROM lnk WHERE linkage = 'mentions'), dl AS (SELECT entity_id, count(*) AS dl FROM lnk WHERE linkage = 'mentions' GROUP BY 1), "
        "tf AS (SELECT entity_id, count(*) AS k FROM lnk WHERE linkage = 'mentions' AND concept_id IN (SELECT concept_id FROM i) GROUP BY 1), m AS (SELECT entity_id, k * ln((n - (SELECT count(*) FROM tf) + 0.5) / ((SELECT count(*) FROM tf) + 0.5) + 1) * 2.5 / (1 + 1.5 * 1.0) AS score FROM tf JOIN dl USING (entity_id), st ORDER BY 2 DESC, 1 LIMIT 50)"
        if content
        else ""
    )
    extra = " UNION ALL SELECT 1, 'content', entity_id, score FROM m" if content else ""
    return (
        STORE
        + f", i AS (SELECT concept_id FROM con WHERE name = '{A}' OR canonical_name = '{A}'){ranked}, r AS (SELECT linkage, entity_id, row_number() OVER (PARTITION BY linkage ORDER BY entity_id) AS k FROM (SELECT DISTINCT linkage, entity_id FROM lnk WHERE concept_id IN (SELECT concept_id FROM i))), "
        f"u AS (SELECT 0 AS source, linkage, entity_id, 0.0 AS score FROM r WHERE k <= 10{extra}), o AS (SELECT *, {_ORDER} AS ord FROM u), e AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY source, ord, linkage, score DESC) = 1), "
        "j AS (SELECT e.*, name, kind, CAST(floor(length(concat_ws(' ', name, coalesce(tldr, ''))) / 4) AS BIGINT) + 4 AS cost FROM e JOIN ent ON id = entity_id), "
        "f AS (SELECT *, row_number() OVER w AS place, sum(cost) OVER (w ROWS UNBOUNDED PRECEDING) AS used FROM j WINDOW w AS (ORDER BY source, ord, linkage, score DESC, entity_id)) SELECT place, source, linkage, entity_id, name, kind, CAST(used AS BIGINT) AS used FROM f WHERE used <= 2000 AND place <= 40"
    )


_CANON = "CASE WHEN len({p}) > 0 THEN array_to_string({p}, '_') ELSE lower(trim({x})) END"
_canon = lambda x: _CANON.format(x=x, p=_PARTS.format(x=x))
_SHAPE = SHAPE_SQL.replace("name", "token")
_MATCHES = (
    STORE
    + f", c AS (SELECT id, name, coalesce(canonical_name, {_canon('name')}) AS cn FROM ent WHERE kind = 'concept' AND coalesce(noise, 0) = 0), "
    f"t AS (SELECT prompt, token, {_canon('token')} AS tn FROM (SELECT body AS prompt, unnest(list_distinct(regexp_extract_all(body, '{CANDIDATE}'))) AS token "
    "FROM (SELECT DISTINCT body FROM query_log WHERE body IS NOT NULL)) WHERE length(token) >= 3), "
    "h AS (SELECT prompt, token, id, name, 0 AS step FROM t JOIN c ON token = name UNION ALL SELECT prompt, token, id, name, 1 FROM t JOIN c ON lower(token) = lower(name) "
    "UNION ALL SELECT prompt, token, id, name, 2 FROM t JOIN c ON tn = cn UNION ALL SELECT prompt, token, id, name, 3 FROM t JOIN c ON contains(name, '/') AND token = string_split(name, '/')[-1]), "
    "mp AS (SELECT prompt, token, id AS concept_id, name, step FROM h QUALIFY row_number() OVER (PARTITION BY prompt, token ORDER BY step, name, id) = 1)"
)
_SCAN = (
    _MATCHES
    + ", sg AS (SELECT concept_id, count(*) AS degree, count(*) FILTER (WHERE linkage = 'mentions') AS df FROM lnk GROUP BY 1), "
    "cf AS (SELECT CAST(count(*) AS DOUBLE) AS n_docs, coalesce(avg(CASE WHEN kind = 'code' THEN 1.0 ELSE 0.0 END), 1.0) AS code FROM ent WHERE kind <> 'concept'), "
    "x AS (SELECT prompt, token, string_split(string_split(token, '/')[-1], '::')[-1] AS leaf, mp.concept_id, name, coalesce(degree, 0) AS degree, coalesce(df, 0) AS df FROM mp LEFT JOIN sg USING (concept_id)), "
    f"y AS (SELECT *, {_SHAPE} AS shape FROM x), "
    "z AS (SELECT y.*, n_docs, code, (CASE WHEN degree > 0 THEN 2.0 + 0.1 * least(degree, 10) ELSE 0 END) * (CASE WHEN shape = 0 AND NOT contains(name, '/') THEN (CASE WHEN df > 0 THEN least(1.0, 1.0 / log2(9)) ELSE 0 END) ELSE 1 END) AS central FROM y, cf), "
    "s AS (SELECT prompt, token, concept_id, (0.3 + 0.7 * code) * central + code * 1.5 * (CASE WHEN df > 0 THEN 1 / log2(df + 2) ELSE 0.3 END) + (1 - code) * 0.25 * (CASE WHEN n_docs > 0 AND df > 0 THEN log2(greatest(1.0, n_docs / df)) ELSE 0 END) "
    "+ shape + CASE WHEN contains(name, '/') THEN 0.5 ELSE 0 END AS salience FROM z) "
    "SELECT prompt, row_number() OVER (PARTITION BY prompt ORDER BY round(salience, 9) DESC, concept_id) AS place, token, concept_id, round(salience, 6) AS salience FROM s WHERE salience >= 1.55 QUALIFY place <= 5"
)
ORACLE = {
    "match_prompts": _MATCHES + " SELECT prompt, token, concept_id, name, step FROM mp",
    "scan_prompts": _SCAN,
    "context_links": _context_sql(False),
    "context_content": _context_sql(True),
    "concept_timeline": STORE
    + f", i AS (SELECT concept_id FROM con WHERE name = '{A}' OR canonical_name = '{A}'), p AS (SELECT DISTINCT path AS own FROM ent WHERE path <> '' AND id IN (SELECT entity_id FROM lnk WHERE concept_id IN (SELECT concept_id FROM i))), "
    "v AS (SELECT CASE WHEN updated_at > 1e11 THEN updated_at / 1000 ELSE updated_at END AS ts, coalesce(kind, '?') AS what, path FROM entities_replica WHERE path <> '') "
    "SELECT DISTINCT ts, what, path, 0 AS hop FROM v JOIN p ON string_split(path, '/')[-1] = string_split(own, '/')[-1] AND (path = own OR ends_with(path, '/' || own) OR ends_with(own, '/' || path))",
    "federated_query": STORE
    + f", i AS (SELECT concept_id FROM con WHERE name IN ('overview', 'usage', 'setup') OR canonical_name IN ('overview', 'usage', 'setup')), s AS (SELECT p.k AS part, p.v AS project FROM (VALUES (3, 'one'), (2, 'two')) p(k, v)), f AS (SELECT DISTINCT project, l.entity_id, e.kind, e.name FROM lnk l JOIN ent e ON e.id = l.entity_id JOIN s ON s.part = e.partition_id JOIN ent c ON c.id = l.concept_id AND c.partition_id = s.part WHERE l.concept_id IN (SELECT concept_id FROM i)) SELECT project, entity_id, kind, name FROM f QUALIFY row_number() OVER (PARTITION BY kind, name, project ORDER BY entity_id) = 1 ORDER BY project, entity_id LIMIT 1000",
    "locate": STORE
    + f", i AS (SELECT concept_id FROM con WHERE name = '{A}' OR canonical_name = '{A}'), f AS (SELECT entity_id AS id FROM lnk WHERE linkage = 'defines' AND concept_id IN (SELECT concept_id FROM i) UNION SELECT id FROM ent WHERE name = '{A}' OR canonical_name = '{A}') SELECT id AS entity_id, name, kind, partition_id FROM ent JOIN f USING (id) QUALIFY row_number() OVER (PARTITION BY kind, name, partition_id ORDER BY id) = 1",
    "describe": STORE
    + f", m AS (SELECT id AS me, path FROM ent WHERE path LIKE '%{A}' OR lower(name) LIKE '%{A}%' ORDER BY CASE WHEN path = '{A}' THEN 1 WHEN name = '{A}' THEN 2 WHEN path LIKE '%/{A}' OR name LIKE '%/{A}' THEN 3 WHEN lower(name) LIKE '%{A}%' THEN 4 ELSE 9 END, id LIMIT 1), r AS (SELECT 'outbound' AS section, linkage, concept_id AS other FROM lnk JOIN m ON entity_id = me UNION ALL SELECT 'inbound', linkage, entity_id FROM lnk JOIN m ON concept_id = me UNION ALL SELECT 'same_path', NULL, e.id FROM ent e JOIN m ON e.path = m.path AND e.id <> me UNION ALL SELECT 'body', NULL, entity_id FROM (SELECT DISTINCT * FROM memory_content) JOIN m ON entity_id = me) SELECT section, linkage, other, name FROM r LEFT JOIN ent ON ent.id = other",
}
