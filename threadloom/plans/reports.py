"""Reports over logs and sessions, arms of the ranking, queues and small operators, over whole tables."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from threadloom.functions import names, text
from threadloom.functions.clean import time_ms
from threadloom.graph import read, store_graph
from threadloom.operators import analytics, dsl, mutate, rank, reports, vectors, walks
from threadloom.plans.core_problems import TIME_SQL
from threadloom.plans.graphs import _ADJ, _SEEDS, SEEDS
from threadloom.plans.readers import _CALLS, _transcripts
from threadloom.plans.retrieval import _IN, DOCS, TERMS, _bm25, _rounded, links, ranked
from threadloom.plans.set_algebra import STORE
from threadloom.plans.store_analytics import ENT, LOG, entities, log, memories
from threadloom.plans.store_changes import _vectors
from threadloom.plans.texts import _COREF
from threadloom.sources import sessions
from threadloom.streaming import sync

# --- reports ----------------------------------------------------------------------------------------------


def derivation_state(spark, sf_dir):
    """Which kinds of events are derived by their latest version; the stamps are the events."""
    ev = read(spark, sf_dir, "events")
    stamps = ev.select(
        F.col("event_type").alias("pass_name"), F.get_json_object("props", "$.k").alias("version"), F.lit("h").alias("code_hash"),
        F.col("event_id").cast("double").alias("derived_at")
    )
    wanted = ev.groupBy(F.col("event_type").alias("pass_name")).agg(
        F.max(F.get_json_object("props", "$.k")).alias("version")
    ).filter("pass_name != 'error'")
    never = spark.range(1).select(F.lit("missing").alias("pass_name"), F.lit("1").alias("version"))
    return reports.derivation_state(stamps, wanted.unionByName(never).withColumn("code_hash", F.lit("h")))


def _commands(spark, sf_dir):
    rows = log(spark, sf_dir).withColumn("t", time_ms(F.col("ts")) / 1000.0)
    argv = F.array("source", "kind")
    return rows.select(
        argv.alias("argv"), F.when(F.col("outcome") == "empty", "start").alias("phase"),
        F.when(F.col("error").isNotNull(), 2).otherwise(0).alias("exit_code"), "latency_ms", F.col("root").alias("session"),
        F.col("source").alias("command"), "t",
        F.when(F.col("cardinality") > 0, F.col("cardinality")).alias("out_bytes"),
    )


def command_summary(spark, sf_dir):
    return reports.command_summary(_commands(spark, sf_dir))


def context_cost(spark, sf_dir):
    return reports.context_cost(_commands(spark, sf_dir))[0]


def usage(spark, sf_dir):
    return reports.usage(log(spark, sf_dir), since="2026-03", until="2026-03-20")


def session_list(spark, sf_dir):
    """The sessions that ended last."""
    return reports.list_sessions(sessions.session_cards(_transcripts(spark, sf_dir)), 5, 30).select("session", "last_ts")


def session_recall(spark, sf_dir):
    """Sessions of one root whose prompts hold a word."""
    cards = sessions.session_cards(_transcripts(spark, sf_dir))
    return reports.recall_sessions(cards, "FAIL", project="/srv/work", k=1000).select("session", "last_ts")


def due_jobs(spark, sf_dir):
    """Roots as jobs that run every day: those whose last call is a day ago or more."""
    jobs = log(spark, sf_dir).select(
        F.col("root").alias("name"), (time_ms(F.col("ts")) / 1000.0).alias("t")
    ).groupBy("name").agg(F.max("t").alias("last_run")).withColumn("every_s", F.lit(86_400.0))
    return sync.due(jobs, 1_774_000_000.0).select("name")


# --- ranking --------------------------------------------------------------------------------------------------


def content_rank_surprisal(spark, sf_dir):
    """Frequencies weigh what they tell."""
    own = rank.surprising(links(spark, sf_dir)).filter(F.col("concept_id").isin(TERMS))
    index = links(spark, sf_dir).filter("linkage = 'mentions'").groupBy("entity_id").agg(F.max("dl").alias("dl")).agg(
        F.count(F.lit(1)), F.avg("dl")
    ).first()
    found = rank.content_rank(own, {t: i for i, t in enumerate(TERMS)}, len(TERMS), limit=None, boosts={}, corpus=tuple(index))
    return _rounded(found, "score")


NOUNS = ["Archive", "Access", "watermark"]


def content_rank_coref(spark, sf_dir):
    """Documents found by what their pronouns mean, beside what they mention."""
    own = links(spark, sf_dir).select("linkage", "concept_id", "entity_id", "weight")
    docs = read(spark, sf_dir, "documents")
    meant = text.antecedent_counts(text.with_pronouns(docs, "doc_id", "text"), "doc_id")
    both = own.unionByName(
        meant.select(F.lit("coref").alias("linkage"), F.col("concept").alias("concept_id"), F.col("doc_id").alias("entity_id"), "weight")
    )
    found = rank.content_rank(both, {t.lower(): i for i, t in enumerate(NOUNS)}, len(NOUNS), limit=None, boosts={}, coref=0.5)
    return _rounded(found, "score")


def hybrid(spark, sf_dir):
    """The ranking by words and that by nearness to a vector, fused."""
    v = _vectors(spark, sf_dir)
    dense = vectors.nearest(v, v.filter("id = 0").first()["vector"], 60).select(
        F.col("id").alias("entity_id"), rank.cosine_of_distance(F.col("distance")).alias("score")
    )
    return _rounded(rank.hybrid(ranked(spark, sf_dir, boosts={}, limit=60), dense, 20), "score")


def rerank(spark, sf_dir):
    """The best of a ranking again, by the length of their texts."""
    texts = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("entity_id"), "text")
    return _rounded(rank.rerank(ranked(spark, sf_dir, boosts={}), texts, lambda t: F.length(t).cast("double"), 10), "score")


def rescored(spark, sf_dir):
    """Entities by degree, raised and lowered by how far their concepts are reinforced."""
    g = store_graph(spark, sf_dir)
    scored = g.links.groupBy("entity_id").agg(F.count(F.lit(1)).cast("double").alias("score"))
    signals = analytics.reinforcement(g.links, g.entities, 0.0, halflife_days=0.0)
    return _rounded(analytics.rescored(scored, g.links.select("entity_id", "concept_id").distinct(), signals, 0.5), "score")


# --- graphs and changes -------------------------------------------------------------------------------------------


def clique(spark, sf_dir):
    """Edges around the seeds once the seeds are tied to each other."""
    g = store_graph(spark, sf_dir)
    seeds = dsl.resolve(g, SEEDS).select(F.col("concept_id").alias("id")).distinct()
    return walks.clique(walks.adjacency(g.links), seeds, 2.0).join(seeds.withColumnRenamed("id", "src"), "src", "left_semi")


def promote_edges(spark, sf_dir):
    """Kinds and sources of calls as working memory: the pairs that belong together most."""
    rows = log(spark, sf_dir).filter("kind IS NOT NULL AND source IS NOT NULL").select(
        F.concat(F.lit("k-"), "kind").alias("a"), F.concat(F.lit("s-"), "source").alias("b")
    )
    pairs = rows.groupBy("a", "b").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    nodes = rows.select(F.col("a").alias("name")).unionAll(rows.select("b")).groupBy("name").agg(F.count(F.lit(1)).alias("freq"))
    return mutate.promote_edges(pairs, nodes, 3.0, 20)


def fold_duplicates(spark, sf_dir):
    """Every memory has a concept of its name with the memory's own links doubled onto it; folded, the links are as before."""
    g = store_graph(spark, sf_dir)
    first = g.entities.filter("kind = 'memory' AND name IS NOT NULL").groupBy("partition_id", "name").agg(F.min("id").alias("id")).select("id")
    twin = g.entities.join(first, "id", "left_semi").select(*g.entities.columns).withColumn("kind", F.lit("concept")).withColumn(
        "id", F.col("id") + F.lit(1 << 40)
    )
    extra = g.links.join(
        twin.select((F.col("id") - F.lit(1 << 40)).alias("entity_id"), F.col("id").alias("to")), "entity_id"
    ).select("linkage", "concept_id", F.col("to").alias("entity_id"), F.lit(1.0).alias("weight"))
    folded = mutate.fold_duplicates(replace(g, entities=g.entities.unionByName(twin), links=g.links.unionByName(extra)))
    return folded.links.groupBy("linkage").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("entity_id").alias("entities"))


def learn_queue(spark, sf_dir):
    """Searches of the log as a queue, with lines that aren't JSON: the hits that a drain learns, each once."""
    rows = read(spark, sf_dir, "query_log").filter("body IS NOT NULL").select("query_id", "body", "cardinality").distinct()
    hit = F.array(
        F.struct(F.concat(F.lit("f"), F.col("cardinality")).alias("file"), F.col("cardinality").cast("string").alias("line")),
        F.struct(F.lit("g").alias("file"), F.lit("x").alias("line"))
    )
    line = F.when(F.col("cardinality") == 0, F.lit("{broken")).otherwise(F.to_json(F.struct(F.col("body").alias("pattern"), hit.alias("hits"))))
    queue = rows.select(F.abs(F.xxhash64("query_id")).alias("seq"), line.alias("value"))
    return sync.learned(sync.batch_of(queue, 100_000_000)[0].select("pattern", F.col("file").alias("path"), "line"))


def sync_plan(spark, sf_dir):
    """Entities of changed files taken out and put in again, from the copy."""
    stamp = lambda t: read(spark, sf_dir, t).filter("path != ''").groupBy("path").agg(F.max("created_at").alias("mtime"))
    plan = sync.plan_sync(stamp("entities_replica"), stamp("entities"))
    fresh = read(spark, sf_dir, "entities_replica").join(
        plan.filter("action = 'extract'").select("path"), "path", "left_semi"
    ).select("path", "id").distinct()
    tables = sync.apply_sync(
        {"entities": read(spark, sf_dir, "entities").filter("path != ''").select("path", "id").distinct()}, plan, {"entities": fresh}
    )
    return tables["entities"]


# --- small functions ---------------------------------------------------------------------------------------------------


def durations(spark, sf_dir):
    """Latencies written as durations, read again."""
    rows = read(spark, sf_dir, "query_log").filter("latency_ms >= 0").select("latency_ms").distinct()
    unit = F.element_at(F.array(*[F.lit(u) for u in "smhdw"]), (F.col("latency_ms") % 5 + 1).cast("int"))
    return rows.select("latency_ms", names.duration_seconds(F.concat(F.col("latency_ms").cast("string"), unit)).alias("seconds"))


def identifiers(spark, sf_dir):
    """How many different identifier candidates each memory holds."""
    rows = memories(spark, sf_dir).filter("content IS NOT NULL")
    return rows.select("entity_id", F.size(names.candidates(F.col("content"))).alias("n"))


def json_values(spark, sf_dir):
    """Metadata as JSON where it is JSON, else as a JSON string: what kind of value comes out."""
    rows = entities(spark, sf_dir).filter("meta IS NOT NULL").select("id", text.json_or_text(F.col("meta")).alias("v"))
    return rows.select("id", F.regexp_extract(F.schema_of_variant("v"), "^[A-Z]+", 0).alias("kind"))


QUERIES = {
    f.__name__: f
    for f in (
        derivation_state, command_summary, context_cost, usage, session_list, session_recall, due_jobs, content_rank_surprisal, content_rank_coref,
        hybrid, rerank, rescored, clique, promote_edges, fold_duplicates, learn_queue, sync_plan,
        durations, identifiers, json_values,
    )
}


def _at(p: float) -> str:
    return f"list_sort(list(latency_ms) FILTER (WHERE latency_ms IS NOT NULL))[CAST(least(count(latency_ms) - 1, floor({p} * count(latency_ms))) AS BIGINT) + 1]"


_PATHS = "a AS (SELECT path, max(created_at) AS t FROM entities_replica WHERE path <> '' GROUP BY 1), b AS (SELECT path, max(created_at) AS t FROM entities WHERE path <> '' GROUP BY 1), x AS (SELECT a.path FROM a LEFT JOIN b USING (path) WHERE b.path IS NULL OR abs(a.t - b.t) > 1e-6), p AS (SELECT path FROM b WHERE path NOT IN (SELECT path FROM a))"
_BYTES = _at(0.5).replace("latency_ms", "out_bytes"), _at(0.95).replace("latency_ms", "out_bytes")
_NOUNS = ", ".join(f"'{t.lower()}'" for t in NOUNS)
ORACLE = {
    "derivation_state": "WITH s AS (SELECT event_type AS p, arg_max(json_extract_string(props, '$.k'), event_id) AS v, max(json_extract_string(props, '$.k')) AS w FROM events GROUP BY 1) SELECT p AS pass_name, CASE WHEN p = 'error' THEN 'unknown' WHEN v = w THEN 'fresh' ELSE 'stale' END AS state FROM s UNION ALL SELECT 'missing', 'never'",
    "command_summary": LOG
    + f" SELECT source AS command, count(*) AS n, count(*) FILTER (WHERE error IS NOT NULL) AS errors, {_at(0.5)} AS p50, {_at(0.95)} AS p95 FROM lg WHERE outcome IS DISTINCT FROM 'empty' GROUP BY 1",
    "context_cost": LOG
    + f" , c AS (SELECT source AS command, CASE WHEN cardinality > 0 THEN cardinality END AS out_bytes FROM lg) SELECT command, count(*) AS n, count(*) FILTER (WHERE out_bytes IS NULL) AS unknown, CAST(sum(out_bytes) AS BIGINT) AS total, CAST(floor(avg(out_bytes)) AS BIGINT) AS mean, max(out_bytes) AS most, {_BYTES[0]} AS p50, {_BYTES[1]} AS p95 FROM c GROUP BY 1",
    "usage": LOG
    + ", w AS (SELECT * FROM lg WHERE ts >= '2026-03' AND ts < '2026-03-20') "
    + " UNION ALL ".join(
        f"SELECT '{d}' AS dimension, {d} AS key, count(*) AS n, {_at(0.5)} AS p50, {_at(0.95)} AS p95 FROM w WHERE {d} IS NOT NULL GROUP BY 2"
        for d in ("kind", "source", "invocation", "outcome")
    ),
    "session_list": _CALLS
    + ", d AS (SELECT session, max(stamp) AS last_ts FROM s GROUP BY 1) SELECT * FROM d ORDER BY last_ts DESC NULLS LAST, session LIMIT 30 OFFSET 5",
    "session_recall": _CALLS
    + "SELECT session, max(stamp) AS last_ts FROM s WHERE contains(cwd, '/srv/work') GROUP BY 1 HAVING bool_or(contains(lower(body), 'fail'))",
    "due_jobs": LOG
    + f" , t AS (SELECT root AS name, max({TIME_SQL}) / 1000.0 AS last FROM lg GROUP BY 1) SELECT name FROM t WHERE last IS NULL OR 1774000000.0 - last >= 86400",
    "content_rank_surprisal": DOCS
    + ", tl AS (SELECT tf, sum(n) OVER (ORDER BY tf DESC) / sum(n) OVER () AS tail FROM (SELECT weight AS tf, count(*) AS n FROM men GROUP BY 1)), wt AS (SELECT concept_id, entity_id, 1 - log2(tail) AS w FROM men JOIN tl ON tf = weight)"
    + f", st AS (SELECT count(DISTINCT entity_id) AS n, sum(weight) / count(DISTINCT entity_id) AS avgdl FROM men), dl AS (SELECT entity_id, sum(weight) AS dl FROM men GROUP BY 1), d AS (SELECT concept_id, ln((any_value(n) - count(*) + 0.5) / (count(*) + 0.5) + 1) AS idf FROM men, st WHERE concept_id IN ({_IN}) GROUP BY 1) "
    f"SELECT entity_id, round(sum(idf * w * 2.5 / (w + 1.5 * (0.25 + 0.75 * dl / avgdl))) * power(count(*) / {len(TERMS)}.0, 3), 6) AS score FROM wt JOIN d USING (concept_id) JOIN dl USING (entity_id), st GROUP BY 1",
    "content_rank_coref": DOCS
    + ", "
    + _COREF.strip().removeprefix("WITH ")
    + f", cl AS (SELECT doc_id AS entity_id, lower(antecedent) AS concept_id, least(count(*), 3) AS c FROM found WHERE lower(antecedent) IN ({_NOUNS}) GROUP BY 1, 2), st AS (SELECT count(DISTINCT entity_id) AS n, sum(weight) / count(DISTINCT entity_id) AS avgdl FROM men), dl AS (SELECT entity_id, sum(weight) AS dl FROM men GROUP BY 1), "
    f"q AS (SELECT unnest([{_NOUNS}]) AS concept_id), x AS (SELECT concept_id, count(entity_id) AS df FROM q LEFT JOIN men USING (concept_id) GROUP BY 1), id AS (SELECT concept_id, ln((any_value(n) - any_value(df) + 0.5) / (any_value(df) + 0.5) + 1) AS idf FROM x, st GROUP BY 1), "
    f"s1 AS (SELECT entity_id, sum(idf * weight * 2.5 / (weight + 1.5 * (0.25 + 0.75 * dl / avgdl))) * power(count(*) / {len(NOUNS)}.0, 3) AS score FROM men JOIN id USING (concept_id) JOIN dl USING (entity_id), st GROUP BY 1), s2 AS (SELECT entity_id, sum(0.5 * idf * c) AS extra FROM cl JOIN id USING (concept_id) GROUP BY 1) "
    "SELECT coalesce(s1.entity_id, s2.entity_id) AS entity_id, round(coalesce(score, 0) + coalesce(extra, 0), 6) AS score FROM s1 FULL JOIN s2 ON s1.entity_id = s2.entity_id",
    "hybrid": DOCS
    + _bm25(limit=60)
    + ", a AS (SELECT entity_id, row_number() OVER (ORDER BY score DESC, entity_id) - 1 AS r FROM q), v AS (SELECT vec_id AS entity_id, list_sum(list_transform(list_zip(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)), lambda p: (p[1] - p[2]) ** 2)) AS d FROM embeddings), "
    "b AS (SELECT entity_id, row_number() OVER (ORDER BY d, entity_id) - 1 AS r FROM v QUALIFY r < 60), f AS (SELECT entity_id, sum(1.0 / (60 + r)) AS s FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1) SELECT entity_id, round(s, 6) AS score FROM f ORDER BY s DESC, entity_id LIMIT 20",
    "rerank": DOCS
    + _bm25()
    + ", a AS (SELECT entity_id, row_number() OVER (ORDER BY score DESC, entity_id) AS p, text FROM q LEFT JOIN documents ON doc_id = entity_id), n AS (SELECT *, CASE WHEN p <= 20 AND text IS NOT NULL THEN CAST(length(text) AS DOUBLE) END AS s FROM a) SELECT entity_id, round(coalesce(s, (SELECT coalesce(min(s), 0) FROM n) - 1e-6 * p), 6) AS score FROM n ORDER BY coalesce(s, (SELECT coalesce(min(s), 0) FROM n) - 1e-6 * p) DESC, entity_id LIMIT 10",
    "rescored": STORE
    + ", g AS (SELECT concept_id, least(5, greatest(-5, sum(CASE linkage WHEN 'reinforces' THEN 1.0 ELSE -1.0 END))) AS sig FROM lnk WHERE linkage IN ('reinforces', 'contradicts') GROUP BY 1), d AS (SELECT DISTINCT entity_id, concept_id FROM lnk), e AS (SELECT entity_id, sum(sig) AS s FROM d JOIN g USING (concept_id) GROUP BY 1), n AS (SELECT entity_id, count(*) AS n FROM lnk GROUP BY 1), t AS (SELECT entity_id, n, coalesce(s, 0) / 5 AS x FROM n LEFT JOIN e USING (entity_id)) "
    "SELECT entity_id, round(n * (1 + 0.5 * (exp(x) - exp(-x)) / (exp(x) + exp(-x))), 6) AS score FROM t",
    "clique": _ADJ
    + f", {_SEEDS}, k AS (SELECT id FROM sd WHERE id IN (SELECT src FROM adj)), x AS (SELECT src, dst, weight FROM adj WHERE src IN (SELECT id FROM sd) UNION ALL SELECT a.id, b.id, 2.0 FROM k a JOIN k b ON a.id <> b.id) SELECT src, dst, sum(weight) AS weight FROM x GROUP BY 1, 2",
    "promote_edges": LOG
    + " , r AS (SELECT 'k-' || kind AS a, 's-' || source AS b FROM lg WHERE kind IS NOT NULL AND source IS NOT NULL), p AS (SELECT a, b, CAST(count(*) AS DOUBLE) AS weight FROM r GROUP BY 1, 2), f AS (SELECT name, count(*) AS freq FROM (SELECT a AS name FROM r UNION ALL SELECT b FROM r) GROUP BY 1), t AS (SELECT p.*, weight / (x.freq * y.freq) AS lift FROM p JOIN f x ON x.name = a JOIN f y ON y.name = b WHERE weight >= 3 ORDER BY lift DESC, weight DESC, a, b LIMIT 20) SELECT a, b, weight FROM t UNION ALL SELECT b, a, weight FROM t",
    "fold_duplicates": STORE
    + ", pr AS (SELECT c.id AS f, min(m.id) AS t FROM ent c JOIN ent m ON c.partition_id = m.partition_id AND c.name = m.name WHERE c.kind = 'concept' AND m.kind = 'memory' GROUP BY 1), x AS (SELECT DISTINCT linkage, coalesce(a.t, concept_id) AS c, coalesce(b.t, entity_id) AS e FROM lnk LEFT JOIN pr a ON a.f = concept_id LEFT JOIN pr b ON b.f = entity_id) "
    "SELECT linkage, count(*) AS n, count(DISTINCT e) AS entities FROM x WHERE c <> e GROUP BY 1",
    "learn_queue": "SELECT DISTINCT 'query/' || lower(trim(body, ' ')) AS concept, 'f' || cardinality AS path, cardinality AS line FROM query_log WHERE body <> '' AND cardinality <> 0",
    "sync_plan": f"WITH {_PATHS} SELECT DISTINCT path, id FROM entities WHERE path <> '' AND path NOT IN (SELECT path FROM x) AND path NOT IN (SELECT path FROM p) UNION ALL SELECT DISTINCT path, id FROM entities_replica WHERE path IN (SELECT path FROM x)",
    "durations": "SELECT DISTINCT latency_ms, CAST(latency_ms AS DOUBLE) * [1, 60, 3600, 86400, 604800][latency_ms % 5 + 1] AS seconds FROM query_log WHERE latency_ms >= 0",
    "identifiers": ENT
    + f" SELECT entity_id, CAST(len(list_distinct(regexp_extract_all(content, '{names.CANDIDATE}'))) AS INTEGER) AS n FROM mem WHERE content IS NOT NULL",
    "json_values": ENT
    + " SELECT id, CASE WHEN NOT json_valid(meta) THEN 'STRING' ELSE CASE json_type(meta) WHEN 'OBJECT' THEN 'OBJECT' WHEN 'ARRAY' THEN 'ARRAY' WHEN 'VARCHAR' THEN 'STRING' WHEN 'BOOLEAN' THEN 'BOOLEAN' WHEN 'NULL' THEN 'VOID' WHEN 'DOUBLE' THEN 'DECIMAL' ELSE 'BIGINT' END END AS kind FROM ent WHERE meta IS NOT NULL",
}
