"""Statistics, facets, telemetry, channels, windows and filters over the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions.clean import folded, time_ms
from threadloom.graph import read, store_graph
from threadloom.operators import analytics as an
from threadloom.plans.core_problems import TIME_SQL
from threadloom.plans.set_algebra import STORE

NOW = 1_775_000_000.0


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "entities").distinct()


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "memory_content").distinct()


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query log, each delivery once, kinds and sources in one spelling."""
    rows = read(spark, sf_dir, "query_log").drop("received_at").distinct()
    return rows.withColumns(
        {"kind": folded(F.col("kind")), "source": folded(F.col("source")), "latency_ms": F.when(F.col("latency_ms") >= 0, F.col("latency_ms"))}
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as a message channel: seq, channel, agent, status."""
    status = F.when(F.col("event_id") % 10 == 0, "deleted").when(F.col("event_id") % 4 == 0, "archived").otherwise("active")
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), F.col("event_type").alias("channel"), F.col("user_id").alias("sender"), "ts", "value", status.alias("status")
    )


def cursors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each sender has read its channels up to its own last message."""
    return messages(spark, sf_dir).groupBy(F.col("sender").alias("agent"), "channel").agg(F.max("seq").alias("last_seq"))


def store_stats(spark, sf_dir):
    g = store_graph(spark, sf_dir)
    return an.store_stats(g.entities, g.links)


def code_fraction(spark, sf_dir):
    return an.code_fraction(entities(spark, sf_dir)).select(F.round("code_fraction", 6).alias("code_fraction"))


def concept_density(spark, sf_dir):
    rows = an.concept_density(store_graph(spark, sf_dir).links)
    return rows.select(
        "concept_id", "total",
        F.array_join(F.transform("per_linkage", lambda x: F.concat(x["linkage"], F.lit("="), x["n"].cast("string"))), ",").alias("per_linkage")
    )


def primer(spark, sf_dir):
    """The most referenced concepts, as far as 400 estimated tokens go."""
    g = store_graph(spark, sf_dir)
    rows = an.concept_density(g.links).filter("total >= 3").join(g.concepts(), "concept_id").select("concept_id", "name", "total").orderBy(
        F.desc("total"), "name", "concept_id"
    ).limit(200)
    return an.budget_prefix(
        rows, [], [F.desc("total"), F.col("name"), F.col("concept_id")], F.floor(F.length("name") / 4) + 1, 400, 100
    ).select("concept_id", "name", "total")


def facets(spark, sf_dir):
    return an.facets(memories(spark, sf_dir))


def noise_prune(spark, sf_dir):
    g = store_graph(spark, sf_dir)
    return an.noise_marks(g.entities, g.links)


def same_as_audit(spark, sf_dir):
    return an.same_as_audit(store_graph(spark, sf_dir).links)


def derive_counts(spark, sf_dir):
    g = store_graph(spark, sf_dir)
    return an.structural_counts(g.entities, g.links, memories(spark, sf_dir))


def partition_audit(spark, sf_dir):
    g = store_graph(spark, sf_dir)
    return an.partition_audit(g.entities, g.links, read(spark, sf_dir, "partitions"))


def reinforcement(spark, sf_dir):
    g = store_graph(spark, sf_dir)
    e = g.entities.withColumn("created_at", F.when(F.col("created_at") > 1e11, F.col("created_at") / 1000).otherwise(F.col("created_at")))
    return an.reinforcement(g.links, e, NOW).select("concept_id", F.round("signal", 6).alias("signal"))


def telemetry_summary(spark, sf_dir):
    rows = log(spark, sf_dir)
    out = None
    for d in ("kind", "source", "outcome"):
        part = an.telemetry_summary(rows.filter(F.col(d).isNotNull()), d).select(F.lit(d).alias("dimension"), "key", "n", "zero", "p50", "p95", "p99")
        out = part if out is None else out.unionByName(part)
    return out


def top_queries(spark, sf_dir):
    return an.top_queries(log(spark, sf_dir))


def zero_results(spark, sf_dir):
    return an.top_queries(log(spark, sf_dir), zero_only=True)


def anchored_windows(spark, sf_dir):
    """Windows of 5 seconds that open at a call, per source: how many calls each holds."""
    rows = log(spark, sf_dir).select("source", (time_ms(F.col("ts")) / 1000.0).alias("t")).filter("t IS NOT NULL AND source IS NOT NULL")
    return an.anchored_windows(rows, "source", "t").groupBy("source", "window_start").agg(F.count(F.lit(1)).alias("n"))


def channel_stats(spark, sf_dir):
    return an.channel_stats(messages(spark, sf_dir))


def bus_unread(spark, sf_dir):
    return an.unread(messages(spark, sf_dir), cursors(spark, sf_dir))


def bus_read(spark, sf_dir):
    """The next 50 messages of one agent, on all channels."""
    return an.read_channel(messages(spark, sf_dir), cursors(spark, sf_dir).filter("last_seq < 5000"), 7, "*", 50)[0].select("seq", "channel")


def bus_read_cursor(spark, sf_dir):
    return an.read_channel(messages(spark, sf_dir), cursors(spark, sf_dir).filter("last_seq < 5000"), 7, "*", 50)[1].select("channel", "last_seq")


def budget_prefix(spark, sf_dir):
    """Documents of each source, shortest first, as far as 5000 estimated tokens and 20 documents go."""
    docs = read(spark, sf_dir, "documents").filter("source IS NOT NULL").select("source", "doc_id", F.floor(F.length("text") / 4).alias("cost"))
    return an.budget_prefix(
        docs, ["source"], [F.col("cost"), F.col("doc_id")], F.coalesce("cost", F.lit(0)), 5000, 20
    ).select("source", "doc_id", "used", "place")


def dedup_first_seen(spark, sf_dir):
    rows = log(spark, sf_dir).filter("body IS NOT NULL").select("body", "query_id")
    return an.first_seen(rows, ["body"], [F.col("query_id")])


def without_repeats(spark, sf_dir):
    ev = read(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return an.without_repeats(ev, ["user_id"], [F.col("event_id")], "event_type")


def around_errors(spark, sf_dir):
    ev = read(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return an.around(ev, ["user_id"], [F.col("event_id")], F.col("event_type") == "error", 1)


def turn_assignment(spark, sf_dir):
    ev = read(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return an.turns(ev, ["user_id"], [F.col("event_id")], F.col("event_type") == "signup")


def session_stats(spark, sf_dir):
    ev = read(spark, sf_dir, "events").select(
        F.col("user_id").alias("session"), F.when(F.col("event_type") == "signup", "prompt").otherwise(F.col("event_type")).alias("kind"),
        (F.col("event_type") != "error").alias("ok")
    )
    rows = an.session_stats(ev, "session", "kind", "ok")
    return rows.withColumn("tools", F.array_join(F.transform("tools", lambda x: F.concat(x["kind"], F.lit("="), x["n"].cast("string"))), ","))


def scope_round_robin(spark, sf_dir):
    """Names of memories, in turn from partitions by kind."""
    e = entities(spark, sf_dir).filter("kind = 'memory' AND name IS NOT NULL").join(
        read(spark, sf_dir, "partitions").select(F.col("id").alias("partition_id"), F.col("kind").alias("scope")), "partition_id"
    )
    return an.round_robin(e.select("scope", "name", "id"), "scope", "name", [F.col("id")], 60)


def history_cap(spark, sf_dir):
    e = entities(spark, sf_dir).select("partition_id", "kind", "id", "updated_at")
    return an.retained(e, ["partition_id", "kind"], [F.desc("updated_at"), F.col("id")], 3).select("partition_id", "kind", "id")


def selector_filter(spark, sf_dir):
    return an.select_entities(
        entities(spark, sf_dir), like="import/*", ns="import", kind="concept", protected=False, noise=False
    ).select("id", "name")


def tag_filter(spark, sf_dir):
    return an.tagged(memories(spark, sf_dir), ["curtain", "jungle", "inlet"], any_of=True).select("entity_id")


def mtype_filter(spark, sf_dir):
    return an.without_types(memories(spark, sf_dir), ["session/*", "feed?ack"]).select("entity_id", "mtype")


def recent_window(spark, sf_dir):
    m = memories(spark, sf_dir).withColumn(
        "created_at", F.when(F.col("created_at") > 1e11, F.col("created_at") / 1000).otherwise(F.col("created_at"))
    )
    return an.recent(m, NOW, 30 * 86400.0, 100).select("entity_id")


def stale_files(spark, sf_dir):
    """Document entities against the documents: paths that are gone, or whose text was collected after the last update."""
    tracked = entities(spark, sf_dir).filter("kind = 'doc' AND path != ''").groupBy(
        F.concat(F.lit("/"), "path").alias("path")
    ).agg(F.max("updated_at").alias("last_synced"))
    disk = read(spark, sf_dir, "documents").filter("path != ''").groupBy(F.concat(F.lit("/"), "path").alias("path")).agg(
        F.max(F.unix_micros(F.col("collected_at").cast("timestamp")) / 1e6).alias("mtime")
    )
    return an.stale(tracked, disk)


QUERIES = {
    f.__name__: f
    for f in (
        store_stats, code_fraction, concept_density, primer, facets, noise_prune, same_as_audit, derive_counts, partition_audit, reinforcement,
        telemetry_summary, top_queries, zero_results, anchored_windows,
        channel_stats, bus_unread, bus_read, bus_read_cursor, budget_prefix, dedup_first_seen, without_repeats, around_errors, turn_assignment,
        session_stats, scope_round_robin, history_cap, selector_filter,
        tag_filter, mtype_filter, recent_window, stale_files,
    )
}

ENT = "WITH ent AS (SELECT DISTINCT * FROM entities), mem AS (SELECT DISTINCT * FROM memory_content)"
LOG = "WITH lg AS (SELECT DISTINCT query_id, ts, lower(trim(kind)) AS kind, lower(trim(source)) AS source, invocation, root, body, cardinality, CASE WHEN latency_ms >= 0 THEN latency_ms END AS latency_ms, outcome, answered_by, error FROM query_log)"
BUS = """WITH msg AS (SELECT event_id AS seq, event_type AS channel, user_id AS sender, ts, CASE WHEN event_id % 10 = 0 THEN 'deleted' WHEN event_id % 4 = 0 THEN 'archived' ELSE 'active' END AS status FROM events),
cur AS (SELECT sender AS agent, channel, max(seq) AS last_seq FROM msg GROUP BY 1, 2)"""
_READ = BUS + ", m7 AS (SELECT channel, last_seq FROM cur WHERE last_seq < 5000 AND agent = 7), r AS (SELECT seq, msg.channel, last_seq FROM msg LEFT JOIN m7 USING (channel) WHERE status = 'active' AND seq > coalesce(last_seq, 0)), got AS (SELECT * FROM r ORDER BY seq LIMIT 50)"
_SEC = "CASE WHEN {c} > 1e11 THEN {c} / 1000 ELSE {c} END"
_SUMMARY = " UNION ALL ".join(
    f"(SELECT '{d}' AS dimension, key, n, zero, p50, p95, p99 FROM (SELECT {d} AS key, count(*) AS n, CAST(sum(CASE WHEN cardinality = 0 THEN 1 ELSE 0 END) AS BIGINT) AS zero, list_sort(list(latency_ms) FILTER (WHERE latency_ms IS NOT NULL)) AS l FROM lg WHERE {d} IS NOT NULL GROUP BY 1), "
    "LATERAL (SELECT l[least(len(l), floor(0.5 * len(l)) + 1)::INT] AS p50, l[least(len(l), floor(0.95 * len(l)) + 1)::INT] AS p95, l[least(len(l), floor(0.99 * len(l)) + 1)::INT] AS p99))"
    for d in ("kind", "source", "outcome")
)
_EV = "SELECT user_id, event_id, event_type"
ORACLE = {
    "store_stats": STORE
    + "SELECT 'kind' AS what, kind AS name, count(*) AS n, CAST(NULL AS BIGINT) AS concepts FROM ent GROUP BY 2 UNION ALL SELECT 'linkage', linkage, count(*), count(DISTINCT concept_id) FROM lnk GROUP BY 2",
    "code_fraction": ENT + " SELECT round(avg(CASE WHEN kind = 'code' THEN 1.0 ELSE 0.0 END), 6) AS code_fraction FROM ent WHERE kind <> 'concept'",
    "concept_density": STORE
    + ", c AS (SELECT concept_id, linkage, count(*) AS n FROM lnk GROUP BY 1, 2) SELECT concept_id, CAST(sum(n) AS BIGINT) AS total, string_agg(linkage || '=' || n, ',' ORDER BY linkage) AS per_linkage FROM c GROUP BY 1",
    "primer": STORE
    + ", c AS (SELECT concept_id, name, count(*) AS total FROM lnk JOIN con USING (concept_id) GROUP BY 1, 2 HAVING count(*) >= 3 ORDER BY 3 DESC, 2, 1 LIMIT 200), u AS (SELECT *, sum(length(name) // 4 + 1) OVER w AS used, row_number() OVER w AS place FROM c WINDOW w AS (ORDER BY total DESC, name, concept_id)) SELECT concept_id, name, total FROM u WHERE used <= 400 AND place <= 100",
    "facets": ENT
    + ", t AS (SELECT 'mtype' AS facet, mtype AS value FROM mem UNION ALL SELECT 'tag', unnest(CAST(CAST(tags AS JSON) AS VARCHAR[])) FROM mem WHERE json_valid(tags) AND json_type(tags) = 'ARRAY') SELECT facet, value, count(*) AS n FROM t WHERE facet = 'mtype' OR value <> '' GROUP BY 1, 2",
    "noise_prune": STORE
    + ", d AS (SELECT concept_id, count(DISTINCT entity_id) AS df FROM lnk GROUP BY 1), m AS (SELECT greatest(2, floor(count(*) * 0.25)) AS most FROM ent WHERE kind <> 'concept') SELECT e.id AS concept_id, coalesce(df, 0) AS df, CASE WHEN coalesce(protected, 0) = 0 AND (coalesce(df, 0) < 2 OR coalesce(df, 0) > (SELECT most FROM m)) THEN 1 ELSE 0 END AS noise FROM ent e LEFT JOIN d ON d.concept_id = e.id WHERE kind = 'concept'",
    "same_as_audit": STORE
    + "SELECT variants, count(*) AS canonicals FROM (SELECT concept_id, count(DISTINCT entity_id) AS variants FROM lnk WHERE linkage = 'same-as' GROUP BY 1) GROUP BY 1",
    "derive_counts": STORE
    + "SELECT kind AS counter, count(*) AS n FROM ent WHERE kind IN ('doc', 'code', 'concept', 'memory') GROUP BY 1 UNION ALL SELECT 'links', count(*) FROM lnk UNION ALL SELECT 'memories', count(*) FROM (SELECT DISTINCT * FROM memory_content) UNION ALL SELECT 'protected', count(*) FROM ent WHERE protected = 1 UNION ALL SELECT 'noise', count(*) FROM ent WHERE noise = 1 UNION ALL SELECT 'with_canonical', count(*) FROM ent WHERE canonical_name IS NOT NULL",
    "partition_audit": STORE
    + ", o AS (SELECT partition_id, count(*) AS entities, CAST(sum(CASE WHEN kind = 'concept' THEN 1 ELSE 0 END) AS BIGINT) AS concepts FROM ent GROUP BY 1), b AS (SELECT partition_id, count(*) AS links FROM lnk JOIN ent ON id = entity_id GROUP BY 1) SELECT coalesce(o.partition_id, p.id) AS partition_id, coalesce(entities, 0) AS entities, coalesce(concepts, 0) AS concepts, coalesce(links, 0) AS links, CASE WHEN p.id IS NULL THEN entities ELSE 0 END AS orphans FROM o LEFT JOIN b USING (partition_id) FULL JOIN partitions p ON p.id = o.partition_id",
    "reinforcement": STORE
    + f", r AS (SELECT concept_id, sum((CASE WHEN linkage = 'reinforces' THEN 1.0 ELSE -1.0 END) * power(2.0, -greatest(0.0, {NOW} - coalesce({_SEC.format(c='created_at')}, {NOW})) / 86400.0 / 30.0)) AS s FROM lnk JOIN ent ON id = entity_id WHERE linkage IN ('reinforces', 'contradicts') GROUP BY 1) SELECT concept_id, round(greatest(-5.0, least(5.0, s)), 6) AS signal FROM r",
    "telemetry_summary": LOG + " " + _SUMMARY,
    "top_queries": LOG + " SELECT body, count(*) AS n FROM lg WHERE body IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20",
    "zero_results": LOG + " SELECT body, count(*) AS n FROM lg WHERE body IS NOT NULL AND cardinality = 0 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20",
    "anchored_windows": LOG.replace("WITH ", "WITH RECURSIVE ", 1)
    + f""" , d AS (SELECT source, t, count(*) AS n FROM (SELECT source, {TIME_SQL} / 1000.0 AS t FROM lg WHERE source IS NOT NULL) WHERE t IS NOT NULL GROUP BY 1, 2),
nx AS (SELECT source, t, min(t) OVER (PARTITION BY source ORDER BY t RANGE BETWEEN 5.0005 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM d),
w AS (SELECT source, min(t) AS start FROM d GROUP BY 1 UNION ALL SELECT w.source, nx.nxt FROM w JOIN nx ON nx.source = w.source AND nx.t = w.start WHERE nx.nxt IS NOT NULL)
SELECT d.source, w.start AS window_start, CAST(sum(n) AS BIGINT) AS n FROM d ASOF JOIN w ON d.source = w.source AND d.t >= w.start GROUP BY 1, 2""",
    "channel_stats": BUS
    + " SELECT channel, count(*) AS n, count(*) FILTER (WHERE status = 'active') AS active, count(*) FILTER (WHERE status = 'archived') AS archived, count(*) FILTER (WHERE status = 'deleted') AS deleted, max(seq) AS last_seq FROM msg GROUP BY 1",
    "bus_unread": BUS
    + " SELECT agent, cur.channel, count(*) FILTER (WHERE seq > last_seq AND status = 'active') AS unread FROM cur LEFT JOIN msg ON cur.channel = msg.channel GROUP BY 1, 2",
    "bus_read": _READ + " SELECT seq, channel FROM got",
    "bus_read_cursor": _READ
    + " SELECT channel, greatest(coalesce(max(last_seq), 0), least(max(seq), (SELECT max(seq) FROM got))) AS last_seq FROM r GROUP BY 1",
    "budget_prefix": "WITH u AS (SELECT source, doc_id, CAST(sum(coalesce(length(text) // 4, 0)) OVER w AS BIGINT) AS used, row_number() OVER w AS place FROM documents WHERE source IS NOT NULL WINDOW w AS (PARTITION BY source ORDER BY length(text) // 4 NULLS FIRST, doc_id ROWS UNBOUNDED PRECEDING)) SELECT * FROM u WHERE used <= 5000 AND place <= 20",
    "dedup_first_seen": LOG + " SELECT body, min(query_id) AS query_id FROM lg WHERE body IS NOT NULL GROUP BY 1",
    "without_repeats": f"{_EV} FROM ({_EV}, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events) WHERE b IS NULL OR b <> event_type",
    "around_errors": f"{_EV} FROM ({_EV}, max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS h FROM events) WHERE h = 1",
    "turn_assignment": f"{_EV}, CAST(sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS turn FROM events",
    "session_stats": "WITH k AS (SELECT user_id AS session, CASE WHEN event_type = 'signup' THEN 'prompt' ELSE event_type END AS kind, count(*) AS n FROM events GROUP BY 1, 2) SELECT session, CAST(sum(CASE WHEN kind = 'prompt' THEN n ELSE 0 END) AS BIGINT) AS turns, CAST(sum(CASE WHEN kind <> 'prompt' THEN n ELSE 0 END) AS BIGINT) AS actions, CAST(sum(CASE WHEN kind = 'error' THEN n ELSE 0 END) AS BIGINT) AS errors, string_agg(kind || '=' || n, ',' ORDER BY kind) AS tools FROM k GROUP BY 1",
    "scope_round_robin": ENT
    + ", r AS (SELECT p.kind AS scope, e.name, row_number() OVER (PARTITION BY p.kind ORDER BY e.id) AS place FROM ent e JOIN partitions p ON p.id = partition_id WHERE e.kind = 'memory' AND e.name IS NOT NULL) SELECT name, place, scope FROM r QUALIFY row_number() OVER (PARTITION BY name ORDER BY place, scope) = 1 ORDER BY place, scope, name LIMIT 60",
    "history_cap": ENT
    + " SELECT partition_id, kind, id FROM ent QUALIFY row_number() OVER (PARTITION BY partition_id, kind ORDER BY updated_at DESC NULLS LAST, id) <= 3",
    "selector_filter": ENT
    + " SELECT id, name FROM ent WHERE name LIKE 'import/%' AND kind = 'concept' AND coalesce(protected, 0) = 0 AND coalesce(noise, 0) = 0",
    "tag_filter": ENT
    + " SELECT entity_id FROM mem WHERE json_valid(tags) AND json_type(tags) = 'ARRAY' AND list_has_any(CAST(CAST(tags AS JSON) AS VARCHAR[]), ['curtain', 'jungle', 'inlet'])",
    "mtype_filter": ENT
    + " SELECT entity_id, mtype FROM mem WHERE NOT coalesce(mtype LIKE 'session/%', false) AND NOT coalesce(mtype LIKE 'feed_ack', false)",
    "recent_window": ENT
    + f", m AS (SELECT entity_id, {_SEC.format(c='created_at')} AS t FROM mem), n AS (SELECT *, t >= {NOW} - 30 * 86400 AS i FROM m ORDER BY i DESC NULLS LAST, t DESC NULLS LAST, entity_id LIMIT 100) SELECT entity_id FROM n WHERE i OR NOT EXISTS (SELECT 1 FROM n WHERE i)",
    "stale_files": ENT
    + ", t AS (SELECT '/' || path AS path, max(updated_at) AS s FROM ent WHERE kind = 'doc' AND path <> '' GROUP BY 1), d AS (SELECT '/' || path AS path, max(epoch_us(collected_at) / 1e6) AS m FROM documents WHERE path <> '' GROUP BY 1) SELECT path, CASE WHEN m IS NULL THEN 'missing' ELSE 'changed' END AS state FROM t LEFT JOIN d USING (path) WHERE m IS NULL OR m > s + 0.001",
}
