"""Names and texts: identifiers, terms, word pairs, snippets, pronouns."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.functions import names, text
from threadloom.graph import read
from threadloom.model import BODY_STOPWORDS
from threadloom.plans.retrieval import SHAPE_SQL
from threadloom.plans.store_analytics import entities, memories
from threadloom.staging import spread


def canonicalize(spark, sf_dir):
    return entities(spark, sf_dir).filter("name IS NOT NULL").select("name").distinct().select(
        "name", names.canonicalize(F.col("name")).alias("canonical")
    )


def name_variants(spark, sf_dir):
    rows = entities(spark, sf_dir).filter("kind = 'concept' AND name IS NOT NULL").select("name").distinct()
    return rows.select("name", F.array_join(names.variants(F.col("name")), "|").alias("variants"))


def shape_scores(spark, sf_dir):
    rows = entities(spark, sf_dir).filter("name IS NOT NULL").select("name").distinct()
    return rows.select("name", names.shape_score(F.col("name")).alias("shape"))


def leaf_index(spark, sf_dir):
    rows = entities(spark, sf_dir).filter("kind = 'concept' AND name LIKE '%/%'").select(
        names.leaf(F.col("name")).alias("leaf"), names.namespace(F.col("name")).alias("namespace")
    )
    return rows.groupBy("leaf", "namespace").agg(F.count(F.lit(1)).alias("n"))


def query_terms(spark, sf_dir):
    """Search terms of the logged queries."""
    rows = read(spark, sf_dir, "query_log").filter("body IS NOT NULL").select("body").distinct()
    return rows.select("body", F.array_join(names.content_terms(F.col("body")), "|").alias("terms"))


def stems(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select(
        F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), F.lit(0))).alias("word")
    ).distinct()
    return rows.select("word", text.stem(F.col("word")).alias("stem"))


def pair_index(spark, sf_dir):
    pairs = text.word_pairs(spread(read(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", "text")), "doc_id", "text")
    return text.pair_index(pairs, "doc_id")


def slugs(spark, sf_dir):
    rows = entities(spark, sf_dir).filter("tldr IS NOT NULL").select("tldr").distinct()
    return rows.select("tldr", names.slug(F.col("tldr")).alias("slug"))


def member_hashes(spark, sf_dir):
    rows = entities(spark, sf_dir).filter("kind = 'doc' AND name IS NOT NULL").groupBy("partition_id").agg(
        names.member_hash(F.collect_set("name")).alias("hash")
    )
    return rows


def references(spark, sf_dir):
    rows = memories(spark, sf_dir).filter("content IS NOT NULL")
    return rows.select("entity_id", F.size(text.references(F.col("content"), 1_000_000)).alias("n"))


def tag_taxonomy(spark, sf_dir):
    own = F.from_json("tags", "array<string>")
    return memories(spark, sf_dir).select(
        "entity_id", F.array_join(text.unknown_tags(own, ["curtain", "jungle", "inlet"]), ",").alias("unknown")
    ).filter("unknown != ''")


def kwic(spark, sf_dir):
    return text.with_kwic(read(spark, sf_dir, "documents"), "doc_id", "text", "watermark tombstone")


def coref(spark, sf_dir):
    return text.with_pronouns(read(spark, sf_dir, "documents"), "doc_id", "text")


def coref_links(spark, sf_dir):
    """How often each antecedent is meant, by document."""
    return text.antecedent_counts(coref(spark, sf_dir), "doc_id")


def memory_index(spark, sf_dir):
    e = entities(spark, sf_dir).filter("kind = 'memory'").select(F.col("id").alias("entity_id"), "name", "tldr")
    rows = e.join(memories(spark, sf_dir).select("entity_id", "mtype"), "entity_id", "left")
    return rows.select("entity_id", text.index_line(F.col("name"), F.col("mtype"), F.col("tldr")).alias("line"))


QUERIES = {
    f.__name__: f
    for f in (
        canonicalize, name_variants, shape_scores, leaf_index, query_terms, stems, pair_index, slugs, member_hashes, references, tag_taxonomy, kwic,
        coref, coref_links, memory_index
    )
}

ENT = "WITH ent AS (SELECT DISTINCT * FROM entities), mem AS (SELECT DISTINCT * FROM memory_content)"
_STOPS = ", ".join(f"'{w}'" for w in names.SEARCH_STOPWORDS)
_STEM = "CASE " + " ".join(
    f"WHEN length(word) > {len(s) + 3} AND ends_with(word, '{s}')" + (" AND NOT regexp_matches(word, '[sui]s$')" if s == "s" else "")
    + f" THEN substr(word, 1, length(word) - {len(s)})" + (" || 'y'" if s in ("ies", "ied") else "")
    for s in text.SUFFIXES
) + " ELSE word END"


def _in(words) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in sorted(words)) + ")"


# Pronouns: texts in tiles; by document and class, the latest candidate before each pronoun and where the latest one of another name was.
_COREF = rf"""
WITH t AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z][A-Za-z0-9_''-]*|[^A-Za-z]+') AS tiles FROM documents),
u AS (SELECT doc_id, unnest(tiles) AS tile, generate_subscripts(tiles, 1) AS i FROM t),
v AS (SELECT doc_id, i, tile, sum(length(tile)) OVER (PARTITION BY doc_id ORDER BY i) - length(tile) AS pos,
  sum(CASE WHEN regexp_matches(tile, '^[A-Za-z]') THEN 0 ELSE len(regexp_extract_all(tile, '[.!?]\s+|
{{2,}}')) END) OVER (PARTITION BY doc_id ORDER BY i) AS sent, lag(tile) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM u),
w AS (SELECT *, lower(tile) AS low, before IS NULL OR regexp_matches(before, '([.!?]\s+|
{{2,}})$') AS opens FROM v WHERE regexp_matches(tile, '^[A-Za-z]')),
n AS (SELECT doc_id, low, count(DISTINCT sent) AS n_sent FROM w GROUP BY ALL),
k AS (SELECT *, low IN {_in(text.PERSON | text.THING)} AS pro, contains(tile, chr(39)) OR low IN {_in(text.NO_NAME | text.VERBLIKE | set(names.SEARCH_STOPWORDS))} AS never, regexp_matches(tile, '^[A-Z]') AS big FROM w JOIN n USING (doc_id, low)),
c AS (SELECT *, CASE WHEN pro THEN low IN {_in(text.PERSON)} ELSE big END AS person,
  NOT pro AND NOT never AND CASE WHEN big THEN length(tile) >= 2 AND NOT (opens AND low IN {_in(text.OPENERS)}) ELSE length(tile) >= 3 AND tile = low AND n_sent >= 2 END AS cand FROM k),
d AS (SELECT *, lag(low) OVER x AS low0, lag(sent) OVER x AS sent0 FROM c WHERE cand WINDOW x AS (PARTITION BY doc_id, person ORDER BY i)),
e AS (SELECT doc_id, person, i, tile, sent, pos, pro, tile AS name, sent AS seen, CASE WHEN low0 <> low THEN sent0 END AS rival FROM d UNION ALL SELECT doc_id, person, i, tile, sent, pos, pro, NULL, NULL, NULL FROM c WHERE pro),
f AS (SELECT *, last_value(name IGNORE NULLS) OVER x AS ante, last_value(seen IGNORE NULLS) OVER x AS last_at, last_value(rival IGNORE NULLS) OVER x AS other FROM e WINDOW x AS (PARTITION BY doc_id, person ORDER BY i ROWS UNBOUNDED PRECEDING)),
found AS (SELECT doc_id, CAST(pos AS BIGINT) AS pos, tile AS pronoun, ante AS antecedent, round(1.0 / (1 + sent - last_at) / CASE WHEN sent - other <= 3 THEN 2 ELSE 1 END, 3)::DOUBLE AS confidence FROM f WHERE pro AND sent - last_at <= 3)
"""
_KWIC = r"""
WITH d AS (SELECT doc_id, text, trim(regexp_replace(text, '\s+', ' ', 'g')) AS flat FROM documents WHERE regexp_matches(lower(text), 'watermark|tombstone')),
h AS (SELECT *, least(coalesce(nullif(instr(lower(flat), 'watermark'), 0), 1000000000), coalesce(nullif(instr(lower(flat), 'tombstone'), 0), 1000000000)) - 1 AS s, length(flat) AS n FROM d),
w AS (SELECT *, greatest(0, s - 45) AS a0, least(n, s + 9 + 45) AS b0 FROM h),
x AS (SELECT *, instr(substr(flat, a0 + 1, s + 9 - a0), ' ') AS left_space, instr(reverse(substr(flat, s + 10, b0 - s - 9)), ' ') AS right_space FROM w),
y AS (SELECT *, CASE WHEN a0 > 0 AND left_space > 0 THEN a0 + left_space ELSE a0 END AS a, CASE WHEN b0 < n AND right_space > 0 AND b0 - right_space > s + 9 THEN b0 - right_space ELSE b0 END AS b FROM x),
z AS (SELECT *, CASE WHEN a > 0 THEN '…' ELSE '' END || substr(flat, a + 1, s - a) || '«' || substr(flat, s + 1, 9) || '»' || substr(flat, s + 10, b - s - 9) || CASE WHEN b < n THEN '…' ELSE '' END AS snippet, regexp_split_to_array(text, '\r\n|\n|\r') AS lines FROM y),
l AS (SELECT *, list_position(list_transform(lines, lambda x: regexp_matches(lower(x), 'watermark|tombstone')), true) AS k FROM z),
m AS (SELECT *, rtrim(lines[k], ' ' || chr(9)) AS line, least(coalesce(nullif(instr(lower(lines[k]), 'watermark'), 0), 1000000000), coalesce(nullif(instr(lower(lines[k]), 'tombstone'), 0), 1000000000)) - 1 AS p FROM l),
c AS (SELECT *, CASE WHEN length(line) <= 240 THEN 0 ELSE greatest(0, p - 120) END AS a2, CASE WHEN length(line) <= 240 THEN length(line) ELSE least(length(line), p + 9 + 120) END AS b2 FROM m)
SELECT doc_id, snippet, trim(CASE WHEN a2 > 0 THEN '…' ELSE '' END || substr(line, a2 + 1, p - a2) || '«' || substr(line, p + 1, 9) || '»' || substr(line, p + 10, b2 - p - 9) || CASE WHEN b2 < length(line) THEN '…' ELSE '' END, ' ' || chr(9)) AS line, k - 1 AS line_no FROM c
"""
# Without look-ahead: a capital that begins a word is set apart first.
_PARTS = "list_transform(regexp_extract_all(regexp_replace({x}, '([A-Z]+)([A-Z][a-z])', '\\1_\\2', 'g'), '[A-Z]?[a-z]+|[A-Z]+|[0-9]+'), lambda p: lower(p))"
_PAIRS = (
    rf"WITH cl AS (SELECT doc_id, unnest(regexp_split_to_array(text, '[.!?;:,()\[\]{{}}\n\"]+')) AS c FROM documents WHERE text IS NOT NULL), "
    f"w AS (SELECT doc_id, list_transform(regexp_extract_all(c, '{text.PAIR_WORD}'), lambda x: CASE WHEN lower(x) IN {_in(BODY_STOPWORDS)} THEN '|' ELSE lower(x) END) AS ws FROM cl), "
    "r AS (SELECT doc_id, trim(unnest(string_split(array_to_string(ws, ' '), '|'))) AS run FROM w), k AS (SELECT row_number() OVER () AS rid, doc_id, string_split(run, ' ') AS ws FROM r WHERE contains(run, ' ')), "
    f"u AS (SELECT rid, doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM k), st AS (SELECT rid, doc_id, i, {_STEM} AS s FROM u), "
    f"p AS (SELECT DISTINCT a.doc_id, least(a.s, b.s) || '_' || greatest(a.s, b.s) AS pair FROM st a JOIN st b ON a.rid = b.rid AND b.i > a.i AND b.i < a.i + {text.PAIR_WINDOW} AND a.s <> b.s) "
    "SELECT pair, count(*) AS df FROM p GROUP BY 1 HAVING count(*) >= 2 AND count(*) <= greatest(2, floor(0.05 * (SELECT count(DISTINCT doc_id) FROM p)))"
)
ORACLE = {
    "pair_index": _PAIRS,
    "canonicalize": ENT
    + f" , p AS (SELECT DISTINCT name, {_PARTS.format(x='name')} AS p FROM ent WHERE name IS NOT NULL) SELECT name, CASE WHEN len(p) > 0 THEN array_to_string(p, '_') ELSE lower(trim(name)) END AS canonical FROM p",
    "name_variants": ENT
    + f" , p AS (SELECT DISTINCT name, trim(name) AS t, {_PARTS.format(x='name')} AS p FROM ent WHERE kind = 'concept' AND name IS NOT NULL), v AS (SELECT name, CASE WHEN len(p) >= 2 THEN [t, array_to_string(p, '_'), array_to_string(p, '-'), array_to_string(p, ' ')] WHEN len(p) = 1 THEN [t, p[1]] ELSE [t] END AS v FROM p) "
    "SELECT name, array_to_string(list_filter(v, lambda x, i: list_position(v, x) = i), '|') AS variants FROM v",
    "references": ENT
    + f" SELECT entity_id, CAST(len(list_distinct(regexp_extract_all(content, '{text.REFERENCE}'))) AS INTEGER) AS n FROM mem WHERE content IS NOT NULL",
    "coref": _COREF + "SELECT * FROM found",
    "coref_links": _COREF + "SELECT doc_id, lower(antecedent) AS concept, CAST(count(*) AS DOUBLE) AS weight FROM found GROUP BY 1, 2",
    "kwic": _KWIC,
    "shape_scores": ENT
    + f" SELECT name, {SHAPE_SQL} AS shape FROM (SELECT DISTINCT name, string_split(string_split(name, '/')[-1], '::')[-1] AS leaf FROM ent WHERE name IS NOT NULL)",
    "leaf_index": ENT
    + " SELECT string_split(name, '/')[-1] AS leaf, string_split(name, '/')[1] AS namespace, count(*) AS n FROM ent WHERE kind = 'concept' AND name LIKE '%/%' GROUP BY 1, 2",
    "query_terms": "WITH q AS (SELECT DISTINCT body, list_filter(regexp_split_to_array(trim(body), '\\s+'), lambda t: length(t) >= 2) AS t FROM query_log WHERE body IS NOT NULL), f AS (SELECT body, list_filter(t, lambda x, i: list_position(list_transform(t, lambda y: lower(y)), lower(x)) = i) AS f FROM q), k AS (SELECT *, list_filter(f, lambda x: lower(x) NOT IN ("
    + _STOPS + ")) AS k FROM f) SELECT body, array_to_string(CASE WHEN len(f) > 1 AND len(k) > 0 THEN k ELSE f END, '|') AS terms FROM k",
    "stems": f"SELECT word, {_STEM} AS stem FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{{3,}}')) AS word FROM documents)",
    "slugs": ENT
    + " , s AS (SELECT DISTINCT tldr, regexp_replace(substr(regexp_replace(regexp_replace(lower(tldr), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 48), '_+$', '') AS s FROM ent WHERE tldr IS NOT NULL) SELECT tldr, CASE WHEN s = '' THEN 'subject' ELSE s END AS slug FROM s",
    "member_hashes": ENT
    + " SELECT partition_id, substr(sha256(string_agg(DISTINCT name, chr(10) ORDER BY name)), 1, 8) AS hash FROM ent WHERE kind = 'doc' AND name IS NOT NULL GROUP BY 1",
    "tag_taxonomy": ENT
    + " , u AS (SELECT entity_id, array_to_string(list_sort(list_distinct(list_filter(CAST(CAST(tags AS JSON) AS VARCHAR[]), lambda x: x NOT IN ('curtain', 'jungle', 'inlet')))), ',') AS unknown FROM mem WHERE json_valid(tags) AND json_type(tags) = 'ARRAY') SELECT * FROM u WHERE unknown <> ''",
    "memory_index": ENT
    + " SELECT e.id AS entity_id, substr('- ' || name || coalesce(' (' || mtype || ')', '') || coalesce(': ' || tldr, ''), 1, 160) AS line FROM ent e LEFT JOIN mem m ON m.entity_id = e.id WHERE kind = 'memory'",
}
