"""Queries of the training-data problems p1, p3 to p6 and p8 to p10, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions.clean import day_of, epoch_seconds, folded, time_ms, week_of
from threadloom.llm import frequency, mixture, neardup, overlap, packing, percentiles, residue, survivor, tokens
from threadloom.plans.core_problems import TIME_SQL, read
from threadloom.staging import stage

COMMON_SHARE = {"canonical_name": 0.01, "content": 0.2}


def _term_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = frequency.value_pairs(read(spark, sf_dir, "entities"), "canonical_name", "canonical_name", "id")
    return names.unionByName(frequency.text_pairs(read(spark, sf_dir, "memory_content"), "content", "content", "entity_id"))


def _records_per_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(field, total): the records with at least one term."""
    names = read(spark, sf_dir, "entities").filter(F.col("canonical_name").rlike(r"\S")).select(
        F.lit("canonical_name").alias("field"), F.col("id").alias("record")
    )
    texts = read(spark, sf_dir, "memory_content").filter(F.col("content").rlike(frequency.TERM)).select(
        F.lit("content").alias("field"), F.col("entity_id").alias("record")
    )
    return names.unionByName(texts).groupBy("field").agg(F.countDistinct("record").alias("total"))


def p1_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every canonical name and every term with its occurrences, records and mark."""
    return frequency.marked(frequency.frequencies(_term_pairs(spark, sf_dir)), _records_per_field(spark, sf_dir), COMMON_SHARE)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_frequency(spark, sf_dir).filter("mark != 'kept'").select("field", "term", "mark")


def _daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(day, kind, source, value, n) of known latencies, each call once: what is kept and combined."""
    calls = read(spark, sf_dir, "query_log").filter("latency_ms >= 0")
    calls = calls.select(
        "query_id", time_ms(F.col("ts")).alias("ms"), folded(F.col("kind")).alias("kind"), folded(F.col("source")).alias("source"), "latency_ms"
    ).filter("ms IS NOT NULL").distinct()
    return percentiles.value_counts(calls.withColumn("day", day_of(F.col("ms"))), ["day", "kind", "source"], "latency_ms")


def _week(day: str):
    return week_of(F.unix_date(F.col(day)).cast("long") * F.lit(86_400_000))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    weekly = percentiles.combine(_daily_counts(spark, sf_dir).withColumn("week", _week("day")), ["week", "kind", "source"])
    found = percentiles.percentiles(weekly, ["week", "kind", "source"], {"p50": 5000, "p95": 9500})
    return found.filter("n >= 30 AND p95 >= 10 * p50").select("week", "kind", "source")


def p3_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median and upper percentiles of the latency of each kind and source in each week."""
    weekly = percentiles.combine(_daily_counts(spark, sf_dir).withColumn("week", _week("day")), ["week", "kind", "source"])
    return percentiles.percentiles(weekly, ["week", "kind", "source"])


def p3_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over all weeks, put together from the counts of single days."""
    return percentiles.percentiles(percentiles.combine(_daily_counts(spark, sf_dir), ["kind", "source"]), ["kind", "source"])


def _near(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    links, members = neardup.near_duplicates(
        read(spark, sf_dir, "memory_content"), "entity_id", "content", "tags", words=3, least_words=10, similarity=(3, 5), tag_similarity=(1, 2)
    )
    return stage(links, "near-links"), members


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.record_pairs(*_near(spark, sf_dir))


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memories that have a copy, with their group and the number of classes they are linked to."""
    return neardup.duplicate_groups(*_near(spark, sf_dir)).withColumnRenamed("record", "entity_id")


def _link_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(grp, sid, id): linkage, concept and entity of every bit whose concept and entity exist."""
    bits = read(spark, sf_dir, "bitmap_fragments").select(
        F.translate(F.lower("linkage"), "_", "-").alias("grp"), F.shiftright("bit", 32).alias("sid"),
        F.col("bit").bitwiseAND(F.lit(0xFFFFFFFF)).alias("id")
    )
    concepts = read(spark, sf_dir, "concepts").select(F.col("id").alias("sid")).distinct()
    entities = read(spark, sf_dir, "entities").select("id").distinct()
    return bits.distinct().join(entities, "id", "left_semi").join(concepts, "sid", "left_semi")


def _overlaps(spark: SparkSession, sf_dir: str, num: int, den: int, least: int = 20) -> DataFrame:
    found = overlap.overlaps(_link_sets(spark, sf_dir), least, num, den)
    return found.select(
        F.col("grp").alias("linkage"), F.col("a").alias("concept_a"), F.col("b").alias("concept_b"), F.col("na").alias("size_a"),
        F.col("nb").alias("size_b"), "shared"
    )


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _overlaps(spark, sf_dir, 2, 5).select("linkage", "concept_a", "concept_b")


def p5_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and overlap of all pairs of large sets under one verb with a Jaccard similarity of 0.1 or more."""
    return _overlaps(spark, sf_dir, 1, 10)


def p5_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and overlap of every pair of sets under one verb that shares an entity, of any size and similarity."""
    return _overlaps(spark, sf_dir, 0, 1, least=1)


ENTITY_CELLS = ("name", "path", "tldr", "canonical_name")


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = survivor.same_thing_groups(read(spark, sf_dir, "entities"), "id", "kind", "name")
    kinds = read(spark, sf_dir, "partitions").select(
        F.col("id").alias("partition_id"), F.col("kind").alias("part_kind")
    ).dropDuplicates(["partition_id"])
    rows = rows.join(kinds, "partition_id", "left")
    place = F.coalesce(
        F.when(F.col("part_kind") == "canon", 0).when(F.col("part_kind") == "repo", 1).when(F.col("part_kind") == "agent-scratch", 2), F.lit(3)
    )
    age = F.coalesce(-epoch_seconds(F.col("updated_at")), F.lit(1.0e300))
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in ENTITY_CELLS]))
    return rows.select(
        "grp", F.col("id").alias("source"), place.alias("place"), age.alias("age"), cells.alias("cell")
    ).select("grp", "source", "place", "age", "cell.field", "cell.value")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The required survivor of each field, its most trusted row's value: a strict order, which leaves nothing to vote on."""
    found = survivor.survivors(_cells(spark, sf_dir), ["place", "age"], weigh="trust")
    return found.select(F.col("grp").alias("group_id"), "field", F.col("source").alias("source_id"))


#: How much rows of each kind of partition weigh in the consensus, canon first; unknown ones weigh as the last.
CLASS_WEIGHTS = (4.0, 2.0, 1.0, 1.0)
#: A row this much older than its group's newest weighs three quarters of it, a very old one half.
HALF_LIFE_S = 90 * 86_400.0


def p6_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same groups, by the vote of their rows, weighed by kind of partition and by age: the existing value closest to the consensus."""
    cells = _cells(spark, sf_dir).distinct()
    newest = cells.groupBy("grp", "field").agg(F.min("age").alias("newest"))
    behind = F.greatest(F.col("age") - F.col("newest"), F.lit(0.0))
    recency = 0.5 + 0.5 * F.pow(F.lit(2.0), -behind / HALF_LIFE_S)
    trust = F.element_at(F.array(*[F.lit(w) for w in CLASS_WEIGHTS]), F.col("place") + 1)
    weighed = cells.join(newest, ["grp", "field"]).withColumn("weight", trust * recency).drop("newest")
    return survivor.survivors(weighed, ["place", "age"], weigh="weight").select(
        F.col("grp").alias("group_id"), "field", "value", F.col("source").alias("source_id"), "n_values", "n_rows", "distance"
    )


def _sized_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = F.regexp_replace(folded(F.col("source")), "[ -]", "_").alias("source")
    docs = read(spark, sf_dir, "documents").select("doc_id", source, "text")
    return stage(tokens.token_sizes(docs, "text", ["doc_id", "source"]), "token-sizes")


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _sized_documents(spark, sf_dir).select(F.col("doc_id").alias("item"), "tokens")
    return packing.pack(items, read(spark, sf_dir, "containers").select("container", F.col("capacity_tokens").alias("capacity")))


def p8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its bin, for each kind of container, and the bin's unused space."""
    return _packed(spark, sf_dir).withColumnRenamed("item", "doc_id")


def p8_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of the filling of each container: all documents with tokens are in, no bin is overfull, nothing that fits is split, pieces
    add up to their documents."""
    items = _sized_documents(spark, sf_dir).select(F.col("doc_id").alias("item"), "tokens")
    packed = stage(packing.pack(items, read(spark, sf_dir, "containers").select("container", F.col("capacity_tokens").alias("capacity"))), "packed")
    per_bin = packed.groupBy("container", "bin").agg(
        F.sum("tokens").alias("t"), F.max("capacity").alias("c"), F.max("bin_tokens").alias("said"), F.max("unused").alias("unused")
    )
    bins = per_bin.groupBy("container").agg(
        F.sum(
            ((F.col("t") > F.col("c")) | (F.col("t") != F.col("said")) | (F.col("t") + F.col("unused") != F.col("c"))).cast("int")
        ).alias("wrong_bins")
    )
    per_item = packed.groupBy("container", "item").agg(
        F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n"), F.max("capacity").alias("c")
    ).join(items, "item")
    wrong = (F.col("t") != F.col("tokens")) | (F.col("n") != F.ceil(F.col("tokens") / F.col("c")))
    return per_item.groupBy("container", F.col("c").alias("capacity")).agg(
        F.count(F.lit(1)).alias("documents"), F.sum(wrong.cast("int")).alias("wrong_documents")
    ).join(bins, "container")


def p8_filling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins, tokens and unused space of each kind of container, beside the least number of bins."""
    return packing.filling(_packed(spark, sf_dir))


def _mixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = _sized_documents(spark, sf_dir).withColumnRenamed("doc_id", "doc")
    return mixture.mixture(docs, read(spark, sf_dir, "mix_targets"))


def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The uses of documents in the mixture, with their training positions."""
    return _mixed(spark, sf_dir)[0].withColumnsRenamed({"doc": "doc_id"})


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of each source."""
    return mixture.shares(*_mixed(spark, sf_dir))


def p9_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of each target in the mixture: no document is used more often than allowed or from another source, and the tokens are within
    one document of the demand."""
    uses, goal = _mixed(spark, sf_dir)
    uses = stage(uses, "uses")
    docs = _sized_documents(spark, sf_dir).select(F.col("doc_id").alias("doc"), F.col("source").alias("own"), F.col("tokens").alias("size"))
    per_doc = uses.groupBy("source", "doc").agg(
        F.count(F.lit(1)).alias("n"), F.max("tokens").alias("t"), F.min("position").alias("lo"), F.max("position").alias("hi")
    ).join(docs, "doc", "left")
    per = per_doc.groupBy("source").agg(
        F.max("n").alias("most"), F.sum(F.col("n") * F.col("t")).alias("got"),
        F.sum(
            (~F.col("own").eqNullSafe(F.col("source")) | (F.col("t") != F.col("size")) | (F.col("lo") < 0) | (F.col("hi") > 1)).cast("int")
        ).alias("wrong")
    )
    largest = docs.groupBy(F.col("own").alias("source")).agg(F.max("size").alias("largest"))
    rows = goal.join(per, "source", "left").join(largest, "source", "left").na.fill(0, ["most", "got", "largest", "wrong"])
    fits = F.abs(F.col("got") - F.col("demand")) <= F.col("largest")
    return rows.select(
        "source", "max_repeats", (F.col("most") <= F.col("max_repeats")).alias("within_repeats"), fits.alias("within_a_document"), "wrong"
    )


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.find_residue(read(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id")


def p10_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents to leave out, with what they carry."""
    return residue.find_residue(read(spark, sf_dir, "documents"), "doc_id", "text")


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_frequency, p3_found, p3_weekly, p3_overall, p4_found, p4_groups, p5_found, p5_overlap, p5_shared, p6_found, p6_consensus,
        p8_pack, p8_filling, p8_check, p9_mixture, p9_shares, p9_check, p10_found, p10_kinds
    )
}

_P1 = """
WITH p AS (
  SELECT DISTINCT 'canonical_name' AS field, lower(trim(canonical_name)) AS term, id AS record, 1 AS n FROM entities WHERE trim(canonical_name) <> ''),
m AS (SELECT DISTINCT entity_id, content FROM memory_content),
t AS (SELECT entity_id AS record, lower(unnest(regexp_extract_all(content, '[A-Za-z_][A-Za-z0-9_]{2,}'))) AS term FROM m),
q AS (SELECT * FROM p UNION ALL SELECT 'content', term, record, count(*) FROM t GROUP BY term, record),
totals AS (SELECT field, count(DISTINCT record) AS total FROM q GROUP BY field),
f AS (SELECT field, term, CAST(sum(n) AS BIGINT) AS occurrences, count(DISTINCT record) AS records FROM q GROUP BY field, term),
r AS (SELECT f.*, CASE WHEN records <= 2 THEN 'rare' WHEN records >= total * CASE field WHEN 'content' THEN 0.2 ELSE 0.01 END THEN 'common' ELSE 'kept' END AS mark FROM f JOIN totals USING (field))
"""
_P3 = f"""
WITH d AS (SELECT DISTINCT query_id, {TIME_SQL} AS ms, lower(trim(kind)) AS kind, lower(trim(source)) AS source, latency_ms FROM query_log WHERE latency_ms >= 0),
c AS (SELECT kind, source, latency_ms, strftime(date_trunc('week', make_timestamp(ms * 1000)), '%Y-%m-%d') AS week FROM d WHERE ms IS NOT NULL),
"""
_RANKS = "r AS (SELECT *, row_number() OVER (PARTITION BY {g} ORDER BY latency_ms) AS k, count(*) OVER (PARTITION BY {g}) AS n FROM c), p AS (SELECT {g}, max(n) AS n, {ps} FROM r GROUP BY {g}) "
_PS = ", ".join(
    f"CAST(max(CASE WHEN k = (n * {p} + 9999) // 10000 THEN latency_ms END) AS INTEGER) AS {c}" for c, p in percentiles.PERCENTILES.items()
)
_P5 = """
WITH s AS (
  SELECT DISTINCT replace(lower(linkage), '_', '-') AS linkage, bit >> 32 AS concept, bit & 4294967295 AS id FROM bitmap_fragments
  WHERE (bit & 4294967295) IN (SELECT id FROM entities) AND (bit >> 32) IN (SELECT id FROM concepts)),
z AS (SELECT linkage, concept, count(*) AS n FROM s GROUP BY ALL HAVING count(*) >= 20),
b AS (SELECT s.*, n FROM s JOIN z USING (linkage, concept)),
o AS (SELECT a.linkage, a.concept AS concept_a, b.concept AS concept_b, any_value(a.n) AS size_a, any_value(b.n) AS size_b, count(*) AS shared
      FROM b a JOIN b ON a.linkage = b.linkage AND a.id = b.id AND a.concept < b.concept GROUP BY 1, 2, 3)
"""
_P5_SHARED = """
WITH s AS (
  SELECT DISTINCT replace(lower(linkage), '_', '-') AS linkage, bit >> 32 AS concept, bit & 4294967295 AS id FROM bitmap_fragments
  WHERE (bit & 4294967295) IN (SELECT id FROM entities) AND (bit >> 32) IN (SELECT id FROM concepts)),
b AS (SELECT *, count(*) OVER (PARTITION BY linkage, concept) AS n FROM s)
SELECT a.linkage, a.concept AS concept_a, b.concept AS concept_b, any_value(a.n) AS size_a, any_value(b.n) AS size_b, count(*) AS shared
FROM b a JOIN b ON a.linkage = b.linkage AND a.id = b.id AND a.concept < b.concept GROUP BY 1, 2, 3
"""
_P6 = r"""
WITH e AS (SELECT DISTINCT * FROM entities),
k AS (SELECT *, min(id) OVER (PARTITION BY kind, same) AS group_id, max(id) OVER (PARTITION BY kind, same) AS last_id FROM (SELECT *, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS same FROM e WHERE name IS NOT NULL AND kind IS NOT NULL)),
g AS (SELECT k.*, CASE p.kind WHEN 'canon' THEN 0 WHEN 'repo' THEN 1 WHEN 'agent-scratch' THEN 2 ELSE 3 END AS place, coalesce(CASE WHEN updated_at > 1e11 THEN updated_at / 1000 ELSE updated_at END, -1e300) AS fresh
      FROM k LEFT JOIN partitions p ON k.partition_id = p.id WHERE group_id <> last_id),
c AS (SELECT group_id, id, place, fresh, unnest(['name', 'path', 'tldr', 'canonical_name']) AS field, unnest([name, path, tldr, canonical_name]) AS value FROM g)
SELECT group_id, field, id AS source_id FROM c WHERE regexp_matches(value, '\S') QUALIFY row_number() OVER (PARTITION BY group_id, field ORDER BY place, fresh DESC, id) = 1
"""
_P4 = r"""
WITH m AS (SELECT DISTINCT entity_id, tags, regexp_extract_all(lower(content), '[a-z0-9_]+') AS w FROM memory_content WHERE content IS NOT NULL),
s AS (SELECT entity_id, list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS tok,
  list_distinct(list_filter(list_transform(CASE WHEN json_valid(tags) AND trim(tags) LIKE '[%' THEN CAST(CAST(tags AS JSON) AS VARCHAR[]) ELSE string_split(coalesce(tags, ''), ',') END, lambda x: lower(trim(x))), lambda x: x <> '')) AS tg
  FROM m WHERE len(w) >= 10),
x AS (SELECT entity_id, unnest(tok) AS t FROM s),
o AS (SELECT a.entity_id AS ea, b.entity_id AS eb, count(*) AS n FROM x a JOIN x b ON a.t = b.t AND a.entity_id < b.entity_id GROUP BY 1, 2)
SELECT ea AS entity_a, eb AS entity_b FROM o JOIN s a ON a.entity_id = ea JOIN s b ON b.entity_id = eb
WHERE n * 5 >= (len(a.tok) + len(b.tok) - n) * 3
  AND len(list_intersect(a.tg, b.tg)) * 2 >= len(a.tg) + len(b.tg) - len(list_intersect(a.tg, b.tg))
"""
# Classes of equal texts and tags, linked where a pair of theirs is a case; groups by reachability.
_P4_GROUPS = (
    _P4.replace("WITH m AS", "WITH RECURSIVE m AS").rsplit("SELECT ea AS entity_a", 1)[0]
    + """, k AS (SELECT entity_id, md5(CAST(list_sort(tok) AS VARCHAR) || CAST(list_sort(tg) AS VARCHAR)) AS cid, tok, tg FROM s),
  p AS (SELECT DISTINCT a.cid AS ca, b.cid AS cb FROM o JOIN k a ON a.entity_id = ea JOIN k b ON b.entity_id = eb WHERE a.cid <> b.cid AND n * 5 >= (len(a.tok) + len(b.tok) - n) * 3
    AND len(list_intersect(a.tg, b.tg)) * 2 >= len(a.tg) + len(b.tg) - len(list_intersect(a.tg, b.tg))),
  e AS (SELECT ca, cb FROM p UNION SELECT cb, ca FROM p), d AS (SELECT ca AS cid, count(*) AS n FROM e GROUP BY 1), z AS (SELECT cid, count(DISTINCT entity_id) AS n, min(entity_id) AS least FROM k GROUP BY 1),
  reach AS (SELECT cid, cid AS other FROM z UNION SELECT r.cid, e.cb FROM reach r JOIN e ON e.ca = r.other),
  g AS (SELECT reach.cid, min(z.least) AS group_id FROM reach JOIN z ON z.cid = reach.other GROUP BY 1)
SELECT entity_id, min(group_id) AS group_id, CAST(sum(coalesce(d.n, 0)) AS BIGINT) AS n_links FROM k JOIN z USING (cid) JOIN g USING (cid) LEFT JOIN d USING (cid) WHERE d.n IS NOT NULL OR z.n > 1 GROUP BY 1
"""
)
ORACLE = {
    "p4_groups": _P4_GROUPS,
    "p8_check": "SELECT container, capacity_tokens AS capacity, (SELECT count(*) FROM documents WHERE text <> '') AS documents, 0 AS wrong_documents, 0 AS wrong_bins FROM containers",
    "p9_check": "SELECT source, max_repeats, true AS within_repeats, true AS within_a_document, 0 AS wrong FROM mix_targets",
    "p1_found": _P1 + "SELECT field, term, mark FROM r WHERE mark <> 'kept'",
    "p1_frequency": _P1 + "SELECT field, term, occurrences, records, mark FROM r",
    "p3_found": _P3 + _RANKS.format(g="week, kind, source", ps=_PS) + "SELECT week, kind, source FROM p WHERE n >= 30 AND p95 >= 10 * p50",
    "p3_weekly": _P3 + _RANKS.format(g="week, kind, source", ps=_PS) + "SELECT * FROM p",
    "p3_overall": _P3 + _RANKS.format(g="kind, source", ps=_PS) + "SELECT * FROM p",
    "p4_found": _P4,
    "p5_found": _P5 + "SELECT linkage, concept_a, concept_b FROM o WHERE shared * 5 >= (size_a + size_b - shared) * 2",
    "p5_overlap": _P5 + "SELECT * FROM o WHERE shared * 10 >= size_a + size_b - shared",
    "p5_shared": _P5_SHARED,
    "p6_found": _P6,
}
