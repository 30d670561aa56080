"""Ranked retrieval over the documents: BM25 with coverage, its figures, fusion and boosts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions.frames import local_table
from threadloom.functions.names import shape_score
from threadloom.graph import document_figures, document_index, read
from threadloom.model import BODY_STOPWORDS, SEARCH_STOPWORDS
from threadloom.operators import rank

TERMS = ["inlet_marble", "watermark", "replica", "nogarnectar"]
_STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in BODY_STOPWORDS)
_TOKENS = "unnest(regexp_extract_all({}, '[A-Za-z_][A-Za-z0-9_]{{2,}}'))"
_LEAD = "array_to_string(list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ') <> '')[1:3], chr(10))"
DOCS = f"""
WITH tok AS (SELECT doc_id, lower({_TOKENS.format('text')}) AS t FROM documents),
lead_tok AS (SELECT doc_id, lower({_TOKENS.format(_LEAD)}) AS t FROM documents),
lnk AS (
  SELECT 'mentions' AS linkage, t AS concept_id, doc_id AS entity_id, CAST(count(*) AS DOUBLE) AS weight FROM tok WHERE t NOT IN ({_STOP}) GROUP BY ALL
  UNION ALL SELECT DISTINCT 'lead', t, doc_id, 1.0 FROM lead_tok WHERE t NOT IN ({_STOP})
  UNION ALL SELECT 'tagged', 'lang/' || lang, doc_id, 1.0 FROM documents WHERE lang IS NOT NULL
  UNION ALL SELECT 'tagged', 'source/' || source, doc_id, 1.0 FROM documents WHERE source IS NOT NULL),
men AS (SELECT * FROM lnk WHERE linkage = 'mentions')
"""


#: Of (name, leaf).
SHAPE_SQL = (
    "(CASE WHEN regexp_matches(leaf, '\\p{Lu}') AND regexp_matches(leaf, '\\p{Ll}') THEN 1 ELSE 0 END + CASE WHEN leaf = upper(leaf) AND leaf <> lower(leaf) AND length(leaf) >= 2 THEN 1 ELSE 0 END "
    "+ CASE WHEN contains(leaf, '_') OR contains(leaf, '.') OR contains(leaf, '-') OR contains(name, '::') THEN 1 ELSE 0 END + CASE WHEN regexp_matches(leaf, '\\d') THEN 0.5 ELSE 0 END "
    "+ CASE WHEN length(leaf) >= 12 THEN 0.5 ELSE 0 END)::DOUBLE"
)


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_index(spark, sf_dir)


def term_table(spark: SparkSession, terms: list[str] = TERMS) -> DataFrame:
    return local_table(spark, list(enumerate(terms)), "term int, concept_id string")


def ranked(spark: SparkSession, sf_dir: str, terms: list[str] = TERMS, **options) -> DataFrame:
    own = {t: i for i, t in reversed(list(enumerate(terms)))}
    return rank.content_rank(links(spark, sf_dir), own, len(terms), corpus=document_figures(spark, sf_dir), **options)


def _rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


def content_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ranked(spark, sf_dir, boosts={}), "score")


def content_rank_lead(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ranked(spark, sf_dir), "score")


def content_rank_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ranked(spark, sf_dir, boosts={}, tf="log", limit=None), "score")


def bm25_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(rank.corpus_stats(links(spark, sf_dir)), "avgdl")


def doc_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.document_length(links(spark, sf_dir))


def concept_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.concept_df(links(spark, sf_dir))


def tf_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(rank.tf_tail(links(spark, sf_dir)), "tail")


def _lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    ls, out = links(spark, sf_dir), None
    for t in TERMS:
        one = rank.top_weighted(ls.filter(F.col("concept_id") == t), "mentions", term_table(spark, [t]), 20).withColumnRenamed("weight", "score")
        one = rank.as_ranks(one, t)
        out = one if out is None else out.unionByName(one)
    return out


def rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rankings of the single terms, fused."""
    return _rounded(rank.fuse(_lists(spark, sf_dir)), "score")


def top_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.top_weighted(links(spark, sf_dir).filter(F.col("concept_id") == TERMS[0]), "mentions", term_table(spark, TERMS[:1]), 20)


def per_linkage_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.per_linkage_top(links(spark, sf_dir).filter(F.col("concept_id").isin(TERMS)), term_table(spark), 10)


def fused_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(
        rank.fused_rows(links(spark, sf_dir).filter(F.col("concept_id").isin(TERMS)), term_table(spark), ["lead", "mentions"], 10), "score"
    )


def feedback_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.feedback_terms(links(spark, sf_dir), ranked(spark, sf_dir, boosts={}, limit=5), TERMS, SEARCH_STOPWORDS)


def phrase_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    bodies = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("entity_id"), "text")
    return _rounded(rank.phrase_boost(ranked(spark, sf_dir, boosts={}), bodies, ["replica", "inlet_marble"]), "score")


def definition_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose title line names the term come first."""
    defining = links(spark, sf_dir).filter("linkage = 'lead' AND concept_id = 'nogarnectar'")
    return _rounded(rank.definition_floor(ranked(spark, sf_dir, boosts={}), defining), "score")


def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The terms as queries; relevant are documents that hold the term in their lead."""
    ls = links(spark, sf_dir).filter(F.col("concept_id").isin(TERMS))
    run = ls.filter("linkage = 'mentions'").select(
        F.col("concept_id").alias("qid"), F.col("entity_id").alias("doc_id"), F.col("weight").alias("score")
    )
    qrels = ls.filter("linkage = 'lead'").select(F.col("concept_id").alias("qid"), F.col("entity_id").alias("doc_id"), F.lit(1).alias("rel"))
    return _rounded(rank.retrieval_metrics(run, qrels, 10), "mrr", "recall", "ndcg")


def salience(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Salience of every term of the documents, by degree (no walk scores)."""
    ls = links(spark, sf_dir)
    sig = ls.groupBy(F.col("concept_id").alias("name")).agg(
        F.count(F.lit(1)).alias("degree"), F.sum(F.when(F.col("linkage") == "mentions", 1).otherwise(0)).alias("df"),
        F.coalesce(F.max(F.when(F.col("linkage") == "mentions", F.col("weight"))), F.lit(0.0)).alias("max_tf")
    )
    n = F.lit(float(read(spark, sf_dir, "documents").count()))
    value = rank.salience(F.col("name"), shape_score(F.col("name")), F.col("df"), F.col("max_tf"), F.lit(0.0), F.col("degree"), n, F.lit(0.0))
    return sig.select("name", F.round(value, 6).alias("salience"))


def substring_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memories whose name or body holds a text, newest first."""
    e = read(spark, sf_dir, "entities").distinct().filter("kind = 'memory'").select(
        F.col("id").alias("entity_id"), "name", F.col("created_at").alias("made")
    )
    m = read(spark, sf_dir, "memory_content").distinct().select("entity_id", "content")
    rows = e.join(m, "entity_id", "left").filter(F.lower(F.concat_ws("\n", "name", "content")).contains("watermark"))
    return rows.orderBy(F.desc_nulls_last("made"), "entity_id").select("entity_id", "name", "made").limit(200)


QUERIES = {
    f.__name__: f
    for f in (
        content_rank, content_rank_lead, content_rank_log, bm25_stats, doc_length, concept_df, tf_tail, rrf, top_weighted, per_linkage_top,
        fused_rows, feedback_terms, phrase_boost, definition_floor,
        retrieval_metrics, salience, substring_search,
    )
}


def _bm25(tf: str = "weight", lead: float = 0.0, limit: int | None = 50) -> str:
    terms = ", ".join(f"'{t}'" for t in TERMS)
    boost = f" + {lead} * coalesce((SELECT sum(idf) FROM lnk JOIN d USING (concept_id) WHERE linkage = 'lead' AND lnk.entity_id = s.entity_id), 0)" if lead else ""
    return (
        f", st AS (SELECT count(DISTINCT entity_id) AS n, sum(weight) / count(DISTINCT entity_id) AS avgdl FROM men), dl AS (SELECT entity_id, sum(weight) AS dl FROM men GROUP BY 1), "
        f"d AS (SELECT concept_id, ln((any_value(n) - count(*) + 0.5) / (count(*) + 0.5) + 1) AS idf FROM men, st WHERE concept_id IN ({terms}) GROUP BY 1), "
        f"s AS (SELECT entity_id, sum(idf * {tf} * 2.5 / ({tf} + 1.5 * (0.25 + 0.75 * dl / avgdl))) * power(count(*) / {len(TERMS)}.0, 3) AS score FROM men JOIN d USING (concept_id) JOIN dl USING (entity_id), st GROUP BY 1), "
        f"q AS (SELECT entity_id, score{boost} AS score FROM s ORDER BY 2 DESC, 1 {f'LIMIT {limit}' if limit else ''}) "
    )


_TERM_RANKS = ", ".join(
    f"l{i} AS (SELECT entity_id, row_number() OVER (ORDER BY weight DESC, entity_id) - 1 AS rank FROM men WHERE concept_id = '{t}' ORDER BY weight DESC, entity_id LIMIT 20)"
    for i,
    t in enumerate(TERMS)
)
_IN = ", ".join(f"'{t}'" for t in TERMS)
ORACLE = {
    "content_rank": DOCS + _bm25() + "SELECT entity_id, round(score, 6) AS score FROM q",
    "content_rank_lead": DOCS + _bm25(lead=0.25) + "SELECT entity_id, round(score, 6) AS score FROM q",
    "content_rank_log": DOCS + _bm25(tf="(1 + ln(weight))", limit=None) + "SELECT entity_id, round(score, 6) AS score FROM q",
    "bm25_stats": DOCS + "SELECT count(DISTINCT entity_id) AS n_docs, round(sum(weight) / count(DISTINCT entity_id), 6) AS avgdl FROM men",
    "doc_length": DOCS + "SELECT entity_id, sum(weight) AS length FROM men GROUP BY 1",
    "concept_df": DOCS + "SELECT concept_id, count(*) AS df FROM men GROUP BY 1",
    "tf_tail": DOCS
    + "SELECT tf, round(sum(n) OVER (ORDER BY tf DESC) / sum(n) OVER (), 6) AS tail FROM (SELECT weight AS tf, count(*) AS n FROM men GROUP BY 1)",
    "rrf": DOCS + ", " + _TERM_RANKS + " SELECT entity_id, round(sum(1.0 / (60 + rank)), 6) AS score FROM ("
    + " UNION ALL ".join(f"SELECT * FROM l{i}" for i in range(len(TERMS))) + ") GROUP BY 1",
    "top_weighted": DOCS + f"SELECT entity_id, weight FROM men WHERE concept_id = '{TERMS[0]}' ORDER BY 2 DESC, 1 LIMIT 20",
    "per_linkage_top": DOCS
    + f"SELECT * FROM (SELECT linkage, entity_id, max(weight) AS weight, row_number() OVER (PARTITION BY linkage ORDER BY max(weight) DESC NULLS LAST, entity_id) - 1 AS rank FROM lnk WHERE concept_id IN ({_IN}) GROUP BY 1, 2) WHERE rank < 10",
    "fused_rows": DOCS
    + f", r AS (SELECT linkage, entity_id, row_number() OVER (PARTITION BY linkage ORDER BY max(weight) DESC NULLS LAST, entity_id) - 1 AS rank FROM lnk WHERE concept_id IN ({_IN}) AND linkage IN ('lead', 'mentions') GROUP BY 1, 2) SELECT entity_id, round(sum(1.0 / (60 + rank)), 6) AS score, min(linkage) AS linkage FROM r WHERE rank < 10 GROUP BY 1",
    "feedback_terms": DOCS
    + _bm25(limit=5)
    + f"SELECT concept_id, count(DISTINCT entity_id) AS df FROM men WHERE entity_id IN (SELECT entity_id FROM q) AND concept_id NOT IN ({_IN}) AND concept_id NOT IN ({', '.join(repr(w) for w in SEARCH_STOPWORDS)}) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5",
    "phrase_boost": DOCS + _bm25()
    + "SELECT entity_id, round(CASE WHEN regexp_matches(text, '(?is)replica.{0,24}inlet_marble') THEN score * 1.5 ELSE score END, 6) AS score FROM q JOIN documents ON doc_id = entity_id",
    "definition_floor": DOCS
    + _bm25()
    + "SELECT entity_id, round(CASE WHEN entity_id IN (SELECT entity_id FROM lnk WHERE linkage = 'lead' AND concept_id = 'nogarnectar') THEN (SELECT max(score) FROM q) + 2 ELSE score END, 6) AS score FROM q",
    "retrieval_metrics": DOCS
    + f", r AS (SELECT concept_id AS qid, entity_id AS doc, row_number() OVER (PARTITION BY concept_id ORDER BY weight DESC, entity_id) AS rank FROM men WHERE concept_id IN ({_IN})), g AS (SELECT concept_id AS qid, entity_id AS doc, row_number() OVER (PARTITION BY concept_id ORDER BY entity_id) AS best FROM lnk WHERE linkage = 'lead' AND concept_id IN ({_IN})), i AS (SELECT qid, count(*) AS n, sum(CASE WHEN best <= 10 THEN 1 / log2(best + 1) ELSE 0 END) AS idcg FROM g GROUP BY 1), h AS (SELECT qid, min(rank) AS first, count(*) AS found, sum(1 / log2(rank + 1)) AS dcg FROM r JOIN g USING (qid, doc) WHERE rank <= 10 GROUP BY 1) SELECT qid, round(coalesce(1.0 / first, 0), 6) AS mrr, round(coalesce(found / n, 0), 6) AS recall, round(coalesce(dcg / idcg, 0), 6) AS ndcg FROM i LEFT JOIN h USING (qid)",
    "salience": DOCS
    + """, g AS (SELECT concept_id AS name, count(*) AS degree, count(*) FILTER (WHERE linkage = 'mentions') AS df, coalesce(max(weight) FILTER (WHERE linkage = 'mentions'), 0) AS max_tf FROM lnk GROUP BY 1),
l AS (SELECT *, string_split(string_split(name, '/')[-1], '::')[-1] AS leaf FROM g),
p AS (SELECT *, """ + SHAPE_SQL + """ AS shape, name LIKE '%/%' AS spaced, 2 + 0.1 * least(degree, 10) AS central FROM l)
SELECT name, round(0.3 * central * CASE WHEN shape = 0 AND NOT spaced THEN CASE WHEN max_tf <= 0 THEN 0 ELSE least(1.0, log2(max_tf + 1) / log2(9)) END ELSE 1 END
  + CASE WHEN df > 0 THEN 0.25 * log2(greatest(1.0, (SELECT count(*) FROM documents) / df)) ELSE 0 END + shape + CASE WHEN spaced THEN 0.5 ELSE 0 END, 6) AS salience FROM p""",
    "substring_search": "SELECT e.id AS entity_id, name, e.created_at AS made FROM (SELECT DISTINCT * FROM entities WHERE kind = 'memory') e LEFT JOIN (SELECT DISTINCT * FROM memory_content) m ON e.id = m.entity_id WHERE lower(concat_ws(chr(10), name, content)) LIKE '%watermark%' ORDER BY 3 DESC NULLS LAST, 1 LIMIT 200",
}
