"""Ranked retrieval: BM25 with coverage over the mention links, fusion, boosts and salience.

``content_rank`` aggregates the links twice from one scan: all mentions to document lengths, and the few postings of the query's
terms to frequencies and flags per entity. The corpus figures (number of documents, mean length, document frequencies) are
tables of one row. All rankings end with score descending, id ascending.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

K1, B, COVERAGE_ALPHA, LEAD_WEIGHT, DEFINITION_FLOOR = 1.5, 0.75, 3.0, 0.25, 1e-3
RRF_K = 60
#: The most concepts of a mapping that are written into the scan's filter; each is an expression that the driver holds several times over.
MOST_IN_FILTER = 64


def _sum(cols: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols)


def tf_transform(tf: Column, how: str) -> Column:
    if how == "log":
        return F.when(tf > 0, 1 + F.log(tf)).otherwise(0.0)
    return tf


def content_rank(
    links: DataFrame, term_concepts: DataFrame | Mapping, n_terms: int, kinds: DataFrame | None = None, limit: int | None = 50, k1: float = K1,
    b: float = B, coverage_alpha: float = COVERAGE_ALPHA,
    tf: str = "raw", null_tf: float = 0.0, boosts: dict[str, float] | None = None, floor: float = DEFINITION_FLOOR,
    corpus: tuple[int, float] | None = None, coref: float = 0.0,
) -> DataFrame:
    """(entity_id, score): BM25 times coverage for a bag of terms.

    ``term_concepts`` has (term int from 0, concept_id): the concepts that each term denotes; a concept that several terms claim belongs to the
    first. If the driver knows them, they may be a mapping of concept to term, which then is part of the scan's filter; a mapping of more than
    ``MOST_IN_FILTER`` concepts is joined like a table, with the same result. A null weight counts as
    frequency ``null_tf`` and still counts for document frequency and coverage. ``kinds`` (entity_id) restricts
    what is scored, not the corpus figures. ``boosts`` maps a linkage to the weight that an entity gains per idf of a term that it is linked to so
    (``lead``). Entities that define a term's concept without mentioning one get ``floor``. No term that resolves gives an empty result. Links of
    an index carry
    their entity's length as ``dl`` and come with its figures as ``corpus``, the number of documents and their mean length; then only the postings
    of the terms are read. With ``coref``, an entity
    whose pronouns mean a term's concept gains that weight per idf and pronoun, three pronouns at most, and is found even without a mention.
    """
    boosts = {"lead": LEAD_WEIGHT} if boosts is None else boosts
    known = isinstance(term_concepts, Mapping)
    if known and not term_concepts:
        return links.select("entity_id", F.lit(0.0).alias("score")).limit(0)
    if known and len(term_concepts) > MOST_IN_FILTER:
        kind = links.schema["concept_id"].dataType.simpleString()
        term_concepts = links.sparkSession.createDataFrame([(t, c) for c, t in term_concepts.items()], f"term int, concept_id {kind}")
        known = False
    first = None if known else term_concepts.groupBy("concept_id").agg(F.min("term").alias("term"))
    # The same filter on both branches, so that they share one scan and one shuffle of the links.
    links = links.filter(F.col("concept_id").isNotNull() & F.col("entity_id").isNotNull())
    mentions = links.filter("linkage = 'mentions'")
    length = figures = None
    if corpus is None:
        length = mentions.groupBy("entity_id").agg(F.sum(F.coalesce("weight", F.lit(0.0))).alias("dl"))
        figures = length.agg(F.count(F.lit(1)).alias("n_docs"), (F.sum("dl") / F.count(F.lit(1))).alias("avgdl"))
    raw = tf_transform(F.coalesce(F.col("weight"), F.lit(null_tf)), tf)
    aggs = []
    for i in range(n_terms):
        own = F.col("term") == i
        mention = own & (F.col("linkage") == "mentions")
        aggs.append(F.max(F.when(mention, 1).otherwise(0)).alias(f"has{i}"))
        aggs.append(F.collect_list(F.when(mention, raw)).alias(f"tf{i}"))
        for j, linkage in enumerate(boosts):
            aggs.append(F.sum(F.when((F.col("linkage") == linkage) & own, 1).otherwise(0)).alias(f"boost{i}_{j}"))
        if coref > 0:
            meant = F.least(F.coalesce("weight", F.lit(1.0)), F.lit(3.0))
            aggs.append(F.sum(F.when(own & (F.col("linkage") == "coref"), meant).otherwise(0.0)).alias(f"coref{i}"))
    aggs.append(F.max(F.when(F.col("linkage") == "defines", 1).otherwise(0)).alias("defines_it"))
    if length is None:
        aggs.append(F.max("dl").alias("dl"))
    postings = links.filter(F.col("linkage").isin(["mentions", "defines", *boosts, *(["coref"] if coref > 0 else [])]))
    if known:
        term = F.coalesce(*[F.when(F.col("concept_id") == c, F.lit(t)) for c, t in term_concepts.items()])
        postings = postings.filter(F.col("concept_id").isin(list(term_concepts))).withColumn("term", term)
    else:
        postings = postings.join(first, "concept_id")
    hits = postings.groupBy("entity_id").agg(*aggs)
    hit = reduce(lambda x, y: x | y, [F.col(f"has{i}") == 1 for i in range(n_terms)]) | (F.col("defines_it") == 1)
    if coref > 0:
        hit = reduce(lambda x, y: x | y, [F.col(f"coref{i}") > 0 for i in range(n_terms)], hit)
    hits = hits.filter(hit)
    counts = hits.agg(*[F.sum(f"has{i}").alias(f"n{i}") for i in range(n_terms)])
    if known:
        counts = counts.withColumn("units", F.lit(len(set(term_concepts.values()))))
    else:
        counts = counts.crossJoin(first.agg(F.countDistinct("term").alias("units")))  # tables of one row
    counts = counts.withColumn("one", F.lit(1))
    if figures is None:
        figures = counts.withColumns({"n_docs": F.lit(corpus[0]), "avgdl": F.lit(float(corpus[1]))})
    else:
        figures = figures.withColumn("one", F.lit(1)).join(counts, "one")
    scored = (hits if length is None else hits.join(length, "entity_id", "left")).withColumn("one", F.lit(1)).join(F.broadcast(figures), "one")
    if kinds is not None:
        scored = scored.join(kinds, "entity_id", "left_semi")
    idf = [F.log((F.col("n_docs") - F.col(f"n{i}") + 0.5) / (F.col(f"n{i}") + 0.5) + 1.0) for i in range(n_terms)]
    norm = k1 * (1.0 - b + b * F.coalesce(F.try_divide(F.coalesce("dl", "avgdl"), F.col("avgdl")), F.lit(1.0)))  # links without weights have no lengths
    posting = lambda i: F.aggregate(f"tf{i}", F.lit(0.0), lambda acc, x: acc + F.coalesce(F.try_divide(x * (k1 + 1.0), x + norm), F.lit(0.0)))
    covered = _sum([F.col(f"has{i}") for i in range(n_terms)])
    score = _sum([idf[i] * posting(i) for i in range(n_terms)])
    if coverage_alpha > 0:
        score = score * F.when(F.col("units") > 1, F.pow(covered / F.col("units"), F.lit(coverage_alpha))).otherwise(1.0)
    for j, w in enumerate(boosts.values()):
        score = score + w * _sum([idf[i] * F.col(f"boost{i}_{j}") for i in range(n_terms)])
    score = F.when(covered > 0, score).when(F.col("defines_it") == 1, F.lit(floor)).otherwise(0.0)
    if coref > 0:
        score = score + coref * _sum([idf[i] * F.col(f"coref{i}") for i in range(n_terms)])
    out = scored.select("entity_id", score.alias("score"))
    return out.orderBy(F.desc("score"), "entity_id").limit(limit) if limit else out


def surprising(links: DataFrame, tails: DataFrame | None = None) -> DataFrame:
    """Links whose mentions weigh 1 - log2 of the share of mentions with at least that frequency: how surprising it is that a term comes that
    often. ``tails`` has a row for each frequency."""
    tails = tf_tail(links) if tails is None else tails
    rows = links.join(F.broadcast(tails.select(F.col("tf").alias("weight"), "tail")), "weight", "left")  # as few rows as frequencies
    known = (F.col("linkage") == "mentions") & F.col("tail").isNotNull()
    return rows.withColumn("weight", F.when(known, 1.0 - F.log2("tail")).otherwise(F.col("weight"))).select(*links.columns)


def term_rank_fusion(links: DataFrame, term_concepts: DataFrame, per_term: int = 100, k: int = RRF_K) -> DataFrame:
    """(entity_id, score): the heaviest ``per_term`` mentions of each concept of (term, concept_id), as rankings that are fused."""
    rows = links.filter("linkage = 'mentions' AND weight IS NOT NULL").join(term_concepts.select("concept_id").distinct(), "concept_id", "left_semi")
    order = W.partitionBy("concept_id").orderBy(F.desc("weight"), "entity_id")
    ranked = rows.withColumn("rank", F.row_number().over(order) - 1).filter(F.col("rank") < per_term)
    return fuse(ranked, k)


def multi_rank(
    links: DataFrame, term_concepts: DataFrame, weights: dict[str, float], k1: float = K1, b: float = B, coverage_alpha: float = 0.0,
    together_alpha: float = 0.0
) -> DataFrame:
    """(entity_id, score): BM25 under each verb of ``weights``, added up by weight.

    Concepts of one term count as one: their frequencies add up. Scores are times the share of terms found to the power of ``coverage_alpha``, and
    times the largest share that a
    single verb finds to the power of ``together_alpha``. Every verb has its own document lengths, numbers and frequencies.
    """
    own = links.filter(F.col("linkage").isin(list(weights)) & F.col("weight").isNotNull())
    length = own.groupBy("linkage", "entity_id").agg(F.sum("weight").alias("dl"))
    corpus = length.groupBy("linkage").agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avgdl"))
    first = term_concepts.groupBy("concept_id").agg(F.min("term").alias("term"))
    tf = own.join(first, "concept_id").groupBy("linkage", "term", "entity_id").agg(F.sum("weight").alias("tf"))
    df = tf.groupBy("linkage", "term").agg(F.count(F.lit(1)).alias("df"))
    weight = F.coalesce(*[F.when(F.col("linkage") == v, F.lit(float(w))) for v, w in weights.items()])
    idf = F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0)
    rows = tf.join(df, ["linkage", "term"]).join(corpus, "linkage").join(length, ["linkage", "entity_id"])
    part = weight * idf * F.col("tf") * (k1 + 1.0) / (F.col("tf") + k1 * (1.0 - b + b * F.col("dl") / F.col("avgdl")))
    units = first.agg(F.countDistinct("term").alias("units")).withColumn("one", F.lit(1))
    by_verb = rows.groupBy("entity_id", "linkage").agg(F.sum(part).alias("score"), F.collect_set("term").alias("terms"))  # as many as the query has
    found = by_verb.groupBy("entity_id").agg(
        F.sum("score").alias("score"), F.size(F.array_distinct(F.flatten(F.collect_list("terms")))).alias("all"), F.max(F.size("terms")).alias("most")
    )
    out = found.withColumn("one", F.lit(1)).join(F.broadcast(units), "one")
    for share, alpha in (("all", coverage_alpha), ("most", together_alpha)):
        if alpha > 0:
            out = out.withColumn("score", F.col("score") * F.pow(F.col(share) / F.col("units"), F.lit(alpha)))
    return out.select("entity_id", "score")


def corpus_stats(links: DataFrame) -> DataFrame:
    """(n_docs, avgdl) of the mention links."""
    return links.filter("linkage = 'mentions'").agg(
        F.countDistinct("entity_id").alias("n_docs"), (F.sum("weight") / F.countDistinct("entity_id")).alias("avgdl")
    )


def document_length(links: DataFrame) -> DataFrame:
    return links.filter("linkage = 'mentions'").groupBy("entity_id").agg(F.sum("weight").alias("length"))


def concept_df(links: DataFrame) -> DataFrame:
    return links.filter("linkage = 'mentions'").groupBy("concept_id").agg(F.count(F.lit(1)).alias("df"))


def tf_tail(links: DataFrame) -> DataFrame:
    """(tf, tail): the share of mention links with at least that term frequency."""
    counts = links.filter("linkage = 'mentions'").groupBy(F.col("weight").alias("tf")).agg(F.count(F.lit(1)).alias("n"))
    # One row per distinct frequency, so a window over all of them is small.
    everything = W.partitionBy(F.lit(1))
    tail = F.sum("n").over(everything.orderBy(F.desc("tf")).rowsBetween(W.unboundedPreceding, W.currentRow)) / F.sum("n").over(everything)
    return counts.select("tf", tail.alias("tail"))


def fuse(ranked: DataFrame, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of (list, entity_id, rank from 0): (entity_id, score)."""
    return ranked.groupBy("entity_id").agg(F.sum(1.0 / (F.lit(float(k)) + F.col("rank"))).alias("score"))


def as_ranks(scored: DataFrame, name: str) -> DataFrame:
    """(list, entity_id, rank) of an already limited ranking."""
    return scored.select(
        F.lit(name).alias("list"), "entity_id", (F.row_number().over(W.partitionBy(F.lit(1)).orderBy(F.desc("score"), "entity_id")) - 1).alias("rank")
    )


def top_weighted(links: DataFrame, linkage: str, concepts: DataFrame, k: int) -> DataFrame:
    """The k heaviest entities of a concept under a linkage; links without a weight don't count."""
    rows = links.filter((F.col("linkage") == linkage) & F.col("weight").isNotNull()).join(
        concepts.select("concept_id").distinct(), "concept_id", "left_semi"
    )
    return rows.groupBy("entity_id").agg(F.max("weight").alias("weight")).orderBy(F.desc("weight"), "entity_id").limit(k)


def per_linkage_top(links: DataFrame, concepts: DataFrame, k: int) -> DataFrame:
    """(linkage, entity_id, weight, rank from 0): the first k entities of each linkage, heaviest first, then by id."""
    rows = links.join(
        concepts.select("concept_id").distinct(), "concept_id", "left_semi"
    ).groupBy("linkage", "entity_id").agg(F.max("weight").alias("weight"))
    order = W.partitionBy("linkage").orderBy(F.desc_nulls_last("weight"), "entity_id")
    return rows.withColumn("rank", F.row_number().over(order) - 1).filter(F.col("rank") < k)


def fused_rows(links: DataFrame, concepts: DataFrame, linkages: Sequence[str], k: int) -> DataFrame:
    """(entity_id, score, linkage): fusion of the linkages' rankings, each entity attributed to the first linkage in the given order."""
    ranked = per_linkage_top(links.filter(F.col("linkage").isin(list(linkages))), concepts, k)
    place = F.array_position(F.array(*[F.lit(x) for x in linkages]), F.col("linkage"))
    return ranked.groupBy("entity_id").agg(
        F.sum(1.0 / (F.lit(float(RRF_K)) + F.col("rank"))).alias("score"), F.min_by("linkage", place).alias("linkage")
    )


def feedback_terms(links: DataFrame, top: DataFrame, query_terms: Sequence[str], stop: Sequence[str], n: int = 5) -> DataFrame:
    """Terms in most of the best documents, apart from the query, function words and words under 3 letters: (concept_id, df)."""
    rows = links.filter("linkage = 'mentions'").join(top.select("entity_id"), "entity_id", "left_semi")
    rows = rows.filter(~F.col("concept_id").isin([*query_terms, *stop]) & (F.length("concept_id") >= 3))
    return rows.groupBy("concept_id").agg(F.countDistinct("entity_id").alias("df")).orderBy(F.desc("df"), "concept_id").limit(n)


def phrase_boost(scored: DataFrame, bodies: DataFrame, terms: Sequence[str], factor: float = 1.5, within: int = 24) -> DataFrame:
    """Scores times ``factor`` where two query terms that follow each other stand in that order at most ``within`` characters apart."""
    import re

    found = F.lit(False)
    for a, b in zip(terms, terms[1:]):
        found = found | F.col("text").rlike(f"(?is){re.escape(a)}.{{0,{within}}}{re.escape(b)}")
    rows = scored.join(bodies, "entity_id", "left")
    return rows.select("entity_id", F.when(F.coalesce(found, F.lit(False)), F.col("score") * factor).otherwise(F.col("score")).alias("score"))


def definition_floor(scored: DataFrame, defining: DataFrame, weight: float = 1.0) -> DataFrame:
    """Entities that define the one identifier asked for come first: best score + 1 + weight."""
    best = F.max("score").over(W.partitionBy(F.lit(1)))  # over a limited ranking
    rows = scored.join(defining.select("entity_id").distinct().withColumn("d", F.lit(1)), "entity_id", "left")
    return rows.select("entity_id", F.when(F.col("d") == 1, best + 1.0 + weight).otherwise(F.col("score")).alias("score"))


def hybrid(symbolic: DataFrame, dense: DataFrame, k: int = 10) -> DataFrame:
    """Fusion of a symbolic and a dense ranking, each cut at max(k, 60) before: (entity_id, score)."""
    return fuse(as_ranks(symbolic, "symbolic").unionByName(as_ranks(dense, "dense"))).orderBy(F.desc("score"), "entity_id").limit(k)


def prefilter(links: DataFrame, concepts: DataFrame, population: int, least: int = 5, most_share: float = 0.5) -> DataFrame | None:
    """Candidates of a dense search: all postings of the query's concepts; None (no filter) under ``least`` or above ``most_share`` of the
    population."""
    found = links.join(concepts.select("concept_id").distinct(), "concept_id", "left_semi").select("entity_id").distinct()
    n = found.count()
    return found if least <= n <= most_share * population else None


def rerank(scored: DataFrame, texts: DataFrame, score_text, k: int, mult: int = 2, most: int = 100) -> DataFrame:
    """The best of a ranking in the order of a scorer: (entity_id, score).

    ``score_text`` is a Column expression or pandas UDF over (text). The pool is min(max(k, k * mult), most); entries without a text, and those after
    the pool, keep their order below the lowest score.
    """
    pool = min(max(k, k * mult), most)
    everything = W.partitionBy(F.lit(1))
    rows = scored.withColumn("place", F.row_number().over(everything.orderBy(F.desc("score"), "entity_id"))).join(texts, "entity_id", "left")
    rows = rows.withColumn("new", F.when((F.col("place") <= pool) & F.col("text").isNotNull(), score_text(F.col("text"))))
    low = F.coalesce(F.min("new").over(everything), F.lit(0.0))
    return rows.select("entity_id", F.coalesce("new", low - 1e-6 * F.col("place")).alias("score")).orderBy(F.desc("score"), "entity_id").limit(k)


def cosine_of_distance(squared: Column) -> Column:
    """Cosine of unit vectors from their squared distance."""
    return 1.0 - squared / 2.0


def salience(
    name: Column, token_shape: Column, df: Column, max_tf: Column, pagerank: Column, degree: Column, n_docs: Column, code_fraction: Column
) -> Column:
    """Worth of showing a concept: centrality, specificity, shape of the token and a bonus for namespaced names."""
    plain = (token_shape == 0) & ~name.contains("/")
    central = F.when(pagerank > 0, F.least(F.lit(2.5), 0.8 * F.log2(pagerank + 1.0))).otherwise(
        F.when(degree > 0, 2.0 + 0.1 * F.least(degree, F.lit(10))).otherwise(0.0)
    )
    central = F.when(
        plain, central * F.when(max_tf <= 0, 0.0).otherwise(F.least(F.lit(1.0), F.log2(max_tf + 1.0) / F.log2(F.lit(9.0))))
    ).otherwise(central)
    weak = F.when(df > 0, 1.0 / F.log2(df + 2)).otherwise(0.3)
    true = F.when((n_docs > 0) & (df > 0), F.log2(F.greatest(F.lit(1.0), n_docs / df))).otherwise(0.0)
    cf = F.greatest(F.lit(0.0), F.least(F.lit(1.0), code_fraction))
    return (0.3 + 0.7 * cf) * central + cf * 1.5 * weak + (1.0 - cf) * 0.25 * true + token_shape + F.when(name.contains("/"), 0.5).otherwise(0.0)


def retrieval_metrics(run: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """(qid, mrr, recall, ndcg) at k of run (qid, doc_id, score) against qrels (qid, doc_id, rel); queries without a relevant document are skipped."""
    ranked = run.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), "doc_id"))).filter(F.col("rank") <= k)
    relevant = qrels.filter("rel > 0")
    gain = lambda rel, rank: (F.pow(F.lit(2.0), rel) - 1) / F.log2(rank + 1.0)
    ideal = relevant.withColumn("best", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("rel"), "doc_id")))
    ideal = ideal.groupBy("qid").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("best") <= k, gain(F.col("rel"), F.col("best"))).otherwise(0.0)).alias("idcg")
    )
    hits = ranked.join(relevant, ["qid", "doc_id"]).groupBy("qid").agg(
        F.min("rank").alias("first"), F.count(F.lit(1)).alias("found"), F.sum(gain(F.col("rel"), F.col("rank"))).alias("dcg")
    )
    rows = ideal.join(hits, "qid", "left")
    return rows.select(
        "qid", F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"), F.coalesce(F.col("found") / F.col("n"), F.lit(0.0)).alias("recall"),
        F.coalesce(F.col("dcg") / F.col("idcg"), F.lit(0.0)).alias("ndcg")
    )
