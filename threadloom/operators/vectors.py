"""Dense vectors: exact nearest neighbours, similarity graphs, clusters of documents and their labels."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadloom.operators.walks import communities
from threadloom.staging import stage

#: Rows of a block in blocked all-pairs searches.
BLOCK = 2048


def normalized(col: Column) -> Column:
    """A vector of length 1; a zero vector stays as it is."""
    norm = F.sqrt(F.aggregate(col, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(col, lambda x: x / norm)).otherwise(col.cast("array<double>"))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, d: s + d
    )


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, d: s + d)


def read_vectors(stored: DataFrame, ids: DataFrame | None = None, kind: str | None = None) -> DataFrame:
    """Stored vectors of a kind (where the table has kinds) and of the ids (id) given, each id once."""
    rows = stored if kind is None else stored.filter(F.col("kind") == kind)
    return rows if ids is None else rows.join(ids.select("id").distinct(), "id", "left_semi")


def nearest(vectors: DataFrame, query: list[float], k: int, ids: DataFrame | None = None) -> DataFrame:
    """(id, distance): the k vectors nearest to one query by squared Euclidean distance, exactly; ``ids`` restricts the search, and an empty one
    finds nothing."""
    rows = vectors.join(ids.select("id").distinct(), "id", "left_semi") if ids is not None else vectors
    bad = rows.filter(F.size("vector") != len(query)).limit(1).count()
    if bad:
        raise ValueError(f"a vector doesn't have {len(query)} dimensions")
    d = squared_distance(F.col("vector"), F.array(*[F.lit(float(x)) for x in query]))
    return rows.select("id", d.alias("distance")).orderBy("distance", "id").limit(k)


def _best(a: list, b: list, k: int, threshold: float) -> pd.DataFrame:
    """The k best of block b for each query of block a, by one matrix product."""
    ai, bi = np.array([r["id"] for r in a]), np.array([r["id"] for r in b])
    am, bm = (np.array([np.asarray(r["vector"], dtype=np.float64) for r in x]) for x in (a, b))
    am, bm = (m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300) for m in (am, bm))
    sim = am @ bm.T
    sim[ai[:, None] == bi[None, :]] = -3.0
    order = np.lexsort((np.broadcast_to(bi, sim.shape), -np.round(sim, 12)), axis=1)[:, :k]
    best = np.take_along_axis(sim, order, axis=1)
    keep = best > threshold
    return pd.DataFrame({"id": np.repeat(ai, keep.sum(axis=1)), "other": bi[order][keep], "cosine": best[keep]})


def _search(pairs: DataFrame, k: int, threshold: float) -> DataFrame:
    """(id, other, cosine): the k best over all pairs of blocks (q, v)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for a, b in zip(frame["q"], frame["v"]):
                yield _best(a, b, k, threshold)

    near = pairs.select("q", "v").mapInPandas(run, "id long, other long, cosine double").distinct()
    order = W.partitionBy("id").orderBy(F.desc(F.round("cosine", 12)), "other")
    return near.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= k).drop("_n")


def _blocks(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("id", "vector"))).alias(name))


def knn_join(queries: DataFrame, vectors: DataFrame, k: int, threshold: float = -2.0, size: int = BLOCK) -> DataFrame:
    """(id, other, cosine): for each query the k vectors of highest cosine above the threshold, itself left out; ties go to the smaller id. Exact.

    Every block of queries is sent to every block of vectors, by the number of that block, and meets it in a matrix product; only the k best of a
    block go on. Work and traffic grow
    with the number of queries times that of blocks, which suits a stated set of queries; for all rows against all, ``knn_cells`` looks at likely
    blocks only.
    """
    nq, nv = (max(1, -(-x.count() // size)) for x in (queries, vectors))
    block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    v = _blocks(vectors.select("id", "vector", block(nv).alias("vb")), ["vb"], "v")
    q = _blocks(queries.select("id", "vector", block(nq).alias("qb")), ["qb"], "q").withColumn("vb", F.explode(F.sequence(F.lit(0), F.lit(nv - 1))))
    return _search(q.join(v.hint("merge"), "vb"), k, threshold)


#: Most vectors that cells are fitted on, most cells, queries that the search is calibrated with, and the recall that it is calibrated for.
SAMPLE, MOST_CELLS, ASKED, RECALL = 50_000, 4096, 1000, 0.95


@dataclass(frozen=True)
class Cells:
    """Centres of inverted lists, and how many of them, the nearest ones, a query has to look into."""

    centres: np.ndarray
    probes: int


def fit_cells(
    vectors: DataFrame, cells: int | None = None, sample: int = SAMPLE, rounds: int = 12, seed: int = 0, k: int = 10, recall: float = RECALL
) -> Cells:
    """Cells by spherical k-means on a bounded sample of ``sample`` vectors at most; about as many as the square root of the number of vectors, up
    to ``MOST_CELLS``.

    For up to ``ASKED`` vectors of the sample their k nearest in the sample are found, and as many cells are looked into as hold the share
    ``recall`` of these. In the whole
    collection, which is denser, neighbours are nearer. Vectors without any structure need most cells, clustered ones few.
    """
    n = vectors.count()
    chosen = vectors.orderBy(F.xxhash64("id", F.lit(seed))).limit(sample) if n > sample else vectors
    rows = chosen.select("vector").toPandas()["vector"]
    x = np.array([v for v in (np.asarray(v, dtype=np.float64) for v in rows) if v.any()])
    if not len(x):
        return Cells(np.ones((1, 1)), 1)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    order = np.random.default_rng(seed).permutation(len(x))
    count = min(cells or max(1, round(n**0.5)), MOST_CELLS, len(x))
    centres = x[order[:count]]
    for _ in range(rounds):
        own = np.argmax(x @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 0, sums / np.maximum(norm, 1e-300), centres)
    own = np.argmax(x @ centres.T, axis=1)
    asked = order[:ASKED]
    near = x[asked] @ x.T
    near[np.arange(len(asked)), asked] = -3.0
    near = np.argsort(-near, axis=1)[:, : min(k, len(x) - 1)]
    place = np.argsort(np.argsort(-(x[asked] @ centres.T), axis=1), axis=1)
    places = np.take_along_axis(place, own[near], axis=1)
    return Cells(centres, int(np.quantile(places, recall, method="higher")) + 1 if places.size else count)


def _in_cells(rows: DataFrame, centres: np.ndarray, probes: int) -> DataFrame:
    """(id, vector, cell): rows in the ``probes`` cells nearest to them."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not len(frame):
                continue
            x = np.array([np.asarray(v, dtype=np.float64) for v in frame["vector"]])
            if centres.shape == (1, 1) and x.shape[1] != 1:
                continue  # no vectors to be found
            near = np.argpartition(-(x @ centres.T), min(probes, len(centres)) - 1, axis=1)[:, :probes]
            at = np.repeat(np.arange(len(frame)), near.shape[1])
            yield pd.DataFrame({"id": frame["id"].to_numpy()[at], "vector": frame["vector"].to_numpy()[at], "cell": near.ravel()})

    return rows.select("id", F.col("vector").cast("array<double>").alias("vector")).mapInPandas(run, "id long, vector array<double>, cell long")


def knn_cells(queries: DataFrame, vectors: DataFrame, k: int, threshold: float = -2.0, cells: Cells | None = None, size: int = BLOCK) -> DataFrame:
    """The same as ``knn_join`` within inverted lists: every vector lies in the cell of its nearest centre, and a query looks into as many cells
    as ``fit_cells`` found to be needed.

    Approximate: a neighbour in another cell is missed. All rows are indexed; only the cells are fitted on a sample. A cell with more than
    ``size`` vectors is several blocks.
    """
    cells = fit_cells(vectors, k=k) if cells is None else cells
    lists = stage(_in_cells(vectors, cells.centres, 1), "cells")
    parts = lists.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(size)).cast("int").alias("n"))
    place = F.pmod(F.xxhash64("id"), F.col("n")).cast("int")
    v = _blocks(lists.join(parts, "cell").withColumn("part", place), ["cell", "part"], "v")
    asked = _in_cells(queries, cells.centres, cells.probes)
    counts = asked.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(size)).cast("int").alias("n"))
    q = _blocks(asked.join(counts, "cell").withColumn("qpart", place), ["cell", "qpart"], "q")
    return _search(q.join(v, "cell"), k, threshold)


def recall_of(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(recall, n): the share of the true neighbours (id, other) that were found."""
    hit = exact.select("id", "other").join(found.select("id", "other").distinct().withColumn("hit", F.lit(1)), ["id", "other"], "left")
    return hit.agg(F.avg(F.coalesce("hit", F.lit(0)).cast("double")).alias("recall"), F.count(F.lit(1)).alias("n"))


def mutual_knn(vectors: DataFrame, k: int, threshold: float, exact: bool = True) -> DataFrame:
    """(a, b, weight), a < b: pairs that are among each other's k nearest, weighing (cosine - t) / (1 - t). Exact among all, or within cells."""
    near = knn_join(vectors, vectors, k, threshold) if exact else knn_cells(vectors, vectors, k, threshold)
    return mutual_of(near, threshold)


def cosine_percentile(pairs: DataFrame, p: float) -> DataFrame:
    """(threshold): the interpolated percentile of the cosines of pairs."""
    return pairs.agg(F.percentile("cosine", F.lit(p)).alias("threshold"))


def informative_concepts(doc_concepts: DataFrame, least: int = 2, most_share: float = 0.10) -> DataFrame:
    """(entity_id, concept, idf): concepts, in lower case, of at least 2 and at most max(2, int(share * N)) documents."""
    rows = doc_concepts.select("entity_id", F.lower("concept").alias("concept")).distinct()
    n = rows.select("entity_id").distinct().count()
    df = rows.groupBy("concept").agg(F.count(F.lit(1)).alias("df")).filter((F.col("df") >= least) & (F.col("df") <= max(least, int(most_share * n))))
    return rows.join(df, "concept").select("entity_id", "concept", F.log(F.lit(float(n)) / F.col("df")).alias("idf"))


#: From this similarity on, documents without a dense edge are bridged by their concepts.
BRIDGE_FROM = 0.35


def concept_norms(sets: DataFrame) -> DataFrame:
    """(entity_id, concepts, norm): the documents' concepts with idf, as one row each."""
    return sets.groupBy("entity_id").agg(
        F.map_from_entries(F.collect_list(F.struct("concept", "idf"))).alias("concepts"), F.sqrt(F.sum(F.col("idf") * F.col("idf"))).alias("norm")
    )


def cosine_of_pairs(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, cosine): similarity of given pairs of documents by the squared idf of the concepts that they share."""
    rows = concept_norms(sets)
    side = lambda s: rows.select(F.col("entity_id").alias(s), F.col("concepts").alias(f"c{s}"), F.col("norm").alias(f"n{s}"))
    both = pairs.select("a", "b").distinct().join(side("a"), "a").join(side("b"), "b")
    dot = F.aggregate(F.map_keys("ca"), F.lit(0.0), lambda t, c: t + F.coalesce(F.try_element_at("ca", c) * F.try_element_at("cb", c), F.lit(0.0)))
    return both.select("a", "b", F.try_divide(dot, F.col("na") * F.col("nb")).alias("cosine")).filter("cosine > 0")


def concept_classes(sets: DataFrame) -> DataFrame:
    """(entity_id, representative): documents with the same concepts are one class, which its smallest id stands for."""
    rows = sets.groupBy("entity_id").agg(F.xxhash64(F.array_sort(F.collect_list("concept"))).alias("same"))
    first = rows.groupBy("same").agg(F.min("entity_id").alias("representative"))
    return rows.join(first, "same").select("entity_id", "representative")


def concept_cosine(sets: DataFrame, least: float = BRIDGE_FROM) -> DataFrame:
    """(a, b, cosine), a < b: all pairs of documents whose similarity by the squared idf of shared concepts is above ``least``, which is above 0.

    Concepts are ordered from rare to frequent. What is left of a document after its prefix is so short that it can't bring the similarity to
    ``least`` by itself; so the first concept
    that two similar documents share lies in both their prefixes, where they meet. No pair is lost, frequent concepts hardly ever are in a prefix,
    and the candidates' similarity is exact.

    Documents with the same concepts are alike without more ado and may be very many: give it the sets of representatives (``concept_classes``),
    and the classes
    say what they stand for.
    """
    if least <= 0:
        raise ValueError("the least similarity must be above 0")
    norm = sets.groupBy("entity_id").agg(F.sqrt(F.sum(F.col("idf") * F.col("idf"))).alias("norm")).filter("norm > 0")
    falling = F.array_sort(F.collect_list(F.struct((-F.col("idf")).alias("i"), "concept")))
    rows = sets.join(norm, "entity_id").groupBy("entity_id", "norm").agg(falling.alias("cs"))
    # Squared weight of what follows each concept, itself included; a place belongs to the prefix while that is not below the bound.
    after = F.transform("cs", lambda x, i: F.aggregate(F.slice(F.col("cs"), i + 1, F.size("cs")), F.lit(0.0), lambda t, y: t + y["i"] * y["i"]))
    bound = F.col("norm") * F.col("norm") * (least * least * (1 - 1e-9))
    prefix = F.filter("cs", lambda x, i: F.get(F.col("after"), i) >= F.col("bound"))
    rows = rows.withColumns({"after": after, "bound": bound}).select(
        "entity_id", F.explode(F.transform(prefix, lambda x: x["concept"])).alias("concept")
    )
    a, b = (rows.select("concept", F.col("entity_id").alias(s)) for s in "ab")
    pairs = a.join(b, "concept").filter("a < b").select("a", "b").distinct()
    return cosine_of_pairs(pairs, sets).filter(F.col("cosine") > least)


def fuse_edges(dense: DataFrame, sparse: DataFrame, beta: float = 1.0, gamma: float = 0.5, bridge_from: float = BRIDGE_FROM) -> DataFrame:
    """(a, b, weight): dense edges times 1 + beta * s; pairs without one become bridges of gamma * s where s is at least ``bridge_from``."""
    rows = dense.join(sparse.select("a", "b", F.col("cosine").alias("s")), ["a", "b"], "full")
    s = F.coalesce("s", F.lit(0.0))
    return rows.select(
        "a", "b", F.when(F.col("weight").isNotNull(), F.col("weight") * (1 + beta * s)).when(s >= bridge_from, gamma * s).alias("weight")
    ).filter("weight IS NOT NULL")


def cluster_labels(members: DataFrame, sets: DataFrame, n_docs: int, least: int = 2) -> DataFrame:
    """(cluster, label, lift): each cluster's concept of highest lift among those that at least ``least`` of its members have."""
    sizes = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    df = sets.groupBy("concept").agg(F.count(F.lit(1)).alias("df"))
    inside = sets.join(members, "entity_id").groupBy("cluster", "concept").agg(
        F.count(F.lit(1)).alias("df_in"), F.max("idf").alias("idf")
    ).filter(F.col("df_in") >= least)
    rows = inside.join(df, "concept").join(sizes, "cluster").withColumn("lift", (F.col("df_in") / F.col("size")) / (F.col("df") / F.lit(n_docs)))
    order = W.partitionBy("cluster").orderBy(F.desc(F.round("lift", 9)), F.desc("df_in"), F.desc(F.round("idf", 9)), "concept")
    return rows.withColumn("_n", F.row_number().over(order)).filter("_n = 1").select("cluster", F.col("concept").alias("label"), "lift")


def crosscutting(members: DataFrame, sets: DataFrame, k: int = 12) -> DataFrame:
    """(concept, score): concepts of several clusters by df * idf / (spread - 1)."""
    rows = sets.join(members, "entity_id").groupBy("concept").agg(
        F.count(F.lit(1)).alias("df"), F.max("idf").alias("idf"), F.countDistinct("cluster").alias("spread")
    ).filter("spread > 1")
    return rows.select(
        "concept", (F.col("df") * F.col("idf") / (F.col("spread") - 1)).alias("score")
    ).orderBy(F.desc(F.round("score", 9)), "concept").limit(k)


# --- coverage reports ----------------------------------------------------------------------------------


def corroborated_concepts(links: DataFrame, entities: DataFrame, members: int = 3, days: int = 3) -> DataFrame:
    """(concept_id, members, days): concepts that memories of several days hold."""
    m = entities.filter("kind = 'memory'").select(F.col("id").alias("entity_id"), F.floor(F.col("created_at") / 86400).alias("day"))
    return links.join(m, "entity_id").groupBy("concept_id").agg(
        F.countDistinct("entity_id").alias("members"), F.countDistinct("day").alias("days")
    ).filter((F.col("members") >= members) & (F.col("days") >= days))


def singletons(links: DataFrame, entities: DataFrame) -> DataFrame:
    """(concept_id, entity_id): concepts that a single memory holds."""
    m = entities.filter("kind = 'memory'").select(F.col("id").alias("entity_id"))
    return links.join(m, "entity_id").groupBy("concept_id").agg(
        F.countDistinct("entity_id").alias("n"), F.min("entity_id").alias("entity_id")
    ).filter("n = 1").drop("n")


def contradicted(links: DataFrame) -> DataFrame:
    """(concept_id, entity_id): contradictions that nothing supersedes, in either direction."""
    over = links.filter("linkage = 'supersedes'")
    either = over.select("concept_id", "entity_id").union(over.select("entity_id", "concept_id"))
    return links.filter("linkage = 'contradicts'").select("concept_id", "entity_id").distinct().join(either, ["concept_id", "entity_id"], "left_anti")


def orphan_concepts(links: DataFrame, least: int = 4) -> DataFrame:
    """(concept_id, mentions): concepts mentioned at least ``least`` times that nothing defines or leads with."""
    seen = links.filter("linkage = 'mentions'").groupBy("concept_id").agg(
        F.countDistinct("entity_id").alias("mentions")
    ).filter(F.col("mentions") >= least)
    return seen.join(links.filter(F.col("linkage").isin("defines", "lead")).select("concept_id"), "concept_id", "left_anti")


# --- documents compiled into subjects ---------------------------------------------------------------------


def compile_subjects(
    vectors: DataFrame, doc_concepts: DataFrame, k: int = 8, percentile: float = 0.90, least: int = 2, beta: float = 1.0, gamma: float = 0.5,
    bridge_from: float = BRIDGE_FROM, signal: str = "fused"
) -> tuple[DataFrame, DataFrame]:
    """Clusters of documents, (entity_id, cluster), and their labels, (cluster, label, lift).

    Dense edges join mutual neighbours above a percentile of the neighbours' cosines; concept edges come from the idf-weighted sets; ``signal``
    takes ``dense``, ``concept`` or
    both ``fused``. Communities of the edges are the clusters; documents in none are left out.
    """
    sets = stage(informative_concepts(doc_concepts), "concept-sets")
    near = stage(knn_cells(vectors, vectors, k), "near") if signal != "concept" else None
    none = sets.select(F.col("entity_id").alias("a"), F.col("entity_id").alias("b"), F.lit(0.0).alias("weight")).limit(0)
    dense = none
    if near is not None:
        threshold = cosine_percentile(near, percentile).first()[0]
        if threshold is not None and threshold < 1.0:
            dense = stage(mutual_of(near.filter(F.col("cosine") > threshold), threshold), "dense-edges")
    # The similarity by concepts counts for every dense edge, and for other pairs from the bridge on.
    sparse = none.withColumnRenamed("weight", "cosine")
    if signal != "dense":
        classes = stage(concept_classes(sets), "concept-classes")
        first = sets.join(classes.filter("entity_id = representative").select("entity_id"), "entity_id", "left_semi")
        # A class hangs together by its representative.
        alike = classes.filter("entity_id != representative").select(
            F.col("representative").alias("a"), F.col("entity_id").alias("b"), F.lit(1.0).alias("cosine")
        )
        sparse = concept_cosine(first, bridge_from).unionByName(alike).unionByName(cosine_of_pairs(dense, sets)).dropDuplicates(["a", "b"])
    edges = stage(fuse_edges(dense, sparse, beta, gamma, bridge_from), "subject-edges")
    both = edges.select(F.col("a").alias("src"), F.col("b").alias("dst"), "weight").unionByName(
        edges.select(F.col("b").alias("src"), F.col("a").alias("dst"), "weight")
    )
    members = stage(communities(both, least=least).select(F.col("id").alias("entity_id"), F.col("label").alias("cluster")), "subjects")
    n = sets.select("entity_id").distinct().count()
    return members, cluster_labels(members, sets, max(n, 1), least)


def mutual_of(near: DataFrame, threshold: float) -> DataFrame:
    """(a, b, weight), a < b: the pairs of a neighbour table (id, other, cosine) that are in it both ways."""
    back = near.select(F.col("other").alias("id"), F.col("id").alias("other"))
    both = near.join(back, ["id", "other"], "left_semi").filter("id < other")
    return both.select(F.col("id").alias("a"), F.col("other").alias("b"), ((F.col("cosine") - threshold) / (1.0 - threshold)).alias("weight"))


def subject_links(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(linkage, concept, entity_id): members as ``part-of`` their subject, named by its label (``subject-<id>`` without one)."""
    named = members.join(labels.select("cluster", "label"), "cluster", "left")
    return named.select(
        F.lit("part-of").alias("linkage"),
        F.concat(F.lit("subject/"), F.coalesce("label", F.concat(F.lit("subject-"), F.col("cluster").cast("string")))).alias("concept"), "entity_id"
    )
