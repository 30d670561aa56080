"""Graph algorithms over the stored links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.graph import store_graph
from threadloom.operators import dsl, walks
from threadloom.plans.set_algebra import A, B, STORE, _named

SEEDS = [A, B]
#: Names of frequent concepts, so that something comes with them more often than by chance.
LIFT_SEEDS = ["index_hub_root", "overview"]
ROUNDS = 10


def _typed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    graph = store_graph(spark, sf_dir)
    return graph.links, dsl.resolve(graph, SEEDS).select("concept_id").distinct()


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return walks.adjacency(store_graph(spark, sf_dir).links)


def adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir)


def pagerank_k10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten rounds over all nodes."""
    return walks.pagerank(_edges(spark, sf_dir), ROUNDS, tolerance=0.0).select("id", F.round("score", 6).alias("score"))


def ppr_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten rounds of the personalised walk from the seeds."""
    links, seeds = _typed(spark, sf_dir)
    return walks.pagerank(
        walks.adjacency(links), ROUNDS, tolerance=0.0, restart=seeds.select(F.col("concept_id").alias("id"), F.lit(1.0).alias("weight"))
    ).select("id", F.round("score", 6).alias("score"))


def ppr_push(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local pushes from the concepts with the seeds' names, over all links."""
    links, seeds = _typed(spark, sf_dir)
    return walks.ppr_push(walks.adjacency(links), [r[0] for r in seeds.orderBy("concept_id").collect()])


def rank_related(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The concepts that a walk from the seeds visits most, without cards of sessions."""
    graph = store_graph(spark, sf_dir)
    seeds = dsl.resolve(graph, SEEDS).select("concept_id").distinct()
    return walks.related(graph.links, graph.entities, sorted(r[0] for r in seeds.collect()), 20)


def seed_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    links, seeds = _typed(spark, sf_dir)
    return walks.seed_coverage(
        walks.adjacency(links), seeds.select(F.col("concept_id").alias("id"))
    ).select("id", F.round("coverage", 6).alias("coverage"))


def enrich_walk_h2(spark: SparkSession, sf_dir: str) -> DataFrame:
    links, seeds = _typed(spark, sf_dir)
    found = walks.degree_walk(walks.adjacency(links), seeds.select(F.col("concept_id").alias("id"), F.lit(1.0).alias("weight")))
    return found.select("id", F.round("score", 6).alias("score"), "reach")


def net_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    links, seeds = _typed(spark, sf_dir)
    return walks.corroborated(walks.adjacency(links), seeds.select(F.col("concept_id").alias("id")))


def assoc_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = store_graph(spark, sf_dir)
    seeds = dsl.resolve(graph, LIFT_SEEDS).select("concept_id").distinct()
    return walks.lift(graph.links, seeds).select("concept_id", F.round("lift", 6).alias("lift"), "co")


def label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Communities of all links."""
    return walks.communities(_edges(spark, sf_dir))


def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest id that each linked node is connected with, over all links."""
    return walks.connected(_edges(spark, sf_dir))


def footprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    links, seeds = _typed(spark, sf_dir)
    return walks.footprint(links, seeds, hops=1)


QUERIES = {
    f.__name__: f
    for f in (
        adjacency, pagerank_k10, ppr_exact, ppr_push, rank_related, seed_coverage, enrich_walk_h2, net_support, assoc_lift, label_propagation,
        connected_components, footprint
    )
}

_ADJ = (
    STORE.replace("WITH ", "WITH RECURSIVE ", 1)
    + """, e1 AS (SELECT concept_id AS src, entity_id AS dst, CASE WHEN linkage = 'mentions' THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight FROM lnk WHERE concept_id <> entity_id),
adj AS (SELECT src, dst, sum(weight) AS weight FROM (SELECT * FROM e1 UNION ALL SELECT dst, src, weight FROM e1) GROUP BY 1, 2)
"""
)
_SEEDS = f"sd AS (SELECT DISTINCT concept_id AS id FROM ({_named(A)} UNION {_named(B)}))"


def _rank(base: str, scale: str) -> str:
    steps = [f"r0 AS ({base})"]
    for i in range(ROUNDS):
        steps.append(
            f"r{i + 1} AS (SELECT b.id, b.base, 0.15 * b.base + 0.85 * coalesce(f.s, 0) AS score FROM r0 b LEFT JOIN (SELECT dst, sum(score * share) AS s FROM mv JOIN r{i} ON src = id GROUP BY 1) f ON f.dst = b.id)"
        )
    return _ADJ + ", mv AS (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS share FROM adj), ids AS (SELECT DISTINCT src AS id FROM adj), " + _SEEDS + ", " + ", ".join(steps) + f" SELECT id, round(score{scale}, 6) AS score FROM r{ROUNDS} WHERE (SELECT sum(base) FROM r0) > 0"


ORACLE = {
    "adjacency": _ADJ + "SELECT src, dst, weight FROM adj",
    "pagerank_k10": _rank(
        "SELECT id, 1.0::DOUBLE / (SELECT count(*) FROM ids) AS base, 1.0::DOUBLE / (SELECT count(*) FROM ids) AS score FROM ids",
        " * (SELECT count(*) FROM ids)"
    ),
    "ppr_exact": _rank(
        "SELECT id, CASE WHEN id IN (SELECT id FROM sd) THEN 1.0::DOUBLE / (SELECT count(*) FROM sd JOIN ids USING (id)) ELSE 0 END AS base, CASE WHEN id IN (SELECT id FROM sd) THEN 1.0::DOUBLE / (SELECT count(*) FROM sd JOIN ids USING (id)) ELSE 0 END AS score FROM ids",
        ""
    ),
    "seed_coverage": _ADJ
    + f", {_SEEDS}, nb AS (SELECT DISTINCT src, dst FROM adj WHERE src IN (SELECT id FROM sd)), h AS (SELECT *, count(*) OVER (PARTITION BY dst) AS n FROM nb) SELECT src AS id, round(avg(CASE WHEN n > 1 THEN 1.0 ELSE 0.0 END), 6) AS coverage FROM h GROUP BY 1",
    "enrich_walk_h2": _ADJ
    + f""", {_SEEDS}, mv AS (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS share FROM adj), s0 AS (SELECT id, 1.0::DOUBLE AS w, id AS frm FROM sd WHERE id IN (SELECT src FROM adj)),
h1 AS (SELECT dst AS id, w * share * 0.35 AS w, frm FROM s0 JOIN mv ON src = id), t0 AS (SELECT id, sum(w) AS w FROM h1 GROUP BY 1), t1 AS (SELECT * FROM t0 ORDER BY round(w, 12) DESC, id LIMIT 4000),
h2 AS (SELECT dst AS id, w * share * 0.35 ** 2 AS w FROM t1 JOIN mv ON src = id),
f2 AS (SELECT DISTINCT dst AS id, frm FROM (SELECT DISTINCT id, frm FROM h1 WHERE id IN (SELECT id FROM t1)) JOIN mv ON src = id),
aw AS (SELECT id, sum(w) AS w FROM (SELECT id, w FROM s0 UNION ALL SELECT id, w FROM h1 UNION ALL SELECT id, w FROM h2) GROUP BY 1), af AS (SELECT id, count(DISTINCT frm) AS reach FROM (SELECT id, frm FROM s0 UNION SELECT id, frm FROM h1 UNION SELECT * FROM f2) GROUP BY 1)
SELECT id, round(w * (reach / (SELECT count(*) FROM s0)) ** 2, 6) AS score, reach FROM aw JOIN af USING (id)""",
    "net_support": _ADJ
    + f", {_SEEDS} SELECT dst AS id, count(DISTINCT src) AS support FROM adj WHERE src IN (SELECT id FROM sd) AND dst NOT IN (SELECT id FROM sd) GROUP BY 1 HAVING count(DISTINCT src) >= 2",
    "assoc_lift": STORE
    + f""", sd AS (SELECT DISTINCT concept_id AS id FROM ({_named(LIFT_SEEDS[0])} UNION {_named(LIFT_SEEDS[1])})), men AS (SELECT DISTINCT concept_id, entity_id FROM lnk WHERE linkage = 'mentions'), cov AS (SELECT entity_id, count(*) AS n FROM men WHERE concept_id IN (SELECT id FROM sd) GROUP BY 1),
anc AS (SELECT entity_id FROM cov WHERE n >= 2 OR NOT EXISTS (SELECT 1 FROM cov WHERE n >= 2) ORDER BY n DESC, entity_id LIMIT 4000), c AS (SELECT concept_id, count(*) AS df, count(*) FILTER (WHERE entity_id IN (SELECT entity_id FROM anc)) AS co FROM men GROUP BY 1),
z AS (SELECT *, (co / (SELECT count(*) FROM anc)) / (df / (SELECT count(DISTINCT entity_id) FROM men)) AS lift FROM c WHERE co >= 2 AND concept_id NOT IN (SELECT id FROM sd) AND df <= 0.25 * (SELECT count(DISTINCT entity_id) FROM men))
SELECT concept_id, round(lift, 6) AS lift, co FROM z WHERE lift > 1""",
    "footprint": STORE
    + f""", {_SEEDS}, c AS (SELECT * FROM lnk), n0 AS (SELECT DISTINCT entity_id FROM c WHERE concept_id IN (SELECT id FROM sd)),
n1 AS (SELECT DISTINCT entity_id FROM c WHERE concept_id IN (SELECT concept_id FROM c WHERE entity_id IN (SELECT entity_id FROM n0)))
SELECT entity_id, min(hop) AS hop FROM (SELECT entity_id, 0 AS hop FROM n0 UNION ALL SELECT entity_id, 1 FROM n1) GROUP BY 1 ORDER BY 2, 1 LIMIT 200""",
}
