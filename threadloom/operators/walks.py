"""Graph algorithms over concept links: adjacency, PageRank, walks, association, corroboration, communities."""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadloom.staging import stage

DAMPING, TOLERANCE, MOST_ROUNDS = 0.85, 1e-7, 100
#: Names of operational entities, which walks leave out.
OPERATIONAL = r"(?i)^(session|digest)[-_]"
#: The most edges that the sequential (order-dependent) algorithms take; larger graphs have distributed variants.
MOST_LOCAL_EDGES = 5_000_000


def adjacency(links: DataFrame, nodes: DataFrame | None = None, link_weight: float = 2.0, mentions: str = "flat") -> DataFrame:
    """(src, dst, weight), undirected: a mention weighs 1 (``flat``), its weight (``weighted``) or both added; other links ``link_weight`` times
    their absolute weight (null is 1).

    Parallel edges add up; self loops are dropped; with ``nodes`` (id), both ends must be among them.
    """
    w = F.abs(F.coalesce("weight", F.lit(1.0)))
    mention = {"flat": F.lit(1.0), "weighted": w, "both": 1.0 + w}[mentions]
    edges = links.filter("concept_id != entity_id").select(
        F.col("concept_id").alias("src"), F.col("entity_id").alias("dst"),
        F.when(F.col("linkage") == "mentions", mention).otherwise(link_weight * w).alias("weight")
    )
    if nodes is not None:
        own = nodes.select("id").distinct()
        edges = edges.join(own.withColumnRenamed("id", "src"), "src", "left_semi").join(own.withColumnRenamed("id", "dst"), "dst", "left_semi")
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    return both.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def pagerank(
    edges: DataFrame, rounds: int = MOST_ROUNDS, damping: float = DAMPING, tolerance: float = TOLERANCE, restart: DataFrame | None = None,
    every: int = 5
) -> DataFrame:
    """(id, score): weighted PageRank with dangling mass spread again, times the number of nodes (mean 1).

    ``restart`` (id, weight) makes it personalised: the walk restarts there, and scores are probabilities. Edges and transition shares are staged
    once,
    the ranks every few rounds, so that the plan stays short and lost executors cost little; it stops when the ranks move less than ``tolerance``
    in total.
    """
    total = edges.groupBy(F.col("src").alias("s")).agg(F.sum("weight").alias("out"))
    moves = stage(edges.join(total, F.col("src") == F.col("s")).select("src", "dst", (F.col("weight") / F.col("out")).alias("share")), "moves")
    ids = stage(moves.select(F.col("src").alias("id")).union(moves.select("dst")).distinct(), "nodes")
    n = ids.count()
    if not n:
        return ids.withColumn("score", F.lit(0.0))
    dangling = stage(ids.join(moves.select(F.col("src").alias("id")).distinct(), "id", "left_anti"), "dangling")
    has_dangling = dangling.limit(1).count() > 0
    if restart is None:
        base = ids.withColumn("base", F.lit(1.0 / n))
    else:
        mass = restart.groupBy("id").agg(F.sum("weight").alias("w")).join(ids, "id", "left_semi")
        whole = mass.agg(F.sum("w")).first()[0]
        if not whole:
            return ids.limit(0).withColumn("score", F.lit(0.0))
        base = ids.join(mass, "id", "left").select("id", (F.coalesce("w", F.lit(0.0)) / whole).alias("base"))
    base = stage(base, "restart")
    ranks = base.select("id", F.col("base").alias("score"))
    for turn in range(1, rounds + 1):
        lost = (ranks.join(dangling, "id", "left_semi").agg(F.sum("score")).first()[0] or 0.0) if has_dangling else 0.0
        inflow = moves.join(ranks, F.col("src") == F.col("id")).groupBy("dst").agg(F.sum(F.col("score") * F.col("share")).alias("inflow"))
        new = base.join(inflow, F.col("id") == F.col("dst"), "left").select(
            "id", ((1 - damping) * F.col("base") + damping * (F.coalesce("inflow", F.lit(0.0)) + F.lit(lost) * F.col("base"))).alias("score")
        )
        if turn % every == 0 and turn < rounds:
            new = stage(new, "ranks")
            moved = new.join(ranks.withColumnRenamed("score", "old"), "id").agg(F.sum(F.abs(F.col("score") - F.col("old")))).first()[0] or 0.0
            if moved < tolerance:
                ranks = new
                break
        ranks = new
    return ranks.withColumn("score", F.col("score") * n) if restart is None else ranks


def push(
    src: np.ndarray, dst: np.ndarray, weight: np.ndarray, seeds: list[int], alpha: float = 0.15, epsilon: float = 1e-4, most: int = 200_000
) -> dict[int, float]:
    """Approximate personalised PageRank by lazy local pushes, first in first out; deterministic for edges in a given order.

    A node is due while its rest exceeds epsilon times its weighted degree. The mass of seeds without edges stays where it is.
    """
    near: dict[int, list[tuple[int, float]]] = {}
    for s, d, w in zip(src.tolist(), dst.tolist(), weight.tolist()):
        near.setdefault(s, []).append((d, w))
    return push_known(near, {u: sum(w for _, w in x) for u, x in near.items()}, seeds, alpha, epsilon, most)[0]


def push_known(
    near: dict[int, list[tuple[int, float]]], degrees: dict[int, float], seeds: list[int] | dict[int, float], alpha: float, epsilon: float, most: int
) -> tuple[dict[int, float], set[int]]:
    """What is settled by pushes over the nodes whose edges are known, and the nodes that are due but aren't known. ``degrees`` are weighted."""
    given = list(seeds.items()) if isinstance(seeds, dict) else [(s, 1.0) for s in seeds]
    mass = sum(m for _, m in given) or 1.0
    rest: dict[int, float] = {}
    for s, m in given:
        rest[s] = rest.get(s, 0.0) + m / mass
    exceeds = lambda u: degrees.get(u, 0.0) > 0 and rest[u] > epsilon * degrees[u]
    settled: dict[int, float] = {}
    unknown: set[int] = set()
    queue = deque(u for u in rest if exceeds(u))
    queued, done = set(queue), 0
    while queue and done < most:
        u = queue.popleft()
        queued.discard(u)
        if u not in near:
            unknown.add(u)
            continue
        done += 1
        held = rest[u]
        settled[u] = settled.get(u, 0.0) + alpha * held
        rest[u] = (1 - alpha) * held / 2
        share = rest[u] / degrees[u]
        for v, w in near[u]:
            rest[v] = rest.get(v, 0.0) + share * w
            if v not in queued and v not in unknown and exceeds(v):
                queue.append(v)
                queued.add(v)
        if u not in queued and exceeds(u):
            queue.append(u)
            queued.add(u)
    return settled, unknown


def ppr_push(edges: DataFrame, seeds: list[int] | dict[int, float], alpha: float = 0.15, epsilon: float = 1e-4, most: int = 200_000) -> DataFrame:
    """(id, score) by pushes from the seeds, equal or with masses, over all edges, with the result of ``push``.

    A push settles alpha * epsilon for each unit of its node's weighted degree at least, so that the nodes pushed have edges of a weight of 1 /
    (alpha * epsilon)
    together, whatever the size of the graph. Only these nodes' edges are fetched, in rounds: pushes run over what is known, nodes that are due
    but not known are fetched, and
    the pushes start again. Of the seeds, the degrees come first, as many seeds may have too little mass to be pushed. More than ``MOST_LOCAL_EDGES`` (five million) edges are refused: ``pagerank`` with ``restart`` is the distributed walk.
    """
    spark = edges.sparkSession
    edges = stage(edges.select("src", "dst", "weight"), "push-edges")
    degree = stage(edges.groupBy(F.col("src").alias("id")).agg(F.sum("weight").alias("degree")), "push-degrees")
    near: dict[int, list[tuple[int, float]]] = {}
    degrees: dict[int, float] = {}
    given = spark.createDataFrame([(s,) for s in sorted(set(seeds))], "id long")
    degrees |= {r["id"]: r["degree"] for r in degree.join(given, "id").collect()}
    held = 0
    settled, due = push_known(near, degrees, seeds, alpha, epsilon, most)
    while due:
        wanted = spark.createDataFrame([(s,) for s in sorted(due)], "src long")
        found = edges.join(wanted, "src").join(degree, F.col("dst") == F.col("id"), "left").select(
            "src", "dst", "weight", F.coalesce("degree", F.lit(0.0)).alias("degree")
        ).limit(MOST_LOCAL_EDGES - held + 1).collect()
        held += len(found)
        if held > MOST_LOCAL_EDGES:
            raise ValueError(f"more than {MOST_LOCAL_EDGES} edges around the seeds")
        near |= {u: [] for u in due}
        for r in sorted(found, key=lambda r: (r["src"], r["dst"])):
            near[r["src"]].append((r["dst"], r["weight"]))
            degrees[r["dst"]] = r["degree"]
        degrees |= {u: sum(w for _, w in near[u]) for u in due}
        settled, due = push_known(near, degrees, seeds, alpha, epsilon, most)
    return spark.createDataFrame(sorted(settled.items()), "id long, score double")


def related(
    links: DataFrame, entities: DataFrame, seeds: list[int], k: int = 10, kinds: tuple[str, ...] | None = ("concept",), with_seeds: bool = True,
    alpha: float = 0.15, epsilon: float = 1e-4
) -> DataFrame:
    """(id, name, kind, score, seed): the k nodes that a walk from the seeds visits most, of the kinds asked for; cards of sessions and digests
    are left out."""
    edges = adjacency(links, entities)
    found = ppr_push(edges, seeds, alpha, epsilon)
    names = entities.filter(~F.coalesce(F.col("name").rlike(OPERATIONAL), F.lit(False))).select("id", "name", "kind").dropDuplicates(["id"])
    if kinds:
        names = names.filter(F.col("kind").isin(list(kinds)))
    rows = found.join(names, "id").withColumn("seed", F.col("id").isin(seeds) if seeds else F.lit(False))
    rows = rows if with_seeds else rows.filter(~F.col("seed"))
    return rows.select("id", "name", "kind", "score", "seed").orderBy(F.desc("score"), "id").limit(k)


def clique(edges: DataFrame, seeds: DataFrame, weight: float = 2.0) -> DataFrame:
    """Edges plus ``weight`` between any two of the seeds (a prompt's few concepts) that are in the graph."""
    known = edges.select(F.col("src").alias("id")).distinct().join(seeds.select("id").distinct(), "id")
    a, b = known.select(F.col("id").alias("src"), F.lit(1).alias("one")), known.select(F.col("id").alias("dst"), F.lit(1).alias("one"))
    extra = a.join(b, "one").filter("src != dst").select("src", "dst", F.lit(weight).alias("weight"))
    return edges.unionByName(extra).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def seed_coverage(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(id, coverage): the share of a seed's neighbours that some other seed has too."""
    near = edges.join(seeds.select(F.col("id").alias("src")).distinct(), "src", "left_semi").select("src", "dst").distinct()
    shared = near.groupBy("dst").agg(F.count(F.lit(1)).alias("holders"))
    return near.join(shared, "dst").groupBy(F.col("src").alias("id")).agg(F.avg(F.when(F.col("holders") > 1, 1.0).otherwise(0.0)).alias("coverage"))


def degree_walk(edges: DataFrame, seeds: DataFrame, hops: int = 2, decay: float = 0.35, reach_alpha: float = 2.0, frontier: int = 4000) -> DataFrame:
    """(id, score, reach): weight spreads over edges and fades by hop; a node scores more the more seeds reach it.

    ``seeds`` is (id, weight). From each hop the ``frontier`` heaviest nodes go on. score = weight * (reach / seeds)^alpha.
    """
    edges = stage(edges, "walk-edges")
    starts = seeds.join(edges.select(F.col("src").alias("id")).distinct(), "id", "left_semi")
    n = max(starts.count(), 1)
    total = edges.groupBy(F.col("src").alias("s")).agg(F.sum("weight").alias("out"))
    moves = stage(edges.join(total, F.col("src") == F.col("s")).select("src", "dst", (F.col("weight") / F.col("out")).alias("share")), "walk-moves")
    wave = starts.select("id", F.col("weight").alias("w"), F.array(F.col("id")).alias("from"))
    seen = wave
    for hop in range(hops):
        go = wave.orderBy(F.desc(F.round("w", 12)), "id").limit(frontier)
        wave = moves.join(go, F.col("src") == F.col("id")).groupBy(F.col("dst").alias("id")).agg(
            (F.sum(F.col("w") * F.col("share")) * decay ** (hop + 1)).alias("w"), F.array_distinct(F.flatten(F.collect_set("from"))).alias("from")
        )
        wave = stage(wave, f"wave-{hop}")
        seen = seen.unionByName(wave)
    out = seen.groupBy("id").agg(F.sum("w").alias("w"), F.size(F.array_distinct(F.flatten(F.collect_set("from")))).alias("reach"))
    return out.select("id", (F.col("w") * F.pow(F.col("reach") / F.lit(n), F.lit(reach_alpha))).alias("score"), "reach")


def corroborated(edges: DataFrame, core: DataFrame, least: int = 2) -> DataFrame:
    """(id, support): nodes outside the core that at least ``least`` of its members reach."""
    own = core.select(F.col("id").alias("src")).distinct()
    support = edges.join(own, "src", "left_semi").groupBy(F.col("dst").alias("id")).agg(
        F.countDistinct("src").alias("support")
    ).filter(F.col("support") >= least)
    return support.join(core.select("id").distinct(), "id", "left_anti")


def lift(links: DataFrame, seeds: DataFrame, least: int = 2, most_df: float = 0.25, anchors: int = 4000) -> DataFrame:
    """(concept_id, lift, co): concepts that come more often with the seeds than on their own.

    Anchors are the entities that mention two or more seeds (any seed, if none does), the ``anchors`` best covered ones; lift = (co / anchors) /
    (df / documents), and
    concepts with co below ``least``, in more than ``most_df`` of the documents or with a lift of 1 or less are left out.
    """
    men = links.filter("linkage = 'mentions'").select("concept_id", "entity_id").distinct()
    own = seeds.select("concept_id").distinct()
    covered = stage(men.join(own, "concept_id", "left_semi").groupBy("entity_id").agg(F.count(F.lit(1)).alias("n")), "covered")
    strong = covered.filter("n >= 2")
    base = strong if strong.limit(1).count() else covered
    anchor = base.orderBy(F.desc("n"), "entity_id").limit(anchors).select("entity_id", F.lit(1).alias("near"))
    # One pass over the mentions gives both counts of every concept.
    counts = men.join(anchor, "entity_id", "left").groupBy("concept_id").agg(F.count(F.lit(1)).alias("df"), F.count("near").alias("co"))
    size = anchor.agg(F.count(F.lit(1)).alias("a")).withColumn("one", F.lit(1)).join(
        men.agg(F.countDistinct("entity_id").alias("docs")).withColumn("one", F.lit(1)), "one"
    )
    rows = counts.join(own, "concept_id", "left_anti").filter(F.col("co") >= least).withColumn("one", F.lit(1)).join(F.broadcast(size), "one")
    rows = rows.filter(F.col("df") <= most_df * F.col("docs")).withColumn("lift", (F.col("co") / F.col("a")) / (F.col("df") / F.col("docs")))
    return rows.filter("lift > 1").select("concept_id", "lift", "co")


def spread_labels(frame: pd.DataFrame, rounds: int = 30) -> dict[int, int]:
    """Asynchronous label propagation over (src, dst, weight, score): nodes by falling score; of equally heavy labels the smaller."""
    near: dict[int, list[tuple[int, float]]] = {}
    for s, d, w in zip(frame["src"], frame["dst"], frame["weight"]):
        near.setdefault(int(s), []).append((int(d), float(w)))
    score = dict(zip(frame["src"].astype(int), frame["score"]))
    label = {u: u for u in near}
    order = sorted(near, key=lambda u: (-score[u], u))
    for _ in range(rounds):
        changed = False
        for u in order:
            votes: dict[int, float] = {}
            for v, w in near[u]:
                if v in label:
                    votes[label[v]] = votes.get(label[v], 0.0) + w
            if votes and (best := min(votes, key=lambda x: (-votes[x], x))) != label[u]:
                label[u], changed = best, True
        if not changed:
            break
    return label


def spread_labels_staged(edges: DataFrame, rounds: int = 30) -> DataFrame:
    """(id, label): label propagation in staged rounds, distributed. Half of the nodes, by a hash of id and round, take their heaviest label (of
    equally heavy ones the
    smaller) at once, which keeps two sides from swapping labels for ever. It ends when no node at all would change, or after ``rounds`` rounds.
    """
    edges = stage(edges, "label-edges")
    labels = stage(edges.select(F.col("src").alias("id")).distinct().withColumn("label", F.col("id")), "labels")
    for turn in range(rounds):
        votes = edges.join(labels.select(F.col("id").alias("dst"), "label"), "dst").groupBy("src", "label").agg(F.sum("weight").alias("w"))
        best = votes.groupBy(F.col("src").alias("id")).agg(F.max_by("label", F.struct("w", -F.col("label"))).alias("best"))
        wanted = stage(labels.join(best, "id", "left").select("id", "label", F.coalesce("best", "label").alias("best")), "labels")
        if not wanted.filter("best != label").limit(1).count():
            break
        labels = wanted.select(
            "id", F.when(F.pmod(F.xxhash64("id", F.lit(turn)), F.lit(2)) == 0, F.col("best")).otherwise(F.col("label")).alias("label")
        )
    return labels


def communities(edges: DataFrame, scores: DataFrame | None = None, least: int = 2) -> DataFrame:
    """(id, label): communities of ``least`` members or more, each connected component in one task (the sweep is sequential by definition).

    Components above MOST_LOCAL_EDGES edges go through ``spread_labels_staged``, whose communities may differ from the sweep's.
    """
    nodes = edges.groupBy(F.col("src").alias("id")).agg(F.sum("weight").alias("degree"))
    score = nodes.join(scores, "id", "left").select(
        "id", F.coalesce("score", "degree").alias("score")
    ) if scores is not None else nodes.select("id", F.col("degree").alias("score"))
    roots = connected(edges)
    rows = edges.join(score.withColumnRenamed("id", "src"), "src").join(roots.select(F.col("id").alias("src"), "root"), "src")
    rows = stage(rows.select("src", "dst", "weight", "score", "root"), "component-edges")
    # Few components are that large: each has more edges than a task takes.
    large = rows.groupBy("root").count().filter(F.col("count") > MOST_LOCAL_EDGES).select("root")
    big = rows.join(F.broadcast(large), "root", "left_semi")
    rows = rows.join(F.broadcast(large), "root", "left_anti")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        label = spread_labels(frame.sort_values(["src", "dst"]))
        return pd.DataFrame({"id": list(label), "label": list(label.values())}).astype("int64")

    found = rows.groupBy("root").applyInPandas(run, "id long, label long")
    if large.limit(1).count():
        found = found.unionByName(spread_labels_staged(big.select("src", "dst", "weight")))
    return found.withColumn("n", F.count(F.lit(1)).over(W.partitionBy("label"))).filter(F.col("n") >= least).drop("n")


def connected(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(id, root): the smallest id that a node is connected with; labels travel along edges and along roots, staged each round."""
    edges = stage(edges.select("src", "dst").union(edges.select("dst", "src")).distinct(), "edges")
    labels = stage(edges.groupBy(F.col("src").alias("id")).agg(F.least(F.min("dst"), F.col("src")).alias("root")), "labels")
    for _ in range(rounds):
        near = edges.join(labels.select(F.col("id").alias("dst"), "root"), "dst").groupBy(F.col("src").alias("id")).agg(F.min("root").alias("near"))
        jump = labels.select(F.col("id").alias("root"), F.col("root").alias("far"))
        new = labels.join(near, "id", "left").join(jump, "root", "left").select(
            "id", F.least("root", "near", "far").alias("root"), F.col("root").alias("old")
        )
        new = stage(new, "labels")
        changed = new.filter("root != old").limit(1).count()
        labels = new.select("id", "root")
        if not changed:
            return labels
    raise RuntimeError(f"labels still change after {rounds} rounds")


def footprint(links: DataFrame, concepts: DataFrame, hops: int = 0, most: int = 200) -> DataFrame:
    """(entity_id, hop): entities linked to a concept, and through shared concepts up to ``hops`` further; the first ``most``."""
    near = links.join(concepts.select("concept_id").distinct(), "concept_id", "left_semi").select("entity_id").distinct().withColumn("hop", F.lit(0))
    for hop in range(1, hops + 1):
        through = links.join(near.select("entity_id"), "entity_id", "left_semi").select("concept_id").distinct()
        more = links.join(through, "concept_id", "left_semi").select("entity_id").distinct().withColumn("hop", F.lit(hop))
        near = stage(near.unionByName(more).groupBy("entity_id").agg(F.min("hop").alias("hop")), "footprint")
    return near.orderBy("hop", "entity_id").limit(most)
