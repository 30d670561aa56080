import math

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F
from threadloom import verbs
from threadloom.graph import Graph
from threadloom.model import ENTITY, LINK, MEMORY
from threadloom.operators import analytics, mutate, rank, vectors, walks
from threadloom.streaming import focus
from threadloom.streaming.sync import apply_sync, drain, due, learned, plan_sync

E = [
    (1, 1, "concept", None, "parser", None, None, 1.0, 1.0, 0, 0, "parser", None),
    (2, 1, "concept", None, "loose", None, None, 1.0, 1.0, 0, 0, "loose", None),
    (3, 1, "concept", None, "kept", None, None, 1.0, 1.0, 1, 0, "kept", None),
    (10, 1, "doc", "a.md", "a.md", "old", None, 1.0, 1.0, 0, 0, None, 0.5), (11, 2, "doc", "b.md", "a.md", None, None, 1.0, 1.0, 0, 0, None, None),
    (12, 2, "memory", None, "note", None, None, 1.0, 2.0, 0, 0, None, 5.0),
]
L = [("mentions", 1, 10, 2.0), ("mentions", 1, 11, None), ("same_as", 1, 12, None)]
M = [(12, "body", "note", '["x"]', None, 1.0, 1.0), (10, "s", "note", None, None, 1.0, 1.0), (11, "longer", "note", None, None, 9.0, 9.0)]


@pytest.fixture(scope="module")
def store(spark):
    g = Graph(spark.createDataFrame(E, ENTITY), spark.createDataFrame(L, LINK))
    return verbs.Store(g, spark.createDataFrame(M, MEMORY))


def test_upsert_rules(spark, store):
    batch = spark.createDataFrame(
        [
            (1, "doc", "a.md", None, "new", None, 0, None, 5.0, 1), (1, "doc", "a.md", "p", None, None, 1, "c1", 6.0, 2),
            (1, "doc", "a.md", None, None, None, 0, "c2", 7.0, 3), (1, "concept", "parser", None, None, None, 0, None, 9.0, 4),
            (1, "doc", "z.md", "z", None, None, 0, None, 8.0, 5)
        ],
        "partition_id int, kind string, name string, path string, tldr string, meta string, protected int, canonical_name string, now double, seq int",
    )
    got = {r.id: r for r in mutate.upsert_entities(store.graph.entities, batch).collect()}
    assert (
        got[10].path, got[10].tldr, got[10].protected, got[10].canonical_name, got[10].updated_at, got[10].created_at
    ) == ("p", "new", 1, "c1", 7.0, 1.0)
    assert got[1].updated_at == 1.0  # nothing changed
    assert got[13].name == "z.md" and got[13].created_at == 8.0 and len(got) == 7


def test_link_policies_and_unlink(spark, store):
    batch = spark.createDataFrame(
        [
            ("mentions", 1, 10, 9.0, 1), ("mentions", 1, 11, 4.0, 2), ("mentions", 1, 11, None, 3), ("related_to", 1, 12, 1.0, 4),
            ("related_to", 1, 12, 2.0, 5)
        ],
        "linkage string, concept_id long, entity_id long, weight double, seq int"
    )
    get = lambda policy: {(r.linkage, r.entity_id): r.weight for r in mutate.merge_links(store.graph.links, batch, policy).collect()}
    assert get("first") == {("mentions", 10): 2.0, ("mentions", 11): None, ("same_as", 12): None, ("related-to", 12): 1.0}
    assert get("update") == {("mentions", 10): 9.0, ("mentions", 11): 4.0, ("same_as", 12): None, ("related-to", 12): 2.0}
    assert get("ignore") == {("mentions", 10): 2.0, ("mentions", 11): None, ("same_as", 12): None, ("related-to", 12): None}
    gone = spark.createDataFrame([("mentions", 1, 10)], "linkage string, concept_id long, entity_id long")
    once = mutate.unlink(store.graph.links, gone)
    assert once.count() == 2 and mutate.unlink(once, gone).count() == 2


def test_vacuum_purge_and_merge(spark, store):
    assert {r.id for r in mutate.vacuum(store.graph).entities.collect()} == {1, 3, 10, 11, 12}
    g, bodies = mutate.purge(store.graph, spark.createDataFrame([(3,), (10,)], "id long"), store.memories)
    assert {r.id for r in g.entities.collect()} == {1, 2, 3, 11, 12} and g.links.count() == 2 and {r.entity_id for r in bodies.collect()} == {11, 12}
    merged, bodies = mutate.merge_partitions(store.graph, store.memories, 2, 1)
    assert rows(merged.entities.select("id", "partition_id")) == [(1, 1), (10, 1), (12, 1), (2, 1), (3, 1)]
    assert {(r.linkage, r.entity_id): r.weight for r in merged.links.collect()} == {("mentions", 10): 2.0, ("same_as", 12): None}
    assert {r.entity_id: (r.content, r.created_at) for r in bodies.collect()} == {10: ("longer", 1.0), 12: ("body", 1.0)}


def test_replay_ties_and_idempotence(spark):
    log = spark.createDataFrame(
        [
            (1.0, 1, "entity", "doc", "a", "p1", "v1"), (2.0, 2, "entity", "doc", "a", None, "v2"), (2.0, 3, "entity", "doc", "a", None, "v3"),
            (2.0, 4, "tombstone", "doc", "b", None, None), (2.0, 5, "entity", "doc", "b", "x", None), (1.0, 6, "tombstone", "doc", "a", None, None)
        ],
        "ts double, line_no long, op string, kind string, name string, path string, value string",
    )
    want = [("doc", "a", "p1", "v3", 2.0)]
    assert rows(mutate.replay_entities(log)) == want == rows(mutate.replay_entities(log.union(log)))
    links = spark.createDataFrame(
        [
            (1.0, 1, "link", "m", "c", "e", 1.0), (2.0, 2, "unlink", "m", "c", "e", None), (2.0, 3, "link", "m", "c", "e", 3.0),
            (5.0, 4, "link", "m", "d", "e", 2.0)
        ],
        "ts double, line_no long, op string, linkage string, c string, e string, weight double"
    )
    assert rows(mutate.replay_links(links)) == [("m", "d", "e", 2.0)]


def test_fusion_is_exact_and_independent_of_order(spark):
    df = spark.createDataFrame([("x", 1, 0), ("x", 2, 1), ("y", 2, 0), ("y", 1, 1)], "list string, entity_id long, rank int")
    got = rank.fuse(df).collect()
    assert {r.entity_id for r in got} == {1, 2} and all(math.isclose(r.score, 1 / 60 + 1 / 61) for r in got)


def test_content_rank_rules(spark):
    links = spark.createDataFrame(
        [
            ("mentions", "a", 1, 2.0), ("mentions", "b", 1, 1.0), ("mentions", "a", 2, 2.0), ("mentions", "z", 3, 5.0), ("mentions", "a", 4, None),
            ("defines", "a", 9, None)
        ],
        "linkage string, concept_id string, entity_id long, weight double"
    )
    terms = spark.createDataFrame([(0, "a"), (1, "b"), (1, "a")], "term int, concept_id string")
    got = {r.entity_id: r.score for r in rank.content_rank(links, terms, 2, boosts={}).collect()}
    assert set(got) == {1, 2, 4, 9} and got[9] == 1e-3 and got[4] == 0.0 and got[1] > got[2] * 8
    none = spark.createDataFrame([], "term int, concept_id string")
    assert rank.content_rank(links, none, 1, boosts={}).count() == 0


def test_pagerank_sums_to_the_number_of_nodes(spark):
    links = spark.createDataFrame([("mentions", c, e, None) for c, e in ((1, 10), (1, 11), (2, 10), (2, 12), (3, 13))], LINK)
    ranks = walks.pagerank(walks.adjacency(links), 60)
    assert math.isclose(ranks.agg(F.sum("score")).first()[0], 7, abs_tol=1e-6)
    assert walks.pagerank(walks.adjacency(links.limit(0))).count() == 0
    found = {r.id: r.root for r in walks.connected(walks.adjacency(links)).collect()}
    assert found == {1: 1, 2: 1, 10: 1, 11: 1, 12: 1, 3: 3, 13: 3}


def test_pushes_stay_within_their_bound(spark):
    """Against the walk solved as linear equations: every score is at most epsilon times the node's weighted degree too low, never too high."""
    rng = np.random.default_rng(4)
    n, alpha, epsilon = 40, 0.15, 1e-4
    w = np.triu(rng.integers(0, 4, (n, n)) * (rng.random((n, n)) < 0.15), 1).astype(float)
    w = w + w.T
    src, dst = np.nonzero(w)
    seeds = [0, 3, 999]
    got = walks.push(src, dst, w[src, dst], seeds, alpha, epsilon)
    degree = w.sum(axis=1)
    step = 0.5 * (np.eye(n) + np.divide(w, degree[:, None], out=np.zeros_like(w), where=degree[:, None] > 0))
    start = np.zeros(n)
    start[[0, 3]] = 1 / 3  # the third seed isn't in the graph and keeps its mass
    exact = alpha * start @ np.linalg.inv(np.eye(n) - (1 - alpha) * step)
    for i in range(n):
        if degree[i]:
            assert -1e-12 <= exact[i] - got.get(i, 0.0) <= epsilon * degree[i]
    edges = spark.createDataFrame([(int(a), int(b), float(w[a, b])) for a, b in zip(src, dst)], "src long, dst long, weight double")
    assert {r.id: r.score for r in walks.ppr_push(edges, seeds, alpha, epsilon).collect()} == pytest.approx(got)


def test_related_leaves_cards_and_other_kinds_out(spark):
    links = spark.createDataFrame([("mentions", c, e, None) for c, e in ((1, 10), (2, 10), (3, 11), (2, 11), (4, 10))], LINK)
    nodes = spark.createDataFrame(
        [(1, "one", "concept"), (2, "two", "concept"), (3, "three", "concept"), (4, "Session-9", "concept"), (10, "d", "doc"), (11, "e", "doc")],
        "id long, name string, kind string"
    )
    assert {r.name for r in walks.related(links, nodes, [1]).collect()} == {"one", "two", "three"}
    assert [r.name for r in walks.related(links, nodes, [1], 1, ("doc",), with_seeds=False).collect()] == ["d"]
    assert walks.related(links, nodes, []).count() == 0


def test_components_of_all_links_against_union_find(spark, small):
    from threadloom.plans import graphs

    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    for r in graphs.adjacency(spark, small).select("src", "dst").collect():
        a, b = sorted((find(r.src), find(r.dst)))
        root[b] = a
    assert {r.id: r.root for r in graphs.connected_components(spark, small).collect()} == {x: find(x) for x in list(root)}


def test_labels_and_support(spark):
    two = [("related-to", a, b, 5.0) for a, b in ((1, 2), (2, 3), (1, 3), (11, 12), (12, 13), (11, 13))] + [("mentions", 3, 11, None)]
    label = {r.id: r.label for r in walks.communities(walks.adjacency(spark.createDataFrame(two, LINK))).collect()}
    assert len({label[i] for i in (1, 2, 3)}) == 1 and len({label[i] for i in (11, 12, 13)}) == 1 and label[1] != label[11]
    links = spark.createDataFrame([("mentions", 1, 50, None), ("mentions", 2, 50, None), ("mentions", 1, 51, None)], LINK)
    assert rows(walks.corroborated(walks.adjacency(links), spark.createDataFrame([(1,), (2,)], "id long"))) == [(50, 2)]


def test_reinforcement_sign_decay_and_cap(spark):
    e = spark.createDataFrame([(1, 0.0), (2, -86400.0 * 30), (3, None)], "id long, created_at double")
    links = spark.createDataFrame(
        [
            ("reinforces", 7, 1, None), ("contradicts", 8, 1, -0.5), ("reinforces", 9, 2, 2.0), ("reinforces", 10, 1, 100.0),
            ("reinforces", 11, 3, 1.0)
        ],
        LINK
    )
    assert {r.concept_id: round(r.signal, 9) for r in analytics.reinforcement(links, e, 0.0).collect()} == {7: 1.0, 8: -0.5, 9: 1.0, 10: 5.0, 11: 1.0}
    assert {r.concept_id: r.signal for r in analytics.reinforcement(links, e, 0.0, halflife_days=0).collect()}[9] == 2.0


def test_budget_stops_at_the_first_overflow(spark):
    df = spark.createDataFrame([(1, 5), (2, 6), (3, 1)], "place_in int, cost int")
    assert [r.place_in for r in analytics.budget_prefix(df, [], [F.col("place_in")], F.col("cost"), 10, 9).collect()] == [1]


def test_windows_are_anchored_at_their_first_row(spark):
    df = spark.createDataFrame([("a", float(t)) for t in (0, 4, 5, 6, 10, 20)] + [("b", 1.0)], "k string, t double")
    got = {(r.k, r.t): r.window_start for r in analytics.anchored_windows(df, "k", "t", 5.0).collect()}
    assert got == {("a", 0.0): 0.0, ("a", 4.0): 0.0, ("a", 5.0): 0.0, ("a", 6.0): 6.0, ("a", 10.0): 6.0, ("a", 20.0): 20.0, ("b", 1.0): 1.0}


def test_reading_a_channel_loses_and_repeats_nothing(spark):
    m = spark.createDataFrame([(i, "ab"[i % 2], "active" if i % 5 else "deleted") for i in range(1, 21)], "seq long, channel string, status string")
    cursors, seen = spark.createDataFrame([], "agent string, channel string, last_seq long"), []
    for _ in range(8):
        got, moved = analytics.read_channel(m, cursors, "me", "*", 3)
        seen += [r.seq for r in got.collect()]
        cursors = spark.createDataFrame(
            [tuple(r) for r in cursors.join(moved, ["agent", "channel"], "left_anti").unionByName(moved).collect()],
            "agent string, channel string, last_seq long"
        )
    assert seen == [i for i in range(1, 21) if i % 5]


def test_focus_decays_counts_and_keeps_a_budget():
    f = focus.Focus(budget=3)
    f.event("input", ["a", "b"])
    f.event("tool", ["a"])
    f.event("input", ["c"])
    assert f.nodes["a"][1] == 2 and math.isclose(f.nodes["b"][0], focus.FADE) and f.edges == {("a", "b"): 1.0}
    f.event("tool", ["d"])
    assert set(f.nodes) == {"a", "b", "d"}  # c had the lowest score and no neighbour
    f.event("input", ["e", "d"])
    f.event("input", ["e", "d"])
    assert f.nodes["b"][3] or f.nodes["a"][3]  # a neighbour of a live node stays as a stub
    again = focus.Focus(f.dump(), 3)
    assert again.nodes == f.nodes and again.edges == f.edges


def test_vectors(spark):
    v = spark.createDataFrame(
        [(i, [float(i == j) for j in range(4)]) for i in range(4)] + [(9, [0.9, 0.1, 0.0, 0.0])], "id long, vector array<double>"
    )
    assert vectors.nearest(v, [1.0, 0.0, 0.0, 0.0], 2).first().id == 0
    assert vectors.nearest(v, [1.0, 0.0, 0.0, 0.0], 2, ids=v.limit(0)).count() == 0
    with pytest.raises(ValueError):
        vectors.nearest(v, [1.0], 2)
    assert rows(vectors.mutual_knn(v, 1, 0.5).select("a", "b")) == [(0, 9)]


def test_verbs(store):
    assert {r.entity_id for r in verbs.call(store, "query", expression="parser").collect()} == {10, 11, 12}
    assert verbs.call(verbs.call(store, "save_query", name="q", expression="parser"), "run_saved", name="q").count() == 3
    assert verbs.call(store, "curate", action="noise", like="lo*").count() == 1
    changed = verbs.call(store, "curate", action="noise", like="lo*", dry_run=False)
    assert changed.graph.entities.filter("noise = 1").count() == 1
    assert verbs.call(store, "graph", action="stats").count() > 3 and verbs.call(store, "memory", action="facets").count() == 2
    assert verbs.call(store, "memory", action="forget", ids=[12]).memories.count() == 2
    assert verbs.call(store, "recall", terms="the parser").count() == 2
    with pytest.raises(ValueError):
        verbs.call(store, "graph", action="nope")
    with pytest.raises(ValueError):
        verbs.call(store, "nope")
    assert {s["name"] for s in verbs.schema()} == set(verbs.VERBS)


def test_sync_and_queues(spark):
    now = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "path string, mtime double")
    tracked = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 1.0)], "path string, mtime double")
    plan = plan_sync(now, tracked)
    assert rows(plan) == [("b", "extract"), ("c", "purge")]
    table = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "path string, v int")
    assert rows(apply_sync({"t": table}, plan, {"t": spark.createDataFrame([("b", 9)], "path string, v int")})["t"]) == [("a", 1), ("b", 9)]
    queue = spark.createDataFrame([("x", 1), ("y", 2), ("x", 3)], "path string, seq int")
    assert [r.path for r in drain(queue).collect()] == ["x", "y"]
    assert rows(
        learned(spark.createDataFrame([(" Foo ", "a", 1), ("foo", "a", 1), ("", "b", 2)], "pattern string, path string, line int"))
    ) == [("query/foo", "a", 1)]
    assert rows(
        due(
            spark.createDataFrame([("a", 10.0, None), ("b", 10.0, 95.0), ("c", 10.0, 90.0)], "name string, every_s double, last_run double"), 100.0
        ).select("name")
    ) == [("a",), ("c",)]


def test_the_rest_works_without_the_training_data_package():
    import subprocess
    import sys

    code = "import sys; sys.modules['threadloom.llm'] = None\nimport threadloom.verbs, threadloom.plans.registry as r; assert r.queries()"
    assert subprocess.run([sys.executable, "-c", code], capture_output=True).returncode == 0


def test_concept_sets_come_from_the_mentions(spark, small):
    from threadloom.graph import store_graph
    from threadloom.plans import registry
    from threadloom.plans.store_changes import _doc_concepts

    g = store_graph(spark, small)
    named = g.concepts().filter("name IS NOT NULL").select("concept_id")
    want = g.links.filter("linkage = 'mentions'").join(named, "concept_id", "left_semi").select("entity_id").distinct().count()
    assert _doc_concepts(spark, small).filter("concept IS NOT NULL").select("entity_id").distinct().count() == want > 0


def chain(n):
    """Two triangles and a chain behind them, both ways."""
    pairs = [(1, 2), (2, 3), (1, 3), (3, 4), (4, 5), (5, 6), (4, 6), *[(i, i + 1) for i in range(6, n)]]
    return sorted([(a, b, 1.0 + a % 3) for a, b in pairs] + [(b, a, 1.0 + a % 3) for a, b in pairs])


def test_push_goes_on_beyond_three_hops_with_true_degrees(spark):
    edges = chain(14)
    src, dst, weight = (np.array(x) for x in zip(*edges))
    want = walks.push(src, dst, weight, [1, 2], epsilon=1e-6)
    found = {r.id: r.score for r in walks.ppr_push(spark.createDataFrame(edges, "src long, dst long, weight double"), [1, 2], epsilon=1e-6).collect()}
    assert found == pytest.approx(want) and 14 in found


def test_push_starts_from_every_resolved_seed_over_all_links(spark):
    from conftest import MEDIUM
    from threadloom.plans import graphs

    links, seeds = graphs._typed(spark, MEDIUM)
    ids = sorted(r[0] for r in seeds.collect())
    edges = walks.adjacency(links).toPandas().sort_values(["src", "dst"])
    want = walks.push(edges["src"].to_numpy(), edges["dst"].to_numpy(), edges["weight"].to_numpy(), ids)
    assert len(ids) > 3 and {r.id: r.score for r in graphs.ppr_push(spark, MEDIUM).collect()} == pytest.approx(want)


def test_components_too_large_for_one_task_get_labels_too(spark, monkeypatch):
    edges = spark.createDataFrame(chain(6), "src long, dst long, weight double")
    monkeypatch.setattr(walks, "MOST_LOCAL_EDGES", 10)
    label = {r.id: r.label for r in walks.communities(edges).collect()}
    assert set(label) == set(range(1, 7)) and len({label[i] for i in (1, 2, 3)}) == 1


def test_labels_spread_over_all_links(spark, small):
    from threadloom.plans import graphs

    links = graphs._typed(spark, small)[0]
    mentioned = links.filter("linkage = 'mentions' AND concept_id != entity_id").select("concept_id").distinct().withColumnRenamed("concept_id", "id")
    assert graphs.label_propagation(spark, small).join(mentioned, "id", "left_semi").count() >= 0.9 * mentioned.count() > 0


def test_cells_find_neighbours_of_clustered_vectors(spark):
    from threadloom.operators import vectors

    rng = np.random.default_rng(7)
    centre = rng.normal(size=(25, 16))
    x = centre[rng.integers(0, 25, 1500)] + 0.15 * rng.normal(size=(1500, 16))
    x[0] = 0
    v = spark.createDataFrame([(i, [float(y) for y in row]) for i, row in enumerate(x)], "id long, vector array<double>")
    asked = v.filter("id % 20 = 0 AND id > 0")
    cells = vectors.fit_cells(v)
    recall = vectors.recall_of(vectors.knn_cells(asked, v, 5, cells=cells, size=64), vectors.knn_join(asked, v, 5, size=400)).first()
    assert recall.recall >= 0.9 and recall.n == 5 * asked.count() and cells.probes < len(cells.centres) / 2
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    sim = unit @ unit.T
    np.fill_diagonal(sim, -3)
    exact = {(int(r.id), int(r.other)) for r in vectors.knn_join(asked, v, 3, size=300).collect()}
    assert exact == {(i, int(j)) for i in range(20, 1500, 20) for j in np.argsort(-sim[i], kind="stable")[:3]}
    assert vectors.knn_cells(asked.limit(0), v, 3).count() == 0 and vectors.knn_cells(asked, v.limit(0), 3).count() == 0


def test_concepts_bridge_all_similar_pairs_and_windows_are_anchored(spark):
    import random

    from threadloom.operators import analytics, vectors

    rng = random.Random(8)
    sets = spark.createDataFrame(
        [(i, f"c{c}") for i in range(60) for c in rng.sample(range(12), rng.randrange(1, 6))] + [(i, "all") for i in range(60)],
        "entity_id long, concept string"
    )
    sets = vectors.informative_concepts(sets, most_share=1.0)
    weight = {}
    for r in sets.collect():
        weight.setdefault(r.entity_id, {})[r.concept] = r.idf
    norm = {i: math.sqrt(sum(w * w for w in c.values())) for i, c in weight.items()}
    for least in (0.2, 0.6, 0.95):
        want = {
            (a, b): dot / norm[a] / norm[b] for a in weight for b in weight if a < b and norm[a] and norm[b]
            for dot in [sum(w * weight[b].get(c, 0.0) for c, w in weight[a].items())] if dot > least * norm[a] * norm[b] * (1 + 1e-9)
        }
        got = {(r.a, r.b): r.cosine for r in vectors.concept_cosine(sets, least).collect() if r.cosine > least * (1 + 1e-9)}
        assert got == pytest.approx(want)
    with pytest.raises(ValueError):
        vectors.concept_cosine(sets, 0.0)
    times = [("a", rng.choice([0, 50, 51, 52, 200]) + rng.randrange(40) / 4) for _ in range(120)] + [("b", 3.0), (None, 1.0)]
    rows_ = spark.createDataFrame(times, "k string, t double")
    want = []
    for k in ("a", "b", None):
        start = None
        for t in sorted(t for x, t in times if x == k):
            start = t if start is None or t > start + 5 else start
            want.append((k, t, start))
    assert rows(analytics.anchored_windows(rows_, "k", "t")) == sorted(want, key=repr)
    assert analytics.anchored_windows(rows_.limit(0), "k", "t").count() == 0


def test_last_touches_hold_no_more_than_asked_for(spark):
    from threadloom.streaming import runner, state

    events = [(f"t{i % 3}", float(i * 7 % 31), f"r{i % 4}", i, i) for i in range(30)]
    df = spark.createDataFrame(events, "token string, ts double, ring string, line int, seq int")
    stream = runner.replayed(spark, df, files_per_batch=1, order="seq").drop("seq")
    got = {
        r.token: [(t.ts, t.ring, t.line) for t in r.touches]
        for r in runner.latest_of_updates(state.last_touches(stream, "token", 4), ["token"], "touches").collect()
    }
    assert got == {k: sorted((ts, ring, line) for t, ts, ring, line, _ in events if t == k)[-4:] for k in ("t0", "t1", "t2")}


def test_more_verbs(store, spark, tmp_path):
    batch = spark.createDataFrame(
        [(1, "fresh", "new body", "note", '["t"]', None, 9.0, 1)],
        "partition_id int, name string, content string, mtype string, tags string, metadata string, now double, seq long"
    )
    more = verbs.call(store, "memory", action="add", batch=batch)
    made = more.memories.filter("content = 'new body'").first().entity_id
    linked = verbs.call(more, "memory", action="link", ids=[made], concept="parser", linkage="reinforces", weight=2.0)
    assert linked.graph.links.filter(f"entity_id = {made} AND linkage = 'reinforces'").count() == 1
    assert verbs.call(linked, "memory", action="score", concept="parser", now=9.0).count() >= 1
    moved = verbs.call(more, "memory", action="promote", ids=[made], partition=7, now=10.0)
    copy = moved.graph.entities.filter("partition_id = 7 AND name = 'fresh'").first().id
    assert moved.memories.filter(
        f"entity_id = {copy}"
    ).first().tags == '["t","behavior"]' and moved.memories.filter(f"entity_id = {made}").first().tags == '["t"]'
    assert {r.id for r in verbs.call(more, "memory", action="bulk_forget", glob="fre*").collect()} == {made}
    assert verbs.call(more, "memory", action="bulk_forget", glob="fre*", dry_run=False).memories.filter(f"entity_id = {made}").count() == 0
    assert verbs.call(store, "graph", action="visited", name="parser").count() >= 1 and verbs.call(
        store, "graph", action="timeline", name="parser"
    ).columns == ["ts", "what", "path", "hop"]
    assert verbs.call(store, "where", name="parser").count() >= 1
    (tmp_path / "a.py").write_text("def needle():\n    return 1\n")
    full = verbs.call(store, "ingest_folder", root=str(tmp_path))
    assert [
        (r.path, r.line) for r in verbs.call(full, "grep", pattern="needle", root=str(tmp_path)).select("path", "line").distinct().collect()
    ] == [("a.py", 1)]
    assert verbs.call(store, "embed_pending").vectors.count() >= 1
    assert verbs.call(store, "taxonomy", allowed=[]).columns == ["entity_id", "unknown"]
    messages = spark.createDataFrame(
        [(1, "c", "a", "2026-01-01", 1.0, "active")], "seq long, channel string, sender string, ts string, value double, status string"
    )
    from dataclasses import replace

    assert verbs.call(replace(store, messages=messages), "publish", channel="c", sender="b").messages.agg({"seq": "max"}).first()[0] == 2
    snap = verbs.call(store, "maintain", action="snapshot", folder=f"file://{tmp_path}/snap", version=3)
    assert snap["links"].count() == store.graph.links.count()
    assert {x["name"] for x in verbs.schema()} >= {"grep", "session", "projects", "publish", "taxonomy", "where", "embed_pending", "ingest_folder"}


def test_context_with_a_walk(spark):
    from threadloom.operators import context

    nodes = [
        (1, "concept", "valve"), (2, "concept", "pump"), (10, "doc", "d10"), (11, "doc", "d11#a"), (12, "doc", "d11#b"), (13, "doc", "session-13"),
        (14, "doc", "d14")
    ]
    e = spark.createDataFrame([(i, 1, k, None, n, None, None, 1.0, 1.0, 0, 0, n, None) for i, k, n in nodes], ENTITY)
    links = spark.createDataFrame([("mentions", 1, 10, None), ("mentions", 2, 10, None)] + [("mentions", 2, i, None) for i in (11, 12, 13, 14)], LINK)
    g = Graph(e, links)
    plain = [r.entity_id for r in context.build_context(g, "valve").orderBy("place").collect()]
    assert plain == [10]
    walked = [(r.entity_id, r.linkage) for r in context.build_context(g, "valve", degree=3).orderBy("place").collect()]
    # one entry for each document, no cards of sessions, no bare concepts
    assert walked[0] == (10, "mentions") and sorted(walked[1:]) == [(11, "walk"), (14, "walk")]
    ranked = spark.createDataFrame([(14, 3.0), (12, 2.0), (13, 1.0)], "entity_id long, score double")
    tight = [
        (r.entity_id, r.linkage) for r in context.build_context(g, "valve", ranked, degree=3, walk_most=1, most_entities=3).orderBy("place").collect()
    ]
    assert tight[0] == (10, "mentions") and (14, "content") in tight and len(tight) == 3
    assert context.build_context(g, "absent", degree=2).count() == 0
    # links without weights have no lengths to be measured by
    assert rank.content_rank(links, {1: 0}, 1, null_tf=1.0, boosts={}).count() == 1
