import pyarrow as pa
import pytest
from conftest import rows
from pyspark.sql import functions as F
from threadloom.graph import Graph
from threadloom.model import ENTITY, LINK, MEMORY
from threadloom.operators import analytics, embed, evidence, rank, upkeep


def entities(spark, *rows_):
    """(id, partition, kind, name) with the rest empty."""
    full = [(i, p, k, None, n, None, None, 1.0, 1.0, 0, 0, None, 1.0) for i, p, k, n in rows_]
    return spark.createDataFrame(full, ENTITY)


def test_grep_checks_lines_before_the_cap(spark):
    concepts = spark.createDataFrame(
        [(1, "keyword/red_valve", "keyword_red_valve"), (2, "valve", "valve"), (3, "other", None)],
        "concept_id long, name string, canonical_name string"
    )
    ev = [("a", n, "mentions", 2, "e", "code") for n in range(1, 8)] + [
        ("a", 3, "mentions", 2, "f", "code"), ("a", 2, "mentions", 1, "e", "doc"), (None, 1, "mentions", 2, "x", "doc"),
        ("gone", 1, "mentions", 2, "x", "doc")
    ]
    ev = spark.createDataFrame(ev, "path string, line int, linkage string, concept_id long, entity string, kind string")
    lines = spark.createDataFrame(
        [("a", 1, "none"), ("a", 2, "a RedValve"), ("a", 3, "the valve"), ("a", 4, "VALVE"), ("a", 5, "valves"), ("a", 6, None)],
        "path string, line_no int, line string"
    )
    find = lambda p, **o: [(r.line, r.concept) for r in evidence.grep_evidence(ev, concepts, lines, p, **o).collect()]
    assert find("valve") == [(3, "valve"), (5, "valve")]  # case counts, and so does the place
    assert find("valve", limit=1) == [(3, "valve")]
    assert find("valve", word=True) == [(3, "valve")]
    assert find("valve", ignore_case=True) == [(2, "keyword/red_valve"), (2, "valve"), (3, "valve"), (4, "valve"), (5, "valve")]
    assert find("red valve") == [(2, "keyword/red_valve")]  # in the spelling of the line
    assert find("valve", kind="doc", ignore_case=True) == [(2, "keyword/red_valve")] and find("valve", linkage="calls") == []
    assert find("^val.e$", regex=True) == [] and find("val.e", regex=True) == [(3, "valve"), (5, "valve")]
    assert evidence.grep_evidence(ev, concepts, None, "valve", limit=None).count() == 10


def test_deferred_links_merge_once_or_not_at_all(spark):
    links = spark.createDataFrame([("mentions", 1, 2, 0.5)], LINK)
    batch = spark.createDataFrame([("mentions", 1, 2, 9.0, 1), ("mentions", 3, 4, 1.0, 1)], f"{LINK}, seq long")
    with upkeep.DeferredLinks(links) as d:
        d.add(batch)
        d.add(batch.withColumn("weight", F.lit(7.0)))
    assert rows(d.links) == [("mentions", 1, 2, 0.5), ("mentions", 3, 4, 1.0)]
    with pytest.raises(RuntimeError), upkeep.DeferredLinks(links) as d:
        d.add(batch)
        raise RuntimeError
    assert rows(d.links) == rows(links)


def test_memories_added_and_forgotten(spark):
    g = Graph(
        entities(spark, (1, 1, "memory", "a"), (2, 1, "memory", "b"), (3, 1, "concept", "c")), spark.createDataFrame([("mentions", 3, 1, None)], LINK)
    )
    m = spark.createDataFrame([(1, "old", "note", '["x"]', None, 1.0, 1.0), (2, "kept", None, None, None, 1.0, 5.0)], MEMORY)
    batch = [(1, "a", "new", None, None, None, 9.0, 1), (1, "d", "first", "note", None, None, 9.0, 1), (1, "d", "second", None, None, None, 9.0, 2)]
    batch = spark.createDataFrame(
        batch, "partition_id int, name string, content string, mtype string, tags string, metadata string, now double, seq long"
    )
    graph, bodies = upkeep.add_memories(g, m, batch)
    assert rows(bodies.select("entity_id", "content", "mtype", "tags")) == [
        (1, "new", "note", '["x"]'), (2, "kept", None, None), (4, "second", "note", None)
    ]
    assert rows(upkeep.forgettable(g, m, tag="x").select("id")) == [(1,)] and rows(upkeep.forgettable(g, m, name="b*").select("id")) == [(2,)] and rows(
        upkeep.forgettable(g, m, older_than=2.0).select("id")
    ) == [(1,)]
    kept, left = upkeep.bulk_forget(g, m, mtype="no*")
    assert rows(left.select("entity_id")) == [(2,)] and kept.links.count() == 0


def test_partitions_vectors_and_snapshots(spark, tmp_path):
    p = spark.createDataFrame([(1, "one"), (2, "two")], "id int, name string")
    assert rows(upkeep.rename_partition(p, "one", "uno")) == [(1, "uno"), (2, "two")]
    for old, new in (("three", "x"), ("one", "two")):
        with pytest.raises(ValueError):
            upkeep.rename_partition(p, old, new)
    e = entities(spark, (1, 1, "doc", "a"), (2, 1, "doc", "b"))
    v = spark.createDataFrame([(1,), (2,)], "id long")
    left, marked = upkeep.drop_vectors(v, e, v.filter("id = 1"))
    assert rows(left) == [(2,)] and rows(
        marked.select("id", "vectors_updated_at")
    ) == [(1, None), (2, 1.0)] and upkeep.drop_vectors(v, e)[0].count() == 0
    folder = f"file://{tmp_path}/s"
    upkeep.snapshot({"e": e}, folder, 1)
    upkeep.snapshot({"e": e.limit(1)}, folder, 2)
    assert upkeep.latest_snapshot(spark, folder, "e", [1, 2]).count() == 1 and spark.read.parquet(f"{folder}/v1/e.parquet").count() == 2
    assert upkeep.bulk_write(spark, pa.table({"x": [1, 2]}).to_batches(), f"{folder}/b") == 2


def test_texts_and_vectors(spark):
    e = spark.createDataFrame(
        [
            (1, "memory", "m", None, None), (2, "memory", "slug", None, None), (3, "concept", "parseURL", "parse_url", " sum "),
            (4, "code", "f", None, None), (5, "doc", None, None, "t"), (6, "doc", None, None, None), (7, "odd", "x", None, None)
        ],
        "id long, kind string, name string, canonical_name string, tldr string"
    )
    m = spark.createDataFrame([(1, "body", "note", '["t"]')], "entity_id long, content string, mtype string, tags string")
    texts = embed.entity_texts(e, m)
    assert rows(texts) == [
        (1, "memory", '[note] body\n["t"]'), (2, "memory", "slug"), (3, "concept", "parseURL parse_url\nsum"), (4, "code", "f"), (5, "doc", "t")
    ]
    made = {
        r.id: r.vector
        for r in embed.embed(
            spark.createDataFrame(
                [(1, "the red valve"), (2, "a red valve"), (3, "quite unlike it"), (4, ""), (5, "   "), (6, None)], "id long, text string"
            )
        ).collect()
    }
    dot = lambda a, b: sum(x * y for x, y in zip(made[a], made[b]))
    assert set(made) == {1, 2, 3} and dot(1, 1) == pytest.approx(1, abs=1e-5) and dot(1, 2) > dot(1, 3)


def test_scorers_over_several_verbs(spark):
    links = spark.createDataFrame(
        [
            ("mentions", "a", 1, 2.0), ("mentions", "b", 1, 1.0), ("mentions", "a", 2, 1.0), ("lead", "b", 2, 1.0), ("mentions", "z", 3, 4.0),
            ("mentions", "a", 4, None)
        ],
        "linkage string, concept_id string, entity_id long, weight double"
    )
    terms = spark.createDataFrame([(0, "a"), (1, "b"), (1, "B")], "term int, concept_id string")
    plain = {r.entity_id: r.score for r in rank.multi_rank(links, terms, {"mentions": 1.0, "lead": 1.0}).collect()}
    both = {r.entity_id: r.score for r in rank.multi_rank(links, terms, {"mentions": 1.0, "lead": 1.0}, together_alpha=1.0).collect()}
    assert set(plain) == {1, 2} and both[1] == pytest.approx(plain[1]) and both[2] == pytest.approx(plain[2] / 2)
    fused = {r.entity_id: r.score for r in rank.term_rank_fusion(links, terms).collect()}
    assert fused == pytest.approx({1: 2 / 60, 2: 1 / 61})
    assert rank.multi_rank(links.limit(0), terms, {"mentions": 1.0}).count() == 0


def test_rules(spark):
    calls = [("r", "scan", "cli", "query", 0)] * 3 + [("r", "grep", "cli", "grep", 0)] * 5 + [("r", "grep", "cli", "grep", 1)] * 12 + [
        ("s", "grep", "hook", "query", 0)
    ] * 4 + [("t", None, None, None, None)]
    log = spark.createDataFrame(calls, "root string, kind string, invocation string, command string, cardinality int")
    facts = spark.createDataFrame(
        [("r", 5, 10, True, False), ("u", 0, None, None, True)], "root string, entities int, stale_files int, running boolean, supervised boolean"
    )
    got = rows(analytics.adoption(log, ["root"], facts, ("query", "grep", "where")).select("root", "kind"))
    assert got == [("r", "no_hooks"), ("r", "stale"), ("r", "underused_reads"), ("r", "unsupervised"), ("t", "no_hooks"), ("u", "never_ingested")]
    m = spark.createDataFrame(
        [
            ("a", "note", None), ("session-1", "note", None), ("b", "session/x", None), ("c", "impression", None), ("d", None, '["pattern"]'),
            ("e", None, "no json")
        ],
        "name string, mtype string, tags string"
    )
    own = lambda s: {r.name for r in m.filter(analytics.in_corpus(F.col("name"), F.col("mtype"), F.col("tags"), s)).collect()}
    assert own("memory") == {"a", "e"} and own("pattern") == {"c"}
    with pytest.raises(ValueError):
        own("other")


def test_surprise_and_pronouns_in_the_ranking(spark):
    links = spark.createDataFrame(
        [("mentions", "a", 1, 1.0), ("mentions", "a", 2, 4.0), ("mentions", "b", 2, 1.0), ("coref", "a", 3, 9.0), ("coref", "a", 1, None)],
        "linkage string, concept_id string, entity_id long, weight double"
    )
    weight = {(r.concept_id, r.entity_id): r.weight for r in rank.surprising(links).filter("linkage = 'mentions'").collect()}
    assert weight == {("a", 1): 1.0, ("b", 2): 1.0, ("a", 2): pytest.approx(1 + 1.584963, abs=1e-5)}
    terms = spark.createDataFrame([(0, "a")], "term int, concept_id string")
    plain = {r.entity_id: r.score for r in rank.content_rank(links, terms, 1, boosts={}).collect()}
    meant = {r.entity_id: r.score for r in rank.content_rank(links, terms, 1, boosts={}, coref=0.5).collect()}
    assert set(plain) == {1, 2} and set(meant) == {1, 2, 3} and meant[2] == plain[2] and meant[3] == pytest.approx(3 * (meant[1] - plain[1]))


def test_queues_are_drained_and_filled_again(spark):
    from threadloom.streaming import sync

    lines = [
        '{"pattern": "x", "hits": [{"file": "a", "line": 1}, {"file": "a", "line": "1"}, {"file": null, "line": 2}]}', "no json",
        '{"pattern": "", "hits": []}', '{"pattern": "y", "hits": [{"file": "b", "line": 7}]}', "  ",
        '{"pattern": "x", "hits": [{"file": "c", "line": 3}]}'
    ]
    queue = spark.createDataFrame(list(enumerate(lines)), "seq long, value string")
    entries, report = sync.batch_of(queue)
    assert rows(entries) == [("x", 0, "a", 1), ("x", 0, "c", 3), ("y", 3, "b", 7)] and tuple(report.first()) == (5, 3, 0)
    assert rows(sync.batch_of(queue, 2)[0].select("pattern")) == [("x",), ("y",)] and sync.batch_of(queue, 2)[1].first().overflow == 1
    again = sync.requeued(entries, spark.createDataFrame([("y",)], "pattern string"), 100)
    assert rows(sync.batch_of(again)[0]) == [("x", 100, "a", 1), ("x", 100, "c", 3)]
    assert tuple(sync.batch_of(queue.limit(0))[1].first()) == (0, 0, 0)


def test_new_ids_follow_the_largest(spark):
    from threadloom.operators import mutate

    e = entities(spark, (5, 1, "doc", "a"))
    batch = spark.createDataFrame(
        [(1, "doc", n, None, None, None, 0, None, 2.0, i) for i, n in enumerate("cba")],
        "partition_id int, kind string, name string, path string, tldr string, meta string, protected int, canonical_name string, now double, seq long"
    )
    assert rows(mutate.upsert_entities(e, batch).select("id", "name")) == [(5, "a"), (6, "b"), (7, "c")]
