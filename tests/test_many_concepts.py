"""Stores in which very many concepts have the name that is asked for."""

import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from oracle import same
from threadloom.operators import rank, walks
from threadloom.plans import compositions
from threadloom.plans.set_algebra import A


def write(folder, table, rows, names):
    pq.write_table(pa.table([pa.array(c) for c in zip(*rows)], names=names), f"{folder}/{table}.parquet")


def store(folder, n):
    """A store with n concepts of the name, mentioned by 90 documents, some of them in two sections."""
    rng = random.Random(n)
    concepts = [(i, i % 3, "concept", None, A if i % 2 else f"c{i}", None, 0, A) for i in range(1, n + 1)]
    docs = [(100_000 + d, d % 3, "doc", f"d/{d}.md", f"d{d // 2 if d % 5 == 0 else d}#s{d}", "about " * (d % 4), 0, None) for d in range(90)]
    names = ["id", "partition_id", "kind", "path", "name", "tldr", "noise", "canonical_name"]
    write(folder, "entities", [*concepts, *docs], names)
    bits = [(0, rng.choice(["mentions", "mentions", "Mentions", "defines"]), (rng.randrange(1, n + 1) << 32) + 100_000 + int(90 * rng.random() ** 2))
            for _ in range(1500)]
    bits += [(0, "calls", (i << 32) + i % n + 1) for i in range(1, n + 1)]
    write(folder, "bitmap_fragments", bits, ["partition_id", "linkage", "bit"])
    return str(folder)


@pytest.fixture(scope="module")
def stores(tmp_path_factory):
    return [store(tmp_path_factory.mktemp("store"), n) for n in (70, 1500)]


def expressions(df):
    return len(df._jdf.queryExecution().optimizedPlan().toJSON())


def test_content_context_is_planned_alike_for_any_number_of_concepts(spark, stores):
    few, many = (expressions(compositions.context_content(spark, s)) for s in stores)
    assert many < 1.1 * few
    for s in stores:
        same(spark, s, compositions.context_content, compositions.ORACLE["context_content"])


def test_the_bundle_is_planned_alike_for_any_number_of_concepts(spark, stores):
    few, many = (compositions.context_bundle(spark, s) for s in stores)
    assert expressions(many) < 1.1 * expressions(few)
    links = {r.entity_id for r in compositions.context_links(spark, stores[1]).collect()}
    got = many.collect()
    assert {r.entity_id for r in got if r.source == 0} == links and {r.source for r in got} >= {0, 1} and len(got) <= 40


def test_seeds_with_too_little_mass_are_not_fetched(spark, monkeypatch):
    rng = random.Random(4)
    links = [("calls", s, 1000 + rng.randrange(300), None) for s in range(200) for _ in range(6)]
    edges = walks.adjacency(spark.createDataFrame(links, "linkage string, concept_id long, entity_id long, weight double"))
    rows = sorted(tuple(r) for r in edges.collect())
    seeds = {s: 50.0 if s < 3 else 1.0 for s in range(200)} | {9999: 1.0}
    near = {}
    for a, b, w in rows:
        near.setdefault(a, []).append((b, w))
    want = walks.push_known(near, {u: sum(w for _, w in x) for u, x in near.items()}, seeds, 0.15, 4e-3, 200_000)[0]
    monkeypatch.setattr(walks, "MOST_LOCAL_EDGES", 100)
    got = {r.id: r.score for r in walks.ppr_push(edges, seeds, 0.15, 4e-3).collect()}
    assert len(got) >= 3 and got == pytest.approx(want)


def test_a_large_mapping_of_concepts_ranks_as_a_table_does(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["mentions", "defines", "lead"]), rng.randrange(400), rng.randrange(60), float(rng.randrange(1, 4))) for _ in range(3000)]
    links = spark.createDataFrame(rows, "linkage string, concept_id long, entity_id long, weight double")
    terms = {c: c % 2 for c in range(0, 400, 2)} | {c: 1 for c in range(1, 300, 2)}
    table = spark.createDataFrame([(t, c) for c, t in terms.items()], "term int, concept_id long")
    scores = lambda known: [(r.entity_id, round(r.score, 9)) for r in rank.content_rank(links, known, 2).collect()]
    assert scores(terms) == scores(table) and len(scores(terms)) == 50
    assert expressions(rank.content_rank(links, terms, 2)) < 1.1 * expressions(rank.content_rank(links, table, 2))


def test_the_text_of_the_bundle_is_planned_alike_and_has_all_its_names(spark, stores):
    few, many = (compositions.context_text(spark, s) for s in stores)
    assert expressions(many) < 1.1 * expressions(few)
    text = "\n".join(r.text for r in many.collect())
    assert all(r.name in text for r in compositions.context_bundle(spark, stores[1]).collect())
