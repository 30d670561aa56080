from threadloom.graph import Graph
from threadloom.plans import set_algebra as sa


def graph(spark):
    entities = spark.createDataFrame(
        [(1, 0, "concept", "hub", None, 0)] + [(i, i % 2, "doc", f"d{i}", None, 0) for i in range(2, 52)],
        "id long, partition_id int, kind string, name string, canonical_name string, noise int"
    )
    links = [("same-as", 1, i, None) for i in range(2, 52)] + [("calls", 1, 2, None)]
    return Graph(entities, spark.createDataFrame(links, "linkage string, concept_id long, entity_id long, weight double"))


def test_a_large_hub_keeps_all_its_members(spark):
    assert sorted(tuple(r) for r in sa.canon_members(graph(spark)).collect()) == [(1, i, i % 2) for i in range(2, 52)]


def test_star_lookup_has_every_verb(spark):
    assert {r.linkage for r in sa.union_star_all(graph(spark)).collect()} == {"same-as", "calls"}
