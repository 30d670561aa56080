import pytest
from conftest import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from threadloom.graph import Graph
from threadloom.operators import dsl
from threadloom.operators.dsl import Node, Term, parse_functional, parse_infix

ENTITIES = [
    (1, 1, "concept", "parser", "parser", 0), (2, 1, "concept", "tokenizer", "tokenizer", 0), (3, 1, "concept", "noisy", "noisy", 1),
    (10, 1, "code", "src/foo.py", None, 0), (11, 1, "code", "src/lex.py", None, 0), (12, 1, "doc", "README.md", None, 0),
]
LINKS = [
    ("defines", 1, 10, 0.9), ("mentions", 1, 12, None), ("defines", 2, 11, None), ("related-to", 1, 11, None), ("mentions", 3, 12, None),
    ("mentions", 2, 12, 2.0)
]


@pytest.fixture(scope="module")
def graph(spark):
    e = spark.createDataFrame(ENTITIES, "id long, partition_id int, kind string, name string, canonical_name string, noise int")
    return Graph(e, spark.createDataFrame(LINKS, "linkage string, concept_id long, entity_id long, weight double")).scoped(1)


def ids(df):
    return {r[0] for r in df.collect()}


@pytest.mark.parametrize(
    "text, want",
    [
        ("defines:parser", {10}),
        ("defines:parser OR mentions:parser", {10, 12}),
        ("defines:parser AND mentions:parser", set()),
        ("parser", {10, 11, 12}),
        ("defines:parser AND NOT mentions:parser", {10}),
        ("defines:parser && !mentions:parser || defines:tokenizer", {10, 11}),
        ("related_to:parser", {11}),
        ("NOT parser", {1, 2, 3}),
        ("nothing", set()),
        ("NOT nothing", {1, 2, 3, 10, 11, 12}),
        ("Parser", {10, 11, 12}),
    ],
)
def test_infix(graph, text, want):
    assert ids(dsl.run(graph, text)) == want


def test_functional(graph):
    run = lambda q: dsl.run(graph, q, functional=True)
    assert run("Count(Row(defines, parser))").first()[0] == 1
    assert ids(run("Difference(Row(defines, parser), Row(mentions, 'parser'))")) == {10}
    assert ids(run("xor(union(Row(defines, parser), Row(mentions, parser)), Row(mentions, parser))")) == {10}
    assert rows(run("TopN(Union(parser, tokenizer), n=2)")) == [(11, 2), (12, 2)]
    assert ids(run("Neighbors(parser)")) == {10, 11, 12}


def test_co_occurrence_and_explain(spark, graph):
    assert rows(dsl.co_occurrence(graph, "parser")) == [(2, "tokenizer", 1)]
    evidence = spark.createDataFrame([(10, "defines", 1, "src/foo.py", 3)], "entity_id long, linkage string, concept_id long, file string, line int")
    from dataclasses import replace

    assert rows(
        dsl.explain(replace(graph, evidence=evidence), dsl.run(graph, "defines:parser OR mentions:parser"))
    ) == [(10, "defines", 1, "src/foo.py", 3), (12, None, None, None, None)]


@pytest.mark.parametrize("bad", ["", "a b", "(a", "a AND", "NOT NOT a", "a )", "#x", "not-x", "AND a"])
def test_bad_infix(bad):
    with pytest.raises(ValueError):
        parse_infix(bad)


@pytest.mark.parametrize("bad", ["", "Foo(a)", "Row(a)", "Row(a, b", "Union(a b)", "Xor(a)", "Row(a,b) c", "And(1)"])
def test_bad_functional(bad):
    with pytest.raises(ValueError):
        parse_functional(bad)


def test_trees():
    assert parse_infix("a or b and not l:c") == Node("or", (Term("a"), Node("and", (Term("b"), Node("not", (Term("c", "l"),))))))


terms = st.sampled_from([Term("parser"), Term("tokenizer"), Term("parser", "defines"), Term("parser", "mentions"), Term("missing")])
trees = st.recursive(
    terms,
    lambda t: st.one_of(
        st.builds(lambda a: Node("not", (a,)), t), st.builds(lambda op, a, b: Node(op, (a, b)), st.sampled_from(["and", "or", "diff", "xor"]), t, t)
    ),
    max_leaves=5
)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(tree=trees)
def test_laws_against_python_sets(graph, tree):
    names = {1: "parser", 2: "tokenizer", 3: "noisy"}
    everything = {e[0] for e in ENTITIES}

    def value(t):
        if isinstance(t, Term):
            return {e for linkage, c, e, _ in LINKS if names[c] == t.name and t.linkage in (None, linkage)}
        a = [value(x) for x in t.args]
        return {
            "not": lambda: everything - a[0], "and": lambda: a[0] & a[1], "or": lambda: a[0] | a[1], "diff": lambda: a[0] - a[1],
            "xor": lambda: a[0] ^ a[1]
        }[t.op]()

    assert ids(dsl.members(graph, tree)) == value(tree)
